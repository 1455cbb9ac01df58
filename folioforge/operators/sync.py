"""Keeping chunk and vector tables in step with the corpus by hashes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from folioforge.session import cut

#: Kinds of action in order of precedence.
KINDS = ("new", "content", "metadata", "unchanged", "deleted")


def canonical_metadata(m: Column) -> Column:
    """Keys in order with their values, nulls kept apart from empty strings."""
    entries = F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"))))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["k"], F.lit("="), F.coalesce(F.concat(F.lit("'"), e["v"], F.lit("'")), F.lit("null")))), "\x1f")


def hashes(documents: DataFrame) -> DataFrame:
    """source_path, doc_id, version and the SHA-256 of content and metadata."""
    return documents.select(
        "source_path", F.col("doc_id").alias("document_id"), "version", F.sha2(F.coalesce("content", F.lit("")), 256).alias("content_sha256"),
        F.sha2(F.coalesce(canonical_metadata(F.col("metadata")), F.lit("")), 256).alias("metadata_sha256"),
    )


def plan(documents: DataFrame, manifest: DataFrame, config_changed: bool = False) -> DataFrame:
    """source_path and kind: what must happen to every path known now or before; one full outer join."""
    now = hashes(documents).alias("n")
    old = manifest.select("source_path", "content_sha256", "metadata_sha256", F.lit(True).alias("known")).alias("o")
    kind = (
        F.when(F.col("n.content_sha256").isNull(), "deleted")
        .when(F.col("o.known").isNull(), "new")
        .when(F.lit(config_changed) | ~F.col("o.content_sha256").eqNullSafe(F.col("n.content_sha256")), "content")
        .when(~F.col("o.metadata_sha256").eqNullSafe(F.col("n.metadata_sha256")), "metadata")
        .otherwise("unchanged")
    )
    return now.join(old, "source_path", "full_outer").select("source_path", kind.alias("kind"))


def stale_chunks(manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    """source_path, chunk_id of manifest chunks that the new chunk table no longer has."""
    old = manifest.select("source_path", F.explode("chunk_ids").alias("chunk_id")).distinct()
    return old.join(chunks.select("chunk_id"), "chunk_id", "left_anti").select("source_path", "chunk_id")


def apply_plan(actions: DataFrame, stored: DataFrame, chunks: DataFrame, embed) -> DataFrame:
    """The chunk table after the plan: new and changed documents embedded, metadata rewritten, deleted ones gone, the rest kept.

    ``stored`` has chunk_id, source_path and embedding; ``chunks`` the current layout. Vectors of unchanged contents are reused;
    a missing one is an error, since the manifest says that it is stored.
    """
    now = chunks.join(actions.filter("kind <> 'deleted'"), "source_path")
    fresh = now.filter("kind in ('new', 'content')").withColumn("embedding", embed(F.col("text")))
    kept = now.filter("kind in ('metadata', 'unchanged')").join(stored.select("chunk_id", F.col("embedding").alias("_e")), "chunk_id", "left")
    kept = kept.withColumn("embedding", F.when(F.col("_e").isNull(), F.raise_error(F.concat(F.lit("no stored vector for "), "chunk_id")).cast("array<double>")).otherwise(F.col("_e"))).drop("_e")
    return fresh.unionByName(kept.select(*fresh.columns))


def new_manifest(documents: DataFrame, actions: DataFrame, manifest: DataFrame, chunks: DataFrame, now: Column) -> DataFrame:
    """The manifest to be written after everything else has been."""
    ids = chunks.groupBy("source_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id"))), lambda c: c["chunk_id"]).alias("new_ids"))
    old = manifest.select("source_path", F.col("chunk_ids").alias("old_ids"), F.col("indexed_at").alias("old_at"))
    same = F.col("kind") == "unchanged"
    rows = hashes(documents).join(actions, "source_path").join(ids, "source_path", "left").join(old, "source_path", "left")
    return rows.select(
        "source_path", "document_id", "version", "content_sha256", "metadata_sha256",
        F.coalesce(F.when(same, F.col("old_ids")).otherwise(F.col("new_ids")), F.array().cast("array<string>")).alias("chunk_ids"), F.when(same, F.col("old_at")).otherwise(now).alias("indexed_at"),
    )


def build_index(documents: DataFrame, chunks: DataFrame, embed, store, namespace: str = "default") -> tuple[int, int]:
    """Embed and store every chunk under its id; returns the numbers of documents and chunks. Repeating it gives the same table.

    ``store`` is a VectorTable or has its ``upsert``; it appears whole or not at all.
    """
    chunks = cut(chunks)
    store.upsert(chunks.withColumn("embedding", embed(F.col("text"))), namespace)
    return documents.count(), chunks.count()


def synchronize(documents: DataFrame, manifest: DataFrame, chunks: DataFrame, embed, store, save_manifest: Callable[[DataFrame], None], now: Column, namespace: str = "default", config_changed: bool = False, dry_run: bool = False) -> DataFrame:
    """Bring the stored table in step with the documents and then save the manifest; returns the plan in order of path.

    New and changed contents are embedded, metadata is rewritten beside the stored vectors, what is gone or stale is deleted: one
    new version of the table. The manifest is saved last, so that a run that fails before is repeated in full by the next one.
    A dry run only plans.
    """
    actions = cut(plan(documents, manifest, config_changed)).orderBy("source_path")
    if dry_run:
        return actions
    work = actions.filter("kind <> 'unchanged'")
    chunks = cut(chunks)
    moved = work.filter("kind in ('metadata')").join(chunks, "source_path").select("chunk_id")
    stored = store.fetch(moved, namespace).select("chunk_id", "source_path", "embedding")
    rows = apply_plan(work, stored, chunks, embed).filter("kind <> 'deleted'")
    old = manifest.join(work.select("source_path"), "source_path", "left_semi")
    store.replace(rows.select("chunk_id", "source_path", "chunk_index", "text", "embedding"), stale_chunks(old, chunks), namespace)
    save_manifest(new_manifest(documents, actions, manifest, chunks, now))
    return actions
