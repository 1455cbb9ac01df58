"""Chunkers: fixed size, along Markdown structure, and by similarity of neighbouring units.

All are expressions over one document's text that give ``array<string>``; ``chunk_table`` makes rows of them. The packing
steps depend on their own earlier output and are folds over the document's pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioforge.functions.text import heading_blocks, is_heading, not_blank, once, paragraphs, sections, sentences, strip
from folioforge.functions.vectors import cosine

EMPTY = "array<string>"


def _positive(size: int) -> None:
    if size < 1:
        raise ValueError("chunk_size must be at least 1")


def fixed_chunks(text: Column, chunk_size: int = 500) -> Column:
    """Slices of chunk_size code points; none for an empty text."""
    _positive(chunk_size)
    n = F.length(text)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(chunk_size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(chunk_size)))


def split_block(block: Column, chunk_size: int) -> Column:
    """A block within the size as it is; else its paragraphs' sentences, a leading heading kept whole."""

    def of(paras: Column, titled: Column) -> Column:
        body = F.when(titled, F.slice(paras, F.lit(2), F.greatest(F.size(paras) - 1, F.lit(0)))).otherwise(paras)
        return F.concat(F.when(titled, F.slice(paras, 1, 1)).otherwise(F.array().cast(EMPTY)), F.flatten(F.transform(body, sentences)))

    parts = once(paragraphs(block), lambda p: once((F.size(p) > 0) & is_heading(F.get(p, F.lit(0))), lambda titled: of(p, titled)))
    return F.when(F.length(block) <= chunk_size, F.array(block)).otherwise(once(parts, lambda p: F.when(F.size(p) == 0, F.array(block)).otherwise(p)))


def pack(pieces: Column, chunk_size: int) -> Column:
    """Pieces joined by blank lines for as long as they fit."""
    start = F.struct(F.array().cast(EMPTY).alias("done"), F.lit("").alias("open"))

    def add(acc: Column, piece: Column) -> Column:
        full = F.length(acc["open"]) + 2 + F.length(piece) > chunk_size
        first = F.struct(acc["done"].alias("done"), piece.alias("open"))
        closed = F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), piece.alias("open"))
        joined = F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.lit("\n\n"), piece).alias("open"))
        return F.when(acc["open"] == "", first).when(full, closed).otherwise(joined)

    return F.aggregate(pieces, start, add, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def markdown_chunks(text: Column, chunk_size: int = 500) -> Column:
    """Heading blocks, divided where oversized and packed up to the target size; a sentence is never cut."""
    _positive(chunk_size)
    pieces = F.flatten(F.transform(heading_blocks(text), lambda b: split_block(b, chunk_size)))
    return pack(pieces, chunk_size)


def semantic_units(text: Column) -> Column:
    """Headings, whole tables and lists, and sentences, in order."""

    def of_paragraph(p: Column) -> Column:
        whole = F.contains(p, F.lit("|")) | p.startswith("- ") | p.startswith("* ") | p.startswith("1. ")
        return F.when(whole, F.array(p)).otherwise(sentences(p))

    def of_section(s: Column) -> Column:
        # every kind of line end counts for the heading line
        lines = F.split(s, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]", -1)
        titled = is_heading(F.get(lines, F.lit(0)))
        body = strip(F.array_join(F.when(titled, F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines), "\n"))
        head = F.when(titled, F.array(strip(F.get(lines, F.lit(0))))).otherwise(F.array().cast(EMPTY))
        return F.concat(head, F.flatten(F.transform(paragraphs(body), of_paragraph)))

    return F.flatten(F.transform(not_blank(sections(text)), of_section))


def pack_units(units: Column, embeddings: Column, chunk_size: int = 500, min_chunk_size: int = 200, threshold: float = 0.7) -> Column:
    """Units joined until the size is reached or, from the least size on, the next unit's vector turns away from the last one's."""
    _positive(chunk_size)
    if not 0 <= min_chunk_size <= chunk_size or not -1 <= threshold <= 1:
        raise ValueError("min_chunk_size must lie within chunk_size and threshold between -1 and 1")
    both = F.arrays_zip(units.alias("unit"), embeddings.alias("vector"))
    checked = F.when(F.size(units) != F.size(embeddings), F.raise_error(F.lit("one vector for each unit is needed")).cast("array<struct<unit:string,vector:array<double>>>")).otherwise(
        F.transform(both, lambda b: F.struct(b["unit"].alias("unit"), b["vector"].cast("array<double>").alias("vector")))
    )
    start = F.struct(F.array().cast(EMPTY).alias("done"), F.lit("").alias("open"), F.lit(None).cast("array<double>").alias("last"))

    def add(acc: Column, b: Column) -> Column:
        has = acc["open"] != ""
        joined = F.when(has, F.concat(acc["open"], F.lit("\n\n"), b["unit"])).otherwise(b["unit"])
        turned = acc["last"].isNotNull() & ~is_heading(b["unit"]) & (cosine(acc["last"], b["vector"]) < threshold)
        full = has & ((F.length(joined) > chunk_size) | (turned & (F.length(acc["open"]) >= min_chunk_size)))
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
            F.when(full, b["unit"]).otherwise(joined).alias("open"),
            b["vector"].alias("last"),
        )

    return F.aggregate(checked, start, add, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def offsets(chunks: Column, content: Column) -> Column:
    """(start, end) of each chunk: where it is found from the end of the one before on, else that end itself.

    Re-joined sentences are no substring of the content; for them the offsets drift by design.
    """
    start = F.struct(F.array().cast("array<struct<character_start:int,character_end:int>>").alias("done"), F.lit(0).alias("at"))

    def add(acc: Column, chunk: Column) -> Column:
        found = F.call_function("locate", chunk, content, acc["at"] + 1) - 1
        begin = F.when(found < 0, acc["at"]).otherwise(found)
        end = begin + F.length(chunk)
        return F.struct(F.concat(acc["done"], F.array(F.struct(begin.alias("character_start"), end.alias("character_end")))).alias("done"), end.alias("at"))

    return F.aggregate(chunks, start, add, lambda acc: acc["done"])


def chunk_table(documents: DataFrame, chunks: Column, strategy: str, keep: list[str] | None = None, with_offsets: bool = False) -> DataFrame:
    """One row per chunk of documents(source_path, content, …): chunk_id, source_path, chunk_index, text and the kept columns."""
    keep = keep or []
    made = documents.select("source_path", "content", *keep, chunks.alias("_chunks"))
    zipped = F.arrays_zip(F.col("_chunks").alias("text"), offsets(F.col("_chunks"), F.col("content")).alias("at")) if with_offsets else F.transform("_chunks", lambda c: F.struct(c.alias("text")))
    rows = made.select("source_path", *keep, F.posexplode(zipped).alias("chunk_index", "_c"))
    out = [F.format_string("%s:%04d", "source_path", "chunk_index").alias("chunk_id"), "source_path", "chunk_index", F.col("_c.text").alias("text")]
    if with_offsets:
        out += [F.col("_c.at.character_start").alias("character_start"), F.col("_c.at.character_end").alias("character_end")]
    return rows.select(*out, *keep, F.lit(strategy).alias("chunking_strategy"))


def corpus(source_documents: DataFrame) -> DataFrame:
    """source_documents with the content stripped (a null content is empty)."""
    return source_documents.withColumn("content", F.coalesce(strip(F.col("content")), F.lit("")))
