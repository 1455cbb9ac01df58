"""A vector and chunk table on shared storage: versions of a Parquet table behind numbered pointers.

A write makes a complete new version under a name of its own and then claims the next number for it, so that readers see the
old or the new table and a failed write leaves nothing visible. Of two writers at once one gets the number; the other starts
again from the table that the first has made. Rows carry a namespace, which is a partition column.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioforge.session import shared_root
from folioforge.sources.claims import Claims

#: Dimensions of a vector index unless told otherwise.
DIMENSION = 768


@dataclass(frozen=True)
class Settings:
    """Connection settings; every one is needed."""

    root: str
    index: str

    @classmethod
    def from_environment(cls, env: dict[str, str] | None = None) -> "Settings":
        env = dict(os.environ) if env is None else env
        lacking = [k for k in ("FOLIOFORGE_ROOT", "FOLIOFORGE_INDEX") if not env.get(k, "").strip()]
        if lacking:
            raise ValueError("missing settings: " + ", ".join(lacking))
        return cls(env["FOLIOFORGE_ROOT"].rstrip("/"), env["FOLIOFORGE_INDEX"])


class VectorTable(Claims):
    """chunk_id, source_path, chunk_index, text, embedding, namespace. See Claims for what the folder needs."""

    SCHEMA = "chunk_id string, source_path string, chunk_index int, text string, embedding array<double>, namespace string"

    def __init__(self, spark: SparkSession, settings: Settings, dimension: int = DIMENSION, claim: Callable[[str, bytes], bool] | None = None):
        super().__init__(spark, f"{settings.root}/{settings.index}", claim)
        self.dimension = dimension

    def _version(self) -> int:
        return max((int(n[2:10]) for n in self._names(self.root) if n.startswith("v-") and n.endswith(".json")), default=0)

    def _pointer(self, version: int) -> str:
        return f"{self.root}/v-{version:08d}.json"

    def ensure(self) -> "VectorTable":
        """Create the table if there is none."""
        if not self._version():
            self._write(lambda old: old)
        return self

    def _at(self, version: int) -> DataFrame:
        if not version:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self._read(self._pointer(version))["path"])

    def _write(self, change: Callable[[DataFrame], DataFrame]) -> None:
        """Make the next version from the last one."""
        while True:
            last, path = self._version(), f"{self.root}/data/{uuid.uuid4().hex}"
            change(self._at(last)).write.partitionBy("namespace").parquet(path)
            if self._create(self._pointer(last + 1), {"path": path}):
                return
            self._fs.delete(self._path(path), True)

    def read(self, namespace: str | None = None) -> DataFrame:
        rows = self._at(self._version())
        return rows if namespace is None else rows.filter(F.col("namespace") == namespace)

    def _checked(self, rows: DataFrame, namespace: str) -> DataFrame:
        """The rows in the table's form; of several rows of a chunk the one with the least text counts."""
        bad = F.raise_error(F.lit(f"vectors must have {self.dimension} dimensions")).cast("array<double>")
        given = rows.withColumn("embedding", F.when(F.size("embedding") == self.dimension, F.col("embedding").cast("array<double>")).otherwise(bad))
        kept = F.struct("text", "source_path", F.col("chunk_index").cast("int").alias("chunk_index"), "embedding")
        one = given.groupBy("chunk_id").agg(F.min(kept).alias("r"))
        return one.select("chunk_id", "r.source_path", "r.chunk_index", "r.text", "r.embedding").withColumn("namespace", F.lit(namespace))

    def upsert(self, rows: DataFrame, namespace: str = "default") -> None:
        """Rows replace those of the same chunk in the namespace. A vector of another dimension is an error."""
        new = self._checked(rows, namespace)
        self._write(lambda old: old.join(new.select("chunk_id", "namespace"), ["chunk_id", "namespace"], "left_anti").select(*new.columns).unionByName(new))

    def replace(self, rows: DataFrame, gone: DataFrame, namespace: str = "default") -> None:
        """Upsert rows and delete gone(chunk_id) in one new version; a chunk in both stays."""
        new = self._checked(rows, namespace)
        out = new.select("chunk_id").unionByName(gone.select("chunk_id")).distinct().withColumn("namespace", F.lit(namespace))
        self._write(lambda old: old.join(out, ["chunk_id", "namespace"], "left_anti").select(*new.columns).unionByName(new))

    def delete(self, ids: DataFrame, namespace: str = "default") -> None:
        gone = ids.select("chunk_id").withColumn("namespace", F.lit(namespace))
        self._write(lambda old: old.join(gone, ["chunk_id", "namespace"], "left_anti").select(*old.columns))

    def fetch(self, ids: DataFrame, namespace: str = "default") -> DataFrame:
        """The rows of ids(chunk_id); a chunk that is not stored is an error."""
        stored = self.read(namespace).withColumn("_there", F.lit(True))
        missing: Column = F.raise_error(F.concat(F.lit("no stored vector for "), "chunk_id")).cast("boolean")
        return ids.select("chunk_id").distinct().join(stored, "chunk_id", "left").filter(F.when(F.col("_there").isNull(), missing).otherwise(F.lit(True))).drop("_there")


def input_files(spark: SparkSession, paths: list[str]) -> list[tuple[str, int, int]]:
    """(path, length, time of change) of the files at or below the paths, in order."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    found = []
    for path in paths:
        p = hadoop.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.getFileStatus(p).isFile():
            s = fs.getFileStatus(p)
            found.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
            continue
        files = fs.listFiles(p, True)
        while files.hasNext():
            s = files.next()
            found.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return sorted(found)


def stored_table(spark: SparkSession, kind: str, settings: dict, inputs: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """A table that follows from files and settings alone: made once, kept in the shared folder, read by everybody after.

    Its name is a digest of the kind, the settings and the files with their lengths and times of change, so that other files or
    settings mean another table. It appears under its name when it is whole; of two writers at once the first one's counts.
    """
    name = hashlib.sha256(json.dumps([kind, settings, input_files(spark, inputs)], sort_keys=True).encode()).hexdigest()[:32]
    root = f"{shared_root(spark)}/tables/{kind}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    final = hadoop.Path(f"{root}/{name}")
    fs = final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(final):
        aside = hadoop.Path(f"{root}/.{name}-{uuid.uuid4().hex}")  # hidden to readers, wherever a lost race may leave it
        build().write.parquet(aside.toString())
        if fs.exists(final) or not fs.rename(aside, final):
            fs.delete(aside, True)
    return spark.read.parquet(final.toString())
