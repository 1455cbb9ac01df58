"""Questions, traces and verdicts as JSON lines, and the manifest as JSON."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: A manifest of more entries is no single document.
MANIFEST_ROWS = 200_000

QUESTION = (
    "id string, question string, expected_answer string, source_files array<string>, concept string, difficulty string, "
    "answerable boolean, distractor_files array<string>, note string"
)
CHUNK = "struct<chunk_id:string,source_path:string,rank:int,score:double>"
TRACE = (
    f"question_id string, question string, pipeline_config string, retrieved_chunks array<{CHUNK}>, queries_used array<string>, "
    "context_sent_to_model string, answer string, timing_ms int, generation_usage map<string,bigint>, error string, "
    "tool_calls array<struct<name:string,input:string,result_chars:int,status:string,chunk_ids:array<string>>>"
)
VERDICT = (
    "question_id string, correct boolean, citation_supported boolean, used_correct_version boolean, proper_refusal boolean, "
    "reason string, error string, failure_stage string"
)
MANIFEST = (
    "schema_version int, index_config map<string,string>, documents array<struct<source_path:string,document_id:string,version:string,"
    "content_sha256:string,metadata_sha256:string,chunk_ids:array<string>,indexed_at:string>>"
)


def _lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema. A line that is no JSON object of it ends the read with an error that names its file and shows how it begins; blank lines are skipped."""
    lines = spark.read.text(path).filter(F.trim("value") != "").select("value", F.col("_metadata.file_name").alias("file"))
    parsed = lines.select("file", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    error = F.raise_error(F.concat("file", F.lit(": not a JSON object of the form wanted: "), F.left("r._bad", F.lit(120)))).cast("boolean")
    return parsed.filter(F.when(F.col("r._bad").isNotNull(), error).otherwise(F.lit(True))).select("r.*").drop("_bad")


def _required(df: DataFrame, what: str, key: str, columns: tuple[str, ...]) -> DataFrame:
    """Rows that lack a column are an error naming what is lacking."""
    lacking = F.array_join(F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in columns))), ", ")
    return df.withColumn(key, F.when(lacking != "", F.raise_error(F.concat(F.lit(f"{what} without "), lacking)).cast("string")).otherwise(F.col(key)))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    q = _lines(spark, path, QUESTION)
    none = F.array().cast("array<string>")
    q = _required(q, "question", "id", ("id", "question", "expected_answer", "concept", "difficulty", "answerable"))
    return q.withColumn("source_files", F.coalesce("source_files", none)).withColumn("distractor_files", F.coalesce("distractor_files", none))


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    t = _required(_lines(spark, path, TRACE), "trace", "question_id", ("question_id", "question"))
    for c, kind in (("retrieved_chunks", f"array<{CHUNK}>"), ("queries_used", "array<string>")):
        t = t.withColumn(c, F.coalesce(c, F.array().cast(kind)))
    return t


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path, VERDICT)


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON object per line, nulls written out."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str] | None] | None:
    """(entries, index configuration) of a manifest; None if there is none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    m = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(path)
    head = m.select("schema_version", "index_config").head()
    if head is None or head[0] is None:
        raise ValueError(f"{path} is no manifest: it has no schema_version")
    entries = m.select(F.explode("documents").alias("d")).select("d.*")
    return _required(entries, "manifest entry", "source_path", ("source_path", "content_sha256", "metadata_sha256", "chunk_ids", "indexed_at")), head[1]


def write_manifest(entries: DataFrame, path: str, index_config: dict[str, str], schema_version: int = 1) -> None:
    """The manifest as a table of entries beside its configuration; written last, it marks the run as complete."""
    config = F.create_map(*[F.lit(x) for kv in sorted(index_config.items()) for x in kv])
    entries.withColumn("schema_version", F.lit(schema_version)).withColumn("index_config", config).sort("source_path").write.mode("overwrite").parquet(path)


def write_manifest_json(entries: DataFrame, path: str, index_config: dict[str, str], schema_version: int = 1) -> None:
    """The manifest as the one JSON document that read_manifest reads, sorted by path; it replaces the old one in one step.

    One document is one row, so more than MANIFEST_ROWS entries are an error: a manifest of that size is a table.
    """
    spark = entries.sparkSession
    if entries.limit(MANIFEST_ROWS + 1).count() > MANIFEST_ROWS:
        raise ValueError(f"more than {MANIFEST_ROWS} entries: use write_manifest")
    columns = ("source_path", "document_id", "version", "content_sha256", "metadata_sha256", "chunk_ids", "indexed_at")
    config = F.create_map(*[F.lit(x) for kv in sorted(index_config.items()) for x in kv]) if index_config else F.lit(None).cast("map<string,string>")
    documents = F.array_sort(F.collect_list(F.struct(*columns))).alias("documents")
    text = entries.agg(documents).select(F.to_json(F.struct(F.lit(schema_version).alias("schema_version"), config.alias("index_config"), "documents"), {"ignoreNullFields": "false"}))
    text = text.head()[0]  # bounded by MANIFEST_ROWS
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    final, aside = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    fs = final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(aside, False)
    out.write(bytearray(text, "utf-8"))
    out.close()
    option = hadoop.Options.Rename
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(aside, final, options)


def read_manifest_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
