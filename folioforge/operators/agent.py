"""What an agent's message history and tools amount to as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

#: Fixed value: how a search result names its chunk.
CHUNK_LINE = r"chunk_id: (\S+)"
#: The forms in which a document is shown whole and cut.
WHOLE = "%s (%d characters)\n\n%s"
TRUNCATED = "%s (truncated to %d of %d characters)\n\n%s\n\n[TRUNCATED. Call read_document again with a larger max_chars if the part you need is missing.]"
MESSAGES = (
    "array<struct<role:string,content:array<struct<text:string,toolUse:struct<toolUseId:string,name:string,query:string>,"
    "toolResult:struct<toolUseId:string,status:string,text:string>>>>>"
)


def tool_calls(histories: DataFrame, key: str = "trace_id") -> DataFrame:
    """One row per tool use in order with its result, if any: key, call_no, name, query, status, result_chars, chunk_ids."""
    blocks = histories.select(key, F.posexplode("messages").alias("m", "message")).select(key, "m", F.posexplode("message.content").alias("b", "block"))
    uses = blocks.filter("block.toolUse is not null").select(key, "m", "b", F.col("block.toolUse").alias("u"))
    results = blocks.filter("block.toolResult is not null").select(key, F.col("block.toolResult.toolUseId").alias("id"), F.struct("m", "b").alias("at"), F.col("block.toolResult").alias("r"))
    last = results.groupBy(key, "id").agg(F.max_by("r", "at").alias("r"))
    numbered = uses.withColumn("call_no", F.row_number().over(Window.partitionBy(key).orderBy("m", "b"))).withColumn("id", F.col("u.toolUseId"))
    body = F.coalesce("r.text", F.lit(""))
    return numbered.join(last, [key, "id"], "left").select(
        key, "call_no", F.col("u.name").alias("name"), F.col("u.query").alias("query"), F.when(F.col("r").isNotNull(), F.coalesce("r.status", F.lit("success"))).alias("status"),
        F.length(body).alias("result_chars"), F.regexp_extract_all(body, F.lit(CHUNK_LINE), F.lit(1)).alias("chunk_ids"),
    )


def first_sightings(calls: DataFrame, key: str = "trace_id") -> DataFrame:
    """The chunks in the order in which the agent first saw them."""
    seen = calls.select(key, "call_no", F.posexplode("chunk_ids").alias("pos", "chunk_id")).groupBy(key, "chunk_id").agg(F.min(F.struct("call_no", "pos")).alias("at"))
    w = Window.partitionBy(key).orderBy("at")
    return seen.select(key, F.row_number().over(w).alias("rank"), "chunk_id", F.regexp_replace("chunk_id", r":[^:]*$", "").alias("source_path"))


def strip_trailing_tool_use(messages: Column) -> Column:
    """Messages without tool uses at the end: trailing messages of nothing else go, the last one loses its tool uses."""
    cleaned = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), F.filter(m["content"], lambda b: b["toolUse"].isNull()).alias("content"), F.size(m["content"]).alias("n")))
    # the last message that keeps anything, or had nothing to lose
    keep = F.array_max(F.transform(cleaned, lambda m, i: F.when((F.size(m["content"]) > 0) | (m["n"] <= 0), i + 1).otherwise(0)))
    last = F.coalesce(keep, F.lit(0))
    head = F.when(last > 1, F.slice(messages, F.lit(1), F.greatest(last - 1, F.lit(0)))).otherwise(F.slice(messages, 1, 0))
    tail = F.transform(F.slice(cleaned, F.greatest(last, F.lit(1)), F.lit(1)), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return F.when(last > 0, F.concat(head, tail)).otherwise(F.slice(messages, 1, 0))


def format_passage() -> Column:
    """A search result for columns rank, chunk_id, source_path, doc_id, version, status, department, score and text."""
    parts = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{c}: "), F.col(c))) for c in ("doc_id", "version", "status", "department")]
    header = F.concat_ws(" | ", *parts)
    return F.concat(
        F.format_string("[%d] chunk_id: %s\nsource_path: %s\n", "rank", "chunk_id", F.coalesce("source_path", F.lit("unknown"))),
        F.when(header != "", F.concat(header, F.lit("\n"))).otherwise(""), F.format_string("score: %.4f\n", "score"), F.coalesce("text", F.lit("")),
    )


def list_versions(documents: DataFrame) -> DataFrame:
    """doc_id, position, line: the versions of each document, newest first, undated ones last."""
    day = F.coalesce(F.date_format("effective_date", "yyyy-MM-dd"), F.lit(""))
    w = Window.partitionBy("doc_id").orderBy(day.desc(), "source_path")
    line = F.concat(
        F.lit("- version: "), F.coalesce("version", F.lit("unversioned")), F.lit(" | status: "), F.coalesce("status", F.lit("unknown")),
        F.lit(" | effective_date: "), F.coalesce(F.date_format("effective_date", "yyyy-MM-dd"), F.lit("unknown")),
        F.lit(" | expiry_date: "), F.coalesce(F.date_format("expiry_date", "yyyy-MM-dd"), F.lit("none")), F.lit(" | source_path: "), "source_path",
    )
    return documents.filter("doc_id is not null").select("doc_id", F.row_number().over(w).alias("position"), line.alias("line"))


def clamp(value: int, least: int, most: int) -> int:
    return max(least, min(most, value))


def read_document(documents: DataFrame, max_chars: int = 6000) -> DataFrame:
    """source_path, text: contents under a line that names the path and size, cut after max_chars (held within 1 and 20000)."""
    n = clamp(max_chars, 1, 20_000)
    c = F.coalesce("content", F.lit(""))
    size = F.length(c)
    whole = F.format_string(WHOLE, "source_path", size, c)
    cut = F.format_string(TRUNCATED, "source_path", F.lit(n), size, F.substring(c, 1, n))
    return documents.select("source_path", F.when(size <= n, whole).otherwise(cut).alias("text"))


def check_path(path: str, root: str = "data/") -> str:
    """A path inside the corpus root; anything that leads out of it is an error."""
    if not path.strip():
        raise ValueError("source_path must not be empty")
    parts: list[str] = []
    for p in path.split("/"):
        if p == "..":
            if not parts:
                raise ValueError(f"source_path must stay inside {root}: got {path!r}")
            parts.pop()
        elif p not in ("", "."):
            parts.append(p)
    clean = "/".join(parts)
    if path.startswith("/") or not clean.startswith(root):
        raise ValueError(f"source_path must stay inside {root}: got {path!r}")
    return clean
