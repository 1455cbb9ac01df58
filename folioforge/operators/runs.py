"""Runs over all questions: retrieval, answers and verdicts, one trace or verdict per question.

Models are column functions, so a run is one plan. What fails for one question, in the model or in checking its answer, stands
in the ``error`` of its row; the run goes on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from folioforge.operators.answers import REFUSAL, ground, judge, judge_prompt, labelled_context
from folioforge.operators.evaluate import judgement_summary, require_traces, retrieval_metrics, retrieval_summary

CHUNKS = "array<struct<chunk_id:string,source_path:string,rank:int,score:double>>"
#: How an answer that fails its checks is told from other errors, and the error of traces that fit no question.
GROUNDING = "GroundingError: "
NOT_COVERED = "No gold question matches any trace in the file"

#: A model: (system prompt, user prompt) to struct<text, error>; see functions.vectors.model_completion.
Complete = Callable[[Column, Column], Column]


def passages_of(matches: DataFrame) -> DataFrame:
    """chunk_id, text, score, metadata of matches(id, score, metadata map): the text leaves the metadata. A match without id or text is an error."""
    text = F.col("metadata")["text"]
    lacking = lambda what, value: F.when(value.isNull(), F.raise_error(F.lit(f"match without {what}")).cast("string")).otherwise(value)
    return matches.select(
        lacking("id", F.col("id")).alias("chunk_id"), lacking("text", text).alias("text"), F.col("score").cast("double").alias("score"), F.map_filter("metadata", lambda k, v: k != "text").alias("metadata")
    )


def trace_chunks(ranked: DataFrame) -> DataFrame:
    """query_id, retrieved_chunks: each list in the order of its ranks. A passage without a source path is an error."""
    path = F.when(F.col("source_path").isNull(), F.raise_error(F.concat(F.lit("no source path for "), "chunk_id")).cast("string")).otherwise(F.col("source_path"))
    row = F.struct(F.col("rank").cast("int").alias("rank"), "chunk_id", path.alias("source_path"), F.col("score").cast("double").alias("score"))
    ordered = F.transform(F.array_sort(F.collect_list(row)), lambda c: F.struct(c["chunk_id"].alias("chunk_id"), c["source_path"].alias("source_path"), c["rank"].alias("rank"), c["score"].alias("score")))
    return ranked.groupBy("query_id").agg(ordered.cast(CHUNKS).alias("retrieved_chunks"))  # top_k rows per question


def retrieval_traces(questions: DataFrame, ranked: DataFrame, config: dict[str, str] | None = None, queries_used: DataFrame | None = None) -> DataFrame:
    """One trace per question(query_id, text), also for those without a result.

    queries_used(query_id, queries): the queries that a strategy asked, where that was not the question alone.
    """
    t = questions.select("query_id", F.col("text").alias("question")).join(trace_chunks(ranked), "query_id", "left")
    used = F.array("question")
    if queries_used is not None:
        t, used = t.join(queries_used.select("query_id", "queries"), "query_id", "left"), F.coalesce("queries", used)
    settings = F.to_json(F.create_map(*[F.lit(x) for kv in sorted((config or {}).items()) for x in kv])) if config else F.lit("{}")
    return t.select(
        F.col("query_id").alias("question_id"), "question", settings.alias("pipeline_config"), F.coalesce("retrieved_chunks", F.array().cast(CHUNKS)).alias("retrieved_chunks"),
        used.alias("queries_used"), F.lit(None).cast("string").alias("error"),
    )


def evaluate_retrieval(gold: DataFrame, ranked: DataFrame, k: int = 5, config: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(traces, metrics per question, summary) of ranked lists over gold(id, question, answerable, source_files)."""
    traces = retrieval_traces(gold.select(F.col("id").alias("query_id"), F.coalesce("question", F.lit("")).alias("text")), ranked.filter(F.col("rank") <= k), {**(config or {}), "top_k": str(k)})
    pairs = traces.join(gold.select(F.col("id").alias("question_id"), "answerable", "source_files"), "question_id")
    metrics = retrieval_metrics(pairs, k)
    return traces, metrics, retrieval_summary(metrics)


def user_prompt(question: Column, context: Column) -> Column:
    """Fixed form of the answering model's input."""
    return F.concat(F.lit("Question:\n"), question, F.lit("\n\nContext:\n"), context, F.lit("\n\nAnswer the question now."))


def answer_questions(questions: DataFrame, ranked: DataFrame, complete: Complete, system_prompt: str = "", config: dict[str, str] | None = None) -> DataFrame:
    """Traces with answers for questions(query_id, text) over ranked(query_id, rank, chunk_id, source_path, score, text).

    Without passages the answer is the refusal and no model is asked. An answer without citations or with unknown ones, and a
    model's own failure, are errors of the row and leave no answer; passages and context are kept in any case.
    """
    traces = retrieval_traces(questions, ranked, config).drop("error")
    context = labelled_context(ranked).select(F.col("query_id").alias("question_id"), "context")
    asked = traces.join(context, "question_id", "left")
    some = F.size("retrieved_chunks") > 0
    none = F.lit(None).cast("struct<text:string,error:string>")
    told = F.when(some, complete(F.lit(system_prompt), user_prompt(F.col("question"), F.col("context")))).otherwise(none)
    checked = ground(asked.withColumn("_m", told).withColumn("answer", F.col("_m.text")).withColumn("passages", F.transform("retrieved_chunks", lambda c: F.struct(c["rank"].alias("rank"), c["chunk_id"].alias("chunk_id")))))
    error = F.coalesce("_m.error", F.concat(F.lit(GROUNDING), "grounding_error"))
    return checked.select(
        "question_id", "question", "pipeline_config", "retrieved_chunks", "queries_used", F.col("context").alias("context_sent_to_model"),
        F.when(error.isNull(), F.when(some, F.col("answer")).otherwise(F.lit(REFUSAL))).alias("answer"), F.when(error.isNull(), F.col("cited_chunk_ids")).alias("cited_chunk_ids"), error.alias("error"),
    )


def judge_traces(gold: DataFrame, traces: DataFrame, complete: Complete, system_prompt: str = "") -> tuple[DataFrame, DataFrame]:
    """(verdicts, summary) on the traces of all gold questions; questions without a trace are an error.

    What the model failed on is a verdict with an error of the judge, as is a response that cannot be read.
    """
    require_traces(gold, traces)
    g = gold.select(F.col("id").alias("question_id"), "answerable", "expected_answer", "source_files")
    ids = [c for c in ("trace_id",) if c in traces.columns]
    t = traces.select(*ids, "question_id", F.coalesce("question", F.lit("")).alias("question"), "answer", F.col("context_sent_to_model").alias("context"), F.col("error").alias("trace_error"))
    asked = t.join(g, "question_id").withColumn("_m", complete(F.lit(system_prompt), judge_prompt())).withColumn("response", F.col("_m.text"))
    verdicts = judge(asked)
    failed = F.col("_m.error").isNotNull() & F.coalesce(F.col("failure_stage") == "judge", F.lit(False))
    verdicts = verdicts.withColumn("error", F.when(failed, F.col("_m.error")).otherwise(F.col("error"))).drop("_m", "response")
    return verdicts, judgement_summary(verdicts)


def covered(gold: DataFrame, traces: DataFrame) -> DataFrame:
    """The gold questions that the traces cover; none at all is an error."""
    kept = gold.join(traces.select(F.col("question_id").alias("id")).distinct(), "id", "left_semi")
    if kept.isEmpty():
        raise ValueError(NOT_COVERED)
    return kept


def rejudge(gold: DataFrame, traces: DataFrame, complete: Complete, system_prompt: str = "") -> tuple[DataFrame, DataFrame]:
    """Verdicts on saved traces, over the questions that they cover."""
    return judge_traces(covered(gold, traces), traces, complete, system_prompt)


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The first n rows of one file in its order."""
    if n < 1:
        raise ValueError("limit must be at least 1")
    return df.withColumn("_at", F.monotonically_increasing_id()).orderBy("_at").limit(n).drop("_at")
