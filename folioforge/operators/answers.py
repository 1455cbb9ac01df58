"""Around the answering model: labelled context, citation checks, and parsers for what models return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioforge.functions.text import CHUNK_CITATION, LABEL_CITATION

#: Fixed value: the one answer that counts as a refusal.
REFUSAL = "I don't know based on the provided context."
#: The texts of errors and reasons.
NO_CITATION = "Model answer has no context citations"
UNKNOWN_CITATION = "Model answer cited context labels that were not provided: "
NO_JSON = "Judge did not return a JSON object"
NO_VERDICT = "Judge response is missing one or more boolean verdicts"
NO_REASON = "Judge response is missing a reason"
NOT_JUDGED = "No semantic judgement was produced."
PASSED = "Deterministic pass: the answer exactly matches the required refusal."
PIPELINE = "Pipeline error: "
#: The verdicts that a judge must give.
VERDICTS = ("correct", "citation_supported", "used_correct_version", "proper_refusal")


def ordered_text(order: Column, text: Column, separator: str = "\n\n") -> Column:
    """Aggregate: the texts of a group in order, joined. A group is one list of results, so it is short."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t"))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), separator)


def labelled_context(ranked: DataFrame) -> DataFrame:
    """query_id, context: each passage under its label with source and chunk; ranked(query_id, rank, chunk_id, source_path, text)."""
    part = F.concat(
        F.lit("[S"), F.col("rank").cast("string"), F.lit("]\nSource: "), F.coalesce("source_path", F.lit("unknown")),
        F.lit("\nChunk: "), F.col("chunk_id"), F.lit("\n"), F.coalesce("text", F.lit("")),
    )
    return ranked.groupBy("query_id").agg(ordered_text(F.col("rank"), part).alias("context"))


def cited_labels(answer: Column) -> Column:
    return F.transform(F.regexp_extract_all(answer, F.lit(LABEL_CITATION), F.lit(1)), lambda x: x.cast("int"))


def cited_chunks(answer: Column) -> Column:
    return F.regexp_extract_all(answer, F.lit(CHUNK_CITATION), F.lit(1))


def ground(answers: DataFrame) -> DataFrame:
    """Checks answers(…, answer, passages array<struct<rank, chunk_id>>) against what the model was given.

    Adds final_answer, cited_chunk_ids (distinct, in order of citation) and grounding_error: none without passages (then the
    answer is the refusal) and for the exact refusal; else a missing or an unknown citation.
    """
    labels = cited_labels(F.coalesce("answer", F.lit("")))
    ranks = F.transform("passages", lambda p: p["rank"])
    empty = F.coalesce(F.size("passages"), F.lit(0)) <= 0
    refused = empty | F.coalesce(F.col("answer") == REFUSAL, F.lit(False))
    unknown = F.array_sort(F.array_distinct(F.filter(labels, lambda x: ~F.array_contains(ranks, x))))
    by_rank = F.transform(labels, lambda x: F.get(F.filter("passages", lambda p: p["rank"] == x), F.lit(0))["chunk_id"])
    error = (
        F.when(refused, F.lit(None).cast("string"))
        .when(F.size(labels) == 0, F.lit(NO_CITATION))
        .when(F.size(unknown) > 0, F.concat(F.lit(UNKNOWN_CITATION), F.array_join(F.transform(unknown, lambda x: F.concat(F.lit("S"), x.cast("string"))), ", ")))
    )
    none = F.array().cast("array<string>")
    return (
        answers.withColumn("grounding_error", error)
        .withColumn("final_answer", F.when(empty, F.lit(REFUSAL)).otherwise(F.col("answer")))
        .withColumn("cited_chunk_ids", F.when(refused | F.col("grounding_error").isNotNull(), none).otherwise(F.array_distinct(by_rank)))
    )


def parse_verdicts(responses: DataFrame, response: str = "response") -> DataFrame:
    """The verdicts and reason of a judge's response, or parse_error. Only JSON booleans are verdicts."""
    body = F.regexp_extract(F.coalesce(response, F.lit("")), r"(?s)\{.*\}", 0)
    schema = ", ".join(f"{v} boolean" for v in VERDICTS) + ", reason string"
    out = responses.withColumn("_j", F.from_json(body, schema)).withColumn("_r", F.get_json_object(body, "$.reason"))
    # a number or object as the reason is no text: it must be quoted in the body
    quoted = F.regexp_like(body, F.lit(r'"reason"\s*:\s*"'))
    missing = F.lit(False)
    for v in VERDICTS:
        missing = missing | F.col(f"_j.{v}").isNull()
    error = (
        F.when(body == "", NO_JSON)
        .when(missing, NO_VERDICT)
        .when(~quoted | F.col("_r").isNull() | (F.trim("_r") == ""), NO_REASON)
    )
    ok = error.isNull()
    cols = [F.when(ok, F.col(f"_j.{v}")).otherwise(F.lit(False)).alias(v) for v in VERDICTS]
    reason = F.when(ok, F.col("_r")).otherwise(F.lit(NOT_JUDGED))
    return out.select(*responses.columns, *cols, reason.alias("reason"), error.alias("error"), F.when(~ok, F.lit("judge")).alias("failure_stage"))


def judge(pairs: DataFrame) -> DataFrame:
    """Verdicts for pairs(answerable, answer, trace_error, response): a pipeline error fails, the exact refusal of an
    unanswerable question passes without the model, everything else is the parsed response."""
    parsed = parse_verdicts(pairs)
    failed = F.col("trace_error").isNotNull()
    passed = ~failed & ~F.coalesce("answerable", F.lit(True)) & F.coalesce(F.col("answer") == REFUSAL, F.lit(False))
    fixed = {"correct": True, "citation_supported": False, "used_correct_version": False, "proper_refusal": True}
    cols = [F.when(failed, F.lit(False)).when(passed, F.lit(fixed[v])).otherwise(F.col(v)).alias(v) for v in VERDICTS]
    return parsed.select(
        *[c for c in parsed.columns if c not in (*VERDICTS, "reason", "error", "failure_stage")], *cols,
        F.when(failed, NOT_JUDGED).when(passed, PASSED).otherwise(F.col("reason")).alias("reason"),
        F.when(failed, F.concat(F.lit(PIPELINE), "trace_error")).when(~passed, F.col("error")).alias("error"),
        F.when(failed, "pipeline").when(~passed, F.col("failure_stage")).alias("failure_stage"),
    )


def judge_prompt() -> Column:
    """The judge's input for columns question_id, question, answerable, expected_answer, source_files, answer, context."""
    # fixed values: the labels of the parts and what stands for missing ones
    files = F.when(F.size("source_files") > 0, F.array_join("source_files", ", ")).otherwise(F.lit("none"))
    filled = lambda c, empty: F.when(F.coalesce(c, F.lit("")) == "", F.lit(empty)).otherwise(F.col(c))
    return F.concat(
        F.lit("Question ID: "), "question_id", F.lit("\nQuestion: "), F.coalesce("question", F.lit("")),
        F.lit("\nAnswerable: "), F.when(F.col("answerable"), "True").otherwise("False"), F.lit("\nGold answer: "), F.coalesce("expected_answer", F.lit("")),
        F.lit("\nExpected source files: "), files, F.lit("\n\nGenerated answer:\n"), filled("answer", "(no answer)"),
        F.lit("\n\nRetrieved context:\n"), filled("context", "(no context)"),
    )


def milliseconds(nanoseconds: Column) -> Column:
    """Whole milliseconds, halves to even; null for what is no number."""
    return F.bround(nanoseconds / 1_000_000, 0).cast("long")
