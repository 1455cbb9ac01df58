"""Evaluation of rankings, answers and verdicts. Lists of one question are arrays and stay in their row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from folioforge.operators.answers import REFUSAL, VERDICTS, cited_chunks, cited_labels

NONE = "array<string>"


class Incomplete(ValueError):
    """Questions without a trace."""


def require_traces(questions: DataFrame, traces: DataFrame) -> None:
    """Error naming (some of) the questions that have no trace."""
    missing = questions.select(F.col("id").alias("question_id")).join(traces.select("question_id"), "question_id", "left_anti").limit(20).collect()
    if missing:
        raise Incomplete("Missing answer traces for: " + ", ".join(sorted(str(r["question_id"]) for r in missing)))


def ranked_sources(chunks: Column) -> Column:
    """The documents behind array<struct<source_path, rank, …>>, each at its best rank, in order."""
    pairs = F.array_sort(F.transform(F.coalesce(chunks, F.array().cast("array<struct<chunk_id:string,source_path:string,rank:int,score:double>>")), lambda c: F.struct(c["rank"].alias("rank"), c["source_path"].alias("source_path"))))
    return F.array_distinct(F.transform(pairs, lambda p: p["source_path"]))


def retrieval_metrics(pairs: DataFrame, k: int = 5) -> DataFrame:
    """precision_at_k, recall_at_k, reciprocal_rank, ndcg_at_k for pairs(answerable, source_files, retrieved_chunks).

    Null for unanswerable questions; recall and nDCG also for answerable ones that list no source.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    wanted = F.array_distinct(F.coalesce("source_files", F.array().cast(NONE)))
    top = F.slice(ranked_sources(F.col("retrieved_chunks")), 1, k)
    hits = F.filter(F.transform(top, lambda s, i: F.when(F.array_contains(wanted, s), i + 1)), lambda r: r.isNotNull())
    gain = lambda ranks: F.aggregate(ranks, F.lit(0.0), lambda a, r: a + 1 / F.log2(r.cast("double") + 1))
    ideal_n = F.least(F.lit(k), F.size(wanted))
    ideal = gain(F.slice(F.sequence(F.lit(1), F.lit(k)), F.lit(1), ideal_n))
    ok, some = F.col("answerable"), F.size(wanted) > 0
    return (
        pairs.withColumn("_hits", hits)
        .withColumn("precision_at_k", F.when(ok, F.size("_hits") / F.lit(k)))
        .withColumn("recall_at_k", F.when(ok & some, F.size("_hits") / F.size(wanted)))
        .withColumn("reciprocal_rank", F.when(ok, F.when(F.size("_hits") > 0, 1 / F.element_at("_hits", 1)).otherwise(0.0)))
        .withColumn("ndcg_at_k", F.when(ok & some, gain(F.col("_hits")) / ideal))
        .drop("_hits")
    )


def retrieval_summary(metrics: DataFrame) -> DataFrame:
    """Means over answerable questions; a question whose run failed counts with zeros."""
    value = lambda c: F.coalesce(F.avg(F.when(F.col("answerable"), F.coalesce(F.when(F.col("error").isNull(), F.col(c)), F.lit(0.0)))), F.lit(0.0)).alias(c)
    return metrics.agg(
        F.count(F.lit(1)).alias("question_count"), F.count_if(F.col("answerable")).alias("answerable_count"), F.count_if(F.col("error").isNotNull()).alias("error_count"),
        *(value(c) for c in ("precision_at_k", "recall_at_k", "reciprocal_rank", "ndcg_at_k")),
    )


def first_relevant(pairs: DataFrame) -> DataFrame:
    """first_relevant_rank: the least chunk rank whose document is wanted, by raw chunk ranks; null if none."""
    ranks = F.transform(F.filter("retrieved_chunks", lambda c: F.array_contains(F.col("source_files"), c["source_path"])), lambda c: c["rank"])
    return pairs.withColumn("first_relevant_rank", F.when(F.size(ranks) > 0, F.array_min(ranks)))


def concept_scorecard(pairs: DataFrame, k: int = 5) -> DataFrame:
    """Per concept of answerable questions: number, hits at 1 and k, missing, and mean reciprocal rank cut at k."""
    r = F.col("first_relevant_rank")
    return (
        first_relevant(pairs.filter("answerable"))
        .groupBy("concept")
        .agg(
            F.count(F.lit(1)).alias("questions"), F.count_if(r == 1).alias("hit_at_1"), F.count_if(r <= k).alias("hit_at_k"), F.count_if(r.isNull()).alias("missing"),
            F.avg(F.when(r <= k, 1 / r).otherwise(0.0)).alias("mrr"),
        )
    )


def format_scorecard(card: DataFrame) -> DataFrame:
    """The scorecard as padded text lines."""
    line = F.concat(F.rpad(F.coalesce("concept", F.lit("-")), 24, " "), F.format_string("%9d %9d %9d %9d %9.3f", "questions", "hit_at_1", "hit_at_k", "missing", "mrr"))
    return card.select("concept", line.alias("line"))


def answer_metrics(pairs: DataFrame) -> DataFrame:
    """Checks of pairs(source_files, answer, error, retrieved_chunks) that need no judgement of wording."""
    answer = F.coalesce("answer", F.lit(""))
    chunks = F.coalesce("retrieved_chunks", F.array().cast("array<struct<chunk_id:string,source_path:string,rank:int,score:double>>"))
    labels, ids = cited_labels(answer), cited_chunks(answer)
    ranks, known = F.transform(chunks, lambda c: c["rank"]), F.transform(chunks, lambda c: c["chunk_id"])
    cited = (F.size(labels) > 0) | (F.size(ids) > 0)
    valid = cited & F.forall(labels, lambda x: F.array_contains(ranks, x)) & F.forall(ids, lambda x: F.array_contains(known, x))
    sources = F.transform(F.filter(chunks, lambda c: F.array_contains(labels, c["rank"]) | F.array_contains(ids, c["chunk_id"])), lambda c: c["source_path"])
    wanted = F.coalesce("source_files", F.array().cast(NONE))
    fine = F.col("error").isNull()
    refused = answer == REFUSAL
    return (
        pairs.withColumn("produced_answer", (answer != "") & ~refused & fine)
        .withColumn("refused", refused & fine)
        .withColumn("citations_valid", F.coalesce(valid, F.lit(False)))
        .withColumn("cites_expected_source", F.coalesce(valid & F.arrays_overlap(sources, wanted), F.lit(False)))
        .withColumn("has_error", ~fine)
    )


def _rate(c: str, where: Column) -> Column:
    return F.coalesce(F.avg(F.when(where, F.col(c).cast("double"))), F.lit(0.0))


def answer_summary(metrics: DataFrame) -> DataFrame:
    """Rates by answerability; errors count as false."""
    ok, no = F.col("answerable"), ~F.col("answerable")
    return metrics.agg(
        F.count(F.lit(1)).alias("question_count"), F.count_if(ok).alias("answerable_question_count"), F.count_if(no).alias("unanswerable_question_count"),
        F.count_if(F.col("has_error")).alias("error_count"), _rate("produced_answer", ok).alias("answer_rate"), _rate("citations_valid", ok).alias("citation_valid_rate"),
        _rate("cites_expected_source", ok).alias("expected_source_citation_rate"), _rate("refused", no).alias("refusal_rate"),
    )


def judgement_summary(judged: DataFrame) -> DataFrame:
    """Counts, failures by stage, and rates over verdicts without error only."""
    ok, no, done = F.col("answerable"), ~F.col("answerable"), F.col("error").isNull()
    stage = lambda s: F.count_if(F.col("failure_stage") == s)
    return judged.agg(
        F.count(F.lit(1)).alias("question_count"), F.count_if(ok).alias("answerable_question_count"), F.count_if(no).alias("unanswerable_question_count"),
        (stage("pipeline") + stage("judge")).alias("error_count"), stage("pipeline").alias("pipeline_error_count"), stage("judge").alias("judge_error_count"),
        F.count_if(ok & done).alias("judged_answerable_question_count"), F.count_if(no & done).alias("judged_unanswerable_question_count"),
        _rate("correct", ok & done).alias("correctness_rate"), _rate("citation_supported", ok & done).alias("citation_supported_rate"),
        _rate("used_correct_version", ok & done).alias("correct_version_rate"), _rate("proper_refusal", no & done).alias("proper_refusal_rate"),
    )


# two sets of verdicts -------------------------------------------------------------------------------------------------
def paired(baseline: DataFrame, comparison: DataFrame, key: str = "question_id") -> DataFrame:
    """Full outer join of two sets of verdicts; ``compared`` where both have one without error."""
    side = lambda df, p: df.select(F.col(key), F.struct(*VERDICTS, "error").alias(p))
    both = side(baseline, "a").join(side(comparison, "b"), key, "full_outer")
    return both.withColumn("compared", F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("a.error").isNull() & F.col("b.error").isNull())


def by_label(both: DataFrame, key: str = "question_id", labels: tuple[str, ...] = VERDICTS) -> DataFrame:
    """key, label, a, b of the compared pairs."""
    each = F.explode(F.array(*(F.struct(F.lit(x).alias("label"), F.col(f"a.{x}").alias("a"), F.col(f"b.{x}").alias("b")) for x in labels)))
    return both.filter("compared").select(key, each.alias("e")).select(key, "e.*")


def agreement(both: DataFrame, key: str = "question_id") -> DataFrame:
    """Per label the counts of agreement, its rate and Cohen's kappa."""
    a, b = F.col("a"), F.col("b")
    counts = by_label(both, key).groupBy("label").agg(
        F.count_if(a & b).alias("both_true"), F.count_if(~a & ~b).alias("both_false"), F.count_if(a & ~b).alias("only_baseline"), F.count_if(~a & b).alias("only_comparison")
    )
    return counts.withColumn("agreement_rate", _observed()).withColumn("kappa", kappa())


def _n() -> Column:
    return F.col("both_true") + F.col("both_false") + F.col("only_baseline") + F.col("only_comparison")


def _observed() -> Column:
    return F.when(_n() > 0, (F.col("both_true") + F.col("both_false")) / _n()).otherwise(F.lit(0.0))


def kappa() -> Column:
    """Cohen's kappa of the four counts; 0 without pairs; where chance explains everything, 1 for full agreement and else 0."""
    a, b = (F.col("both_true") + F.col("only_baseline")) / _n(), (F.col("both_true") + F.col("only_comparison")) / _n()
    chance = a * b + (1 - a) * (1 - b)
    near = lambda x: F.abs(x - 1) <= 1e-9 * F.greatest(F.abs(x), F.lit(1.0))
    return F.when(_n() == 0, 0.0).when(near(chance), F.when(near(_observed()), 1.0).otherwise(0.0)).otherwise((_observed() - chance) / (1 - chance))


def disagreements(both: DataFrame, key: str = "question_id") -> DataFrame:
    return by_label(both, key).filter("a <> b")


def mcnemar(fixed: Column, broken: Column) -> Column:
    """Two-sided exact p-value for changes in both directions: twice the lesser tail of a fair coin, at most 1.

    Terms of the binomial come from their predecessors, in logarithms so that many changes do not underflow.
    """
    n, m = (fixed + broken).cast("int"), F.least(fixed, broken).cast("int")
    steps = F.when(m > 0, F.sequence(F.lit(1), m)).otherwise(F.array().cast("array<int>"))
    start = F.struct((-n * F.log(F.lit(2.0))).alias("t"), F.exp(-n * F.log(F.lit(2.0))).alias("s"))

    def add(acc: Column, i: Column) -> Column:
        t = acc["t"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))
        return F.struct(t.alias("t"), (acc["s"] + F.exp(t)).alias("s"))

    tail = F.aggregate(steps, start, add, lambda acc: acc["s"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def compare_runs(both: DataFrame, key: str = "question_id") -> DataFrame:
    """Per label the rates of two runs, how many verdicts were fixed and broken, churn and the exact McNemar p-value."""
    a, b = F.col("a"), F.col("b")
    rates = by_label(both, key).groupBy("label").agg(
        F.count(F.lit(1)).alias("compared"), F.avg(a.cast("double")).alias("baseline_rate"), F.avg(b.cast("double")).alias("comparison_rate"),
        F.count_if(~a & b).alias("fixed_count"), F.count_if(a & ~b).alias("broken_count"),
    )
    return (
        rates.withColumn("rate_change", F.col("comparison_rate") - F.col("baseline_rate"))
        .withColumn("churn", F.col("fixed_count") + F.col("broken_count"))
        .withColumn("p_value", mcnemar(F.col("fixed_count"), F.col("broken_count")))
    )


def changed(both: DataFrame, key: str = "question_id") -> DataFrame:
    """The fixed and broken verdicts themselves, one row each; lists of them would grow with the data."""
    return disagreements(both, key).select("label", key, F.when(F.col("b"), "fixed").otherwise("broken").alias("change"))


def latest_per(judgements: DataFrame, keys: list[str]) -> DataFrame:
    """Of several verdicts per key the latest; ties go to the greater judgement id."""
    w = Window.partitionBy(*keys).orderBy(F.col("judged_at").desc_nulls_last(), F.col("judgement_id").desc())
    return judgements.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
