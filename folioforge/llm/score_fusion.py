"""One ranking from several differently scaled scores.

Each list (the candidates that one retriever returned for one question) is standardised robustly: distance from the
median in units of 1.4826 median absolute deviations, turned so that greater is better. A logistic squash maps it into
(0, 1), so that an outlier counts as "very good" and not in proportion to its size. The fused score of a candidate is the
weighted geometric mean of its bounded values over all lists of the question; a list without the candidate contributes
``absent`` times that list's least value.

Defined results
* several rows of one question, retriever and chunk: the one with the latest retrieved_at counts (null is earliest), then
  the greatest passage_id; repeated rows so count once;
* null and NaN are no scores; infinite scores are kept and squash to the bounds;
* rows with a null question, retriever or chunk name no candidate and are left out;
* a list whose scores are all equal has deviation 0: every value is 0.5; with a median deviation of 0 and unequal scores the
  mean absolute deviation (times 1.2533) is the unit;
* a retriever that ``retrievers`` does not know, or with a null direction, counts as higher is better; weights default to 1;
* ties of the fused score are broken by chunk id; an empty table gives an empty ranking;
* extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from folioforge.operators.groups import HOT_ROWS, row_numbers, small_or_plain, split_hot
from folioforge.session import cut

LIST = ["question_id", "retriever"]
#: Bounded values stay this far from 0 and 1, so that their logarithm is finite.
EDGE = 1e-9


def latest_scores(passages: DataFrame, retrievers: DataFrame, grouped: bool) -> DataFrame:
    """question_id, retriever, chunk_id, s: the scores that count, turned so that greater is better."""
    rows = passages.select("question_id", "retriever", "chunk_id", F.col("score").cast("double").alias("score"), F.struct("retrieved_at", "passage_id").alias("at"))
    rows = rows.filter("question_id is not null and retriever is not null and chunk_id is not null")
    if grouped:  # everything below then works inside one partitioning by question
        rows = rows.repartition("question_id")
    latest = rows.groupBy(*LIST, "chunk_id").agg(F.max_by("score", "at").alias("score")).filter("score is not null and not isnan(score)")
    side = small_or_plain(retrievers.filter("retriever is not null").groupBy("retriever").agg(F.max("higher_is_better").alias("higher")))
    return latest.join(side, "retriever", "left").select(*LIST, "chunk_id", F.when(F.coalesce("higher", F.lit(True)), F.col("score")).otherwise(-F.col("score")).alias("s"))


def _squash(dev: Column, mad: Column, mean_dev: Column, steep: float) -> Column:
    unit = F.when(mad > 0, 1.4826 * mad).when(mean_dev > 0, 1.2533 * mean_dev)
    z = F.when(dev == 0, 0.0).otherwise(dev / unit)
    z = F.when(z.isNull() | F.isnan(z), F.signum(dev) * 1e3).otherwise(z)
    return F.greatest(F.least(1 / (1 + F.exp(-steep * F.greatest(F.least(z, F.lit(700.0)), F.lit(-700.0)))), F.lit(1 - EDGE)), F.lit(EDGE))


def _standing() -> Column:
    """By what a candidate stands in its list: the bounded value; the score tells only those apart that the squash rounds together."""
    return F.struct("b", "s")


def _centred(s: Column, med: Column) -> Column:
    return F.when(s == med, 0.0).otherwise(s - med)


def _values_by_window(scores: DataFrame, steep: float) -> DataFrame:
    """Adds the bounded values and the list's best standings by windows; for questions that fit a task."""
    w = Window.partitionBy(*LIST)
    top = lambda k: F.max(F.when(F.col("rn") == k, F.col("standing"))).over(w)
    return (
        scores.withColumn("med", F.median("s").over(w))
        .withColumn("dev", _centred(F.col("s"), F.col("med")))
        .withColumn("mad", F.median(F.abs("dev")).over(w))
        .withColumn("mean_dev", F.avg(F.abs("dev")).over(w))
        .withColumn("b", _squash(F.col("dev"), F.col("mad"), F.col("mean_dev"), steep))
        .withColumn("standing", _standing())
        .withColumn("rn", F.row_number().over(w.orderBy(F.col("standing").desc(), "chunk_id")))
        .withColumn("t1", top(1)).withColumn("t2", top(2)).withColumn("t3", top(3))
        .withColumn("least", F.min("b").over(w))
        .withColumn("first", F.col("rn") == 1)
    )


def _values_spread(scores: DataFrame, steep: float, hot_rows: int) -> DataFrame:
    """The same columns for questions of any size: medians from a spread ranking, statistics by partial aggregation."""
    middle = lambda v: F.avg(F.when(F.col("k").isin(0, 1) & ((F.col("n") % 2 == 0) | (F.col("k") == 0)), F.col(v)))

    def stats(df: DataFrame, value: str, rn: str) -> DataFrame:
        n = small_or_plain(df.groupBy(*LIST).agg(F.count(F.lit(1)).alias("n")))
        placed = df.join(n, LIST).withColumn("k", F.col(rn) - F.floor((F.col("n") + 1) / 2))
        return placed.groupBy(*LIST).agg(middle(value).alias("mid"), F.avg(value).alias("mean"))

    ranked = row_numbers(scores, LIST, [F.col("s").desc(), F.col("chunk_id")], "rn", hot_rows)
    with_med = ranked.join(small_or_plain(stats(ranked, "s", "rn").withColumnRenamed("mid", "med").drop("mean")), LIST).withColumn("dev", _centred(F.col("s"), F.col("med")))
    by_dev = row_numbers(with_med.withColumn("ad", F.abs("dev")), LIST, [F.col("ad"), F.col("chunk_id")], "rd", hot_rows)
    dev = stats(by_dev, "ad", "rd").select(*LIST, F.col("mid").alias("mad"), F.col("mean").alias("mean_dev"))
    valued = with_med.join(small_or_plain(dev), LIST).withColumn("b", _squash(F.col("dev"), F.col("mad"), F.col("mean_dev"), steep))
    valued = valued.withColumn("standing", _standing())  # in the order of the scores, so the ranks above are those of the standings
    ends = valued.groupBy(*LIST).agg(F.min("b").alias("least"), *(F.max(F.when(F.col("rn") == k, F.col("standing"))).alias(f"t{k}") for k in (1, 2, 3)))
    return valued.join(small_or_plain(ends), LIST).withColumn("first", F.col("rn") == 1)


def _fuse(values: DataFrame, weights: dict[str, float] | None, absent: float, windowed: bool) -> DataFrame:
    """question_id, chunk_id, fused and in how many lists the candidate is, leads, or almost leads."""
    w = F.lit(1.0)
    if weights:
        for name, weight in weights.items():
            w = F.when(F.col("retriever") == name, float(weight)).otherwise(w)
    v = values.withColumn("w", w).withColumn("floor", F.log(F.col("least") * absent))
    alone = F.col("t2").isNull() | (F.col("t2") < F.col("t1"))
    v = v.withColumn("leads", ((F.col("standing") == F.col("t1")) & alone).cast("int")).withColumn("near", (F.col("t3").isNull() | (F.col("standing") > F.col("t3"))).cast("int"))
    per_list = [
        F.sum(F.when(F.col("first"), F.col("w"))).alias("all_w"),
        F.sum(F.when(F.col("first"), F.col("w") * F.col("floor"))).alias("all_floor"),
        F.sum(F.when(F.col("first"), 1)).alias("n_lists"),
    ]
    summed = v.groupBy("question_id", "chunk_id").agg(
        F.sum(F.col("w") * (F.log("b") - F.col("floor"))).alias("gain"), F.count(F.lit(1)).alias("in_lists"), F.sum("leads").alias("leads"), F.sum("near").alias("near"), *per_list
    )
    totals = {"all_w": "all_w", "all_floor": "all_floor", "n_lists": "n_lists"}
    if windowed:
        q = Window.partitionBy("question_id")
        for c in totals:
            summed = summed.withColumn(c, F.sum(c).over(q))
        summed = summed.withColumn("n_candidates", F.count(F.lit(1)).over(q))
    else:
        per_q = summed.groupBy("question_id").agg(*(F.sum(c).alias(c) for c in totals), F.count(F.lit(1)).alias("n_candidates"))
        summed = summed.drop(*totals).join(small_or_plain(per_q), "question_id")
    return summed.select(
        # rounded in its logarithm, so that ranks do not hang on the order in which the lists are summed
        "question_id", "chunk_id", F.exp(F.round((F.col("gain") + F.col("all_floor")) / F.col("all_w"), 10)).alias("fused"),
        "in_lists", "n_lists", "n_candidates", "leads", "near",
    )


def fuse_scores(
    passages: DataFrame, retrievers: DataFrame, weights: dict[str, float] | None = None, steep: float = 1.0, absent: float = 0.5, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Per question the candidates with rank and fused score, and how they stand in the lists.

    ``leads``: lists in which the candidate's bounded value is strictly best; ``near``: lists in which at most one other is as good;
    ``second``: the second greatest fused score of the question, null for a single candidate.
    """
    keyed = passages.filter("question_id is not null")
    plain, hot = split_hot(keyed, ["question_id"], hot_rows)
    order = [F.col("fused").desc(), F.col("chunk_id")]
    fused = _fuse(_values_by_window(latest_scores(plain, retrievers, True), steep), weights, absent, True)
    out = fused.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(*order)).cast("long"))
    runner_up = F.max(F.when(F.col("rank") == 2, F.col("fused")))
    out = out.withColumn("second", runner_up.over(Window.partitionBy("question_id")))
    if hot is None:
        return out
    spread = _fuse(_values_spread(latest_scores(hot, retrievers, False), steep, hot_rows), weights, absent, False)
    ranked = cut(row_numbers(spread, ["question_id"], order, "rank", hot_rows))  # read again for the second best
    best = small_or_plain(ranked.groupBy("question_id").agg(runner_up.alias("second")))
    return out.unionByName(ranked.join(best, "question_id"))


def leads_almost_everywhere(fused: DataFrame) -> DataFrame:
    """Candidates in every list of a question with at least three lists and two candidates, strictly best in all but at most one, and there second at worst.

    Only the candidate ahead of it in the one list can have a greater fused score, since bounded values follow the order of
    each list and absence costs more than any value (weights not negative, ``absent`` at most 1). So the candidates are those
    that the fusion puts first or second, ties included; how their bounded values stand in the lists is then checked exactly.
    """
    leading = fused.filter(F.col("fused") >= F.col("second") * (1 - 1e-9))
    return leading.filter("n_lists >= 3 and n_candidates >= 2 and in_lists = n_lists and leads >= n_lists - 1 and near = n_lists").select("question_id", "chunk_id")
