"""Consensus of several annotators' labels.

Every annotator has, per label, a confusion matrix: how often the annotator says true or false when the truth is true or
false. Expectation-maximisation alternates between the posterior of each item's truth and the matrices, from the majority
as a start. Matrices are smoothed towards the matrix of all annotators of the label, so that an annotator with a handful of
votes is judged like an average one. Chance-corrected agreement (Krippendorff's alpha for two categories, with any number
of votes per item) is reported separately and does not enter the consensus.

An item's votes are at most one per annotator. Items with the same votes are one pattern with a count, and the iterations
run over patterns, which no item identifier enters. In a round every task adds up what its patterns expect, with arrays of
the matrices, and one row per label and annotator reaches the driver. Beyond ``MOST_ANNOTATORS`` the matrices stay a table
that the votes are joined with; both ways give the same result.

Defined results
* rows with an error, a null item or a null annotator are no votes; of one annotator and item the latest judged_at counts
  (null is earliest; then the greatest judgement_id; repeated rows once); a null label is no vote;
* an item without votes for a label has no row for it; a posterior of exactly one half is false;
* empty input: empty output. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioforge.session import cut

#: The matrices of at most this many annotators are held by the driver between rounds; more are a table.
MOST_ANNOTATORS = 5_000
#: No probability comes closer to 0 or 1.
EDGE = 1e-4
#: The labels of a judgement that are consolidated.
LABELS = ("correct", "citation_supported", "proper_refusal")


def votes_of(judgements: DataFrame, labels: tuple[str, ...] = LABELS, item: str = "trace_id") -> DataFrame:
    """item, label, annotator, vote: what counts, one row per vote."""
    rows = judgements.filter(F.col("error").isNull() & F.col(item).isNotNull() & F.col("annotator").isNotNull())
    latest = rows.groupBy(F.col(item).alias("item"), "annotator").agg(
        F.max_by(F.struct(*(F.col(x) for x in labels)), F.struct("judged_at", "judgement_id")).alias("v")
    )
    stacked = F.explode(F.array(*(F.struct(F.lit(x).alias("label"), F.col("v")[x].alias("vote")) for x in labels)))
    return latest.select("item", "annotator", stacked.alias("e")).select("item", "e.label", "annotator", "e.vote").filter("vote is not null")


def annotator_codes(votes: DataFrame) -> list[str] | None:
    """The annotators in order, or None if there are more than MOST_ANNOTATORS."""
    names = votes.select("annotator").distinct().limit(MOST_ANNOTATORS + 1).collect()
    return sorted(r["annotator"] for r in names) if len(names) <= MOST_ANNOTATORS else None


def patterns_of(votes: DataFrame, names: list[str]) -> DataFrame:
    """item, label, signs: the item's votes as a sorted array of 2 * code + vote, no longer than the number of annotators."""
    codes = votes.sparkSession.createDataFrame(list(enumerate(names)), "code int, annotator string")
    coded = votes.join(F.broadcast(codes), "annotator")  # at most MOST_ANNOTATORS rows
    return coded.groupBy("item", "label").agg(F.array_sort(F.collect_set(2 * F.col("code") + F.col("vote").cast("int"))).alias("signs"))


def fit(votes: DataFrame, smoothing: float = 4.0, rounds: int = 60, tolerance: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """(items with posteriors, annotators with matrices)."""
    names = annotator_codes(votes)
    return _fit_table(votes, smoothing, rounds, tolerance) if names is None else _fit_arrays(votes, names, smoothing, rounds, tolerance)


class _Odds:
    """Log odds by label: of the prior, and of every sign. Without them the posterior is the share of true votes."""

    def __init__(self, labels: list[str], matrices: np.ndarray | None = None, prior: np.ndarray | None = None):
        self.labels = {x: i for i, x in enumerate(labels)}
        self.given = matrices is not None
        if self.given:
            sens, spec = matrices[:, :, 0], matrices[:, :, 1]
            self.prior = np.log(prior / (1 - prior))
            self.signs = np.stack([np.log((1 - sens) / spec), np.log(sens / (1 - spec))], axis=2).reshape(len(labels), -1)

    def posterior(self, label: np.ndarray, owner: np.ndarray, sign: np.ndarray) -> np.ndarray:
        """One value per row; ``owner`` is the row of each sign."""
        n = len(label)
        if not self.given:
            return np.bincount(owner, sign % 2, n) / np.maximum(np.bincount(owner, minlength=n), 1)
        total = self.prior[label] + np.bincount(owner, self.signs[label[owner], sign], n)
        return 1 / (1 + np.exp(-np.clip(total, -700, 700)))


def _flat(batch: pa.RecordBatch, odds: _Odds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label of each row, row of each sign, signs)."""
    label = np.array([odds.labels[x] for x in batch.column("label").to_pylist()], np.int64)
    signs = batch.column("signs")
    return label, np.repeat(np.arange(len(label)), np.diff(signs.offsets.to_numpy())), signs.flatten().to_numpy()


def _fit_arrays(votes: DataFrame, names: list[str], smoothing: float, rounds: int, tolerance: float) -> tuple[DataFrame, DataFrame]:
    spark = votes.sparkSession
    items = cut(patterns_of(votes, names))
    groups = cut(items.groupBy("label", "signs").agg(F.count(F.lit(1)).alias("n")))
    labels = sorted(r["label"] for r in groups.select("label").distinct().collect())  # the labels of a judgement, as named to votes_of
    odds = _Odds(labels)
    matrices = np.full((len(labels), len(names), 2), 9.0)
    voted = np.zeros((len(labels), len(names)), bool)

    def expected(bc):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            o = bc.value
            size = len(o.labels) * len(names)
            sums = np.zeros((4, size))
            share = np.zeros((2, len(o.labels)))
            seen = False
            for batch in batches:
                seen = seen or batch.num_rows > 0
                label, owner, sign = _flat(batch, o)
                n = batch.column("n").to_numpy().astype(float)
                p = o.posterior(label, owner, sign)
                share += np.bincount(label, n * p, len(o.labels)), np.bincount(label, n, len(o.labels))
                at, w, true = label[owner] * len(names) + sign // 2, n[owner], sign % 2
                pos, neg = w * p[owner], w * (1 - p[owner])
                sums += [np.bincount(at, x, size) for x in (pos, neg, pos * true, neg * (1 - true))]
            if seen:
                at = np.flatnonzero(sums[0] + sums[1])
                of = at // len(names)
                first = np.r_[True, of[1:] != of[:-1]]  # a label's share travels with its first annotator
                table = [of, at % len(names), *(s[at] for s in sums), *(np.where(first, s[of], 0.0) for s in share)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in table], names=["label", "code", "pos", "neg", "tp", "tn", "share", "all"])

        return work

    schema = "label long, code long, pos double, neg double, tp double, tn double, share double, all double"
    for _ in range(rounds if labels else 0):
        bc = spark.sparkContext.broadcast(odds)  # labels * annotators, at most MOST_ANNOTATORS
        rows = groups.mapInArrow(expected(bc), schema).groupBy("label", "code").agg(*(F.sum(c).alias(c) for c in ("pos", "neg", "tp", "tn", "share", "all"))).collect()
        sums = np.zeros((6, len(labels), len(names)))
        for r in rows:  # one per label and annotator
            sums[:, r["label"], r["code"]] = r[2:]
        pos, neg, tp, tn, share, every = sums
        voted = pos + neg > 0
        part = lambda hit, of: (hit + smoothing * ((hit.sum(axis=1) + 1) / (of.sum(axis=1) + 2))[:, None]) / (of + smoothing)
        new = np.clip(np.stack([part(tp, pos), part(tn, neg)], axis=2), EDGE, 1 - EDGE)
        prior = np.clip(share.sum(axis=1) / every.sum(axis=1), EDGE, 1 - EDGE)
        moved = np.abs(new - matrices)[voted].max()
        matrices, odds = new, _Odds(labels, new, prior)
        if moved < tolerance:
            break

    bc = spark.sparkContext.broadcast(odds)  # as above

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = bc.value.posterior(*_flat(batch, bc.value))
            yield batch.append_column("posterior", pa.array(p, pa.float64()))

    table = [(labels[i], names[j], float(matrices[i, j, 0]), float(matrices[i, j, 1])) for i, j in zip(*np.nonzero(voted))]
    kind = items.schema["item"].dataType.simpleString()
    return items.mapInArrow(judged, f"item {kind}, label string, signs array<int>, posterior double"), spark.createDataFrame(table, "label string, annotator string, sensitivity double, specificity double")


def _fit_table(votes: DataFrame, smoothing: float, rounds: int, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """The same with the matrices as a table, for any number of annotators; only labels and the greatest change reach the driver."""
    votes = cut(votes.select("item", "label", "annotator", F.col("vote").cast("double").alias("v")).distinct())
    items = cut(votes.groupBy("item", "label").agg(F.avg("v").alias("posterior")))
    matrices = None
    for _ in range(rounds):
        share = items.groupBy("label").agg(F.avg("posterior").alias("share"))
        p, v = F.col("posterior"), F.col("v")
        sums = cut(
            votes.join(items, ["item", "label"]).groupBy("label", "annotator")
            .agg(F.sum(p).alias("pos"), F.sum(1 - p).alias("neg"), F.sum(p * v).alias("tp"), F.sum((1 - p) * (1 - v)).alias("tn"))
        )
        pooled = sums.groupBy("label").agg(((F.sum("tp") + 1) / (F.sum("pos") + 2)).alias("sens"), ((F.sum("tn") + 1) / (F.sum("neg") + 2)).alias("spec")).join(share, "label")
        inside = lambda c: F.greatest(F.least(c, F.lit(1 - EDGE)), F.lit(EDGE))
        new = cut(sums.join(F.broadcast(pooled), "label").select(  # one row per label
            "label", "annotator", inside((F.col("tp") + smoothing * F.col("sens")) / (F.col("pos") + smoothing)).alias("a"),
            inside((F.col("tn") + smoothing * F.col("spec")) / (F.col("neg") + smoothing)).alias("b"), inside(F.col("share")).alias("prior"),
        ))
        moved = 1.0
        if matrices is not None:
            old = matrices.select("label", "annotator", F.col("a").alias("a0"), F.col("b").alias("b0"))
            moved = new.join(old, ["label", "annotator"]).agg(F.max(F.greatest(F.abs(F.col("a") - F.col("a0")), F.abs(F.col("b") - F.col("b0"))))).head()[0] or 0.0
        matrices = new
        weight = F.when(F.col("v") == 1, F.log(F.col("a") / (1 - F.col("b")))).otherwise(F.log((1 - F.col("a")) / F.col("b")))
        total = F.first(F.log(F.col("prior") / (1 - F.col("prior")))) + F.sum(weight)
        items = cut(votes.join(matrices, ["label", "annotator"]).groupBy("item", "label").agg((1 / (1 + F.exp(-total))).alias("posterior")))
        if moved < tolerance:
            break
    return items, matrices.select("label", "annotator", F.col("a").alias("sensitivity"), F.col("b").alias("specificity"))


def agreement(votes: DataFrame) -> DataFrame:
    """Per label: items, votes, observed agreement and Krippendorff's alpha over items with at least two votes."""
    per_item = votes.groupBy("label", "item").agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("vote").cast("long")).alias("t")).filter("m > 1")
    # pairs of unlike votes within items against all pairs
    sums = per_item.groupBy("label").agg(
        F.count(F.lit(1)).alias("items"), F.sum("m").alias("votes"), F.sum("t").alias("yes"),
        F.sum(2 * F.col("t") * (F.col("m") - F.col("t")) / (F.col("m") - 1)).alias("unlike"),
    )
    no = F.col("votes") - F.col("yes")
    expected = 2 * F.col("yes") * no / (F.col("votes") - 1)
    return sums.select(
        "label", "items", "votes", (1 - F.col("unlike") / F.col("votes")).alias("observed"),
        F.when(expected > 0, 1 - F.col("unlike") / expected).otherwise(F.lit(1.0)).alias("alpha"),
    )
