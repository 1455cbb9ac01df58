"""Mixing sources to target weights.

Every listed source should contribute its share of the mixture's size, measured in tokens, but no text may appear more
than the source's cap. Capped water-filling: give every source its share of the total; clamp those that exceed cap times
their size; hand the excess to the others in proportion to their weights; repeat until nothing exceeds. If all sources are
clamped the mixture is smaller than asked for. A source that gets r times its size has every text floor(r) times, and a
seeded choice of texts once more, whose tokens do not exceed the remaining fraction and to which no further text could be
added without exceeding it.

The choice orders a source's texts by a seeded hash and takes each that still fits. The hash of the first that does not is
found by radix: the tokens per leading 12 bits of the hash are summed (map-side first, at most 4096 bins per source), then
per next 12 bits inside the bin in which the sum is reached, and so on; no source's rows are ever sorted or gathered, and one
row per source reaches the driver. From there on the same is done with the texts no longer than what remains, until none of them is left.

Defined results
* source names are compared in lower case, without surrounding white space and with "_" read as "-"; texts of a source that
  is null or not listed are left out; a listed source without texts gets nothing and its weight goes to the others;
* a target named more than once counts with the sum of its shares and its least cap; null or negative shares are 0; a null
  cap is 1;
* null and empty texts have 0 tokens; they come floor(r) times and never as part of the fraction;
* repeated rows are separate texts; texts with one document id share a hash and stand or fall together;
* empty tables give an empty mixture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from folioforge.llm.encoding import token_counts
from folioforge.operators.groups import BROADCAST_ROWS, small_or_plain
from folioforge.session import cut

DIGITS, LEVELS = 12, 5


def source_name(c: Column) -> Column:
    """A source's name in its plain form; null for a blank one."""
    t = F.translate(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), "_", "-")
    return F.when(t != "", t)


def water_fill(weights: dict[str, float], ceilings: dict[str, float], total: float) -> dict[str, float]:
    """Amounts in proportion to the weights, none above its ceiling, that add up to total if the ceilings allow."""
    amount, open_ = {}, {s: w for s, w in weights.items() if w > 0 and ceilings.get(s, 0) > 0}
    left = total
    while open_ and left > 0:
        unit = left / sum(open_.values())
        full = [s for s, w in open_.items() if w * unit >= ceilings[s]]
        if not full:
            amount |= {s: w * unit for s, w in open_.items()}
            break
        for s in full:
            amount[s] = ceilings[s]
            left -= ceilings[s]
            del open_[s]
    return {s: amount.get(s, 0.0) for s in weights}


def _targets(mix_targets: DataFrame) -> dict[str, tuple[float, int]]:
    t = mix_targets.select(source_name(F.col("source")).alias("s"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("w"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("c"))
    t = t.filter("s is not null and not isnan(w)").groupBy("s").agg(F.sum("w").alias("w"), F.min("c").alias("c"))
    rows = t.limit(BROADCAST_ROWS + 1).collect()  # a table of targets; its size is checked
    if len(rows) > BROADCAST_ROWS:
        raise ValueError("mix_targets is larger than the proven bound")
    return {r["s"]: (r["w"], r["c"]) for r in rows}


def sized_documents(documents: DataFrame, targets: dict[str, tuple[float, int]], seed: int, path: str | None) -> DataFrame:
    """doc_id, source, tokens, h, size: the texts of listed sources with their tokens, seeded hash and the tokens of all texts of that hash, checkpointed once for all passes."""
    listed = documents.sparkSession.createDataFrame([(s,) for s in sorted(targets)], "source string")
    d = documents.select("doc_id", source_name(F.col("source")).alias("source"), "text").join(F.broadcast(listed), "source", "left_semi")  # targets are checked
    sized = token_counts(d, "text", ["doc_id", "source"], path=path)
    sized = cut(sized.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 64 - DIGITS * LEVELS)))
    shared = sized.groupBy("source", "h").agg(F.sum("tokens").alias("all"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    grouped = sized.join(small_or_plain(shared), ["source", "h"], "left")
    return cut(grouped.select("doc_id", "source", "tokens", "h", F.coalesce("all", "tokens").alias("size")))


def _limits(sized: DataFrame, start: dict[str, int], want: dict[str, float]) -> dict[str, tuple[int, float, bool]]:
    """Per source, among its texts from hash start on that are no longer than the wanted amount: the hash below which their
    tokens add up to at most that amount, what is then left of it, and whether a text was in the way."""
    spark, below, left = sized.sparkSession, dict.fromkeys(want, 0), dict(want)
    stopped, settled = dict.fromkeys(want, False), set()
    for level in range(LEVELS):
        shift = DIGITS * (LEVELS - 1 - level)
        open_ = [s for s in want if not level or stopped[s] and s not in settled]  # else all that is there fits
        if not open_:
            break
        prefix = spark.createDataFrame([(s, below[s] >> (shift + DIGITS), start[s], float(want[s]), float(left[s])) for s in open_], "source string, prefix long, start long, want double, left double")
        digit = F.shiftright("h", shift)
        bins = (
            sized.filter("tokens > 0").join(F.broadcast(prefix), "source")  # one row per listed source
            .filter((F.shiftright("h", shift + DIGITS) == F.col("prefix")) & (F.col("h") >= F.col("start")) & (F.col("size") <= F.col("want")))
            .groupBy("source", "left", digit.alias("bin")).agg(F.sum("tokens").alias("t"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        )
        upto = F.sum("t").over(Window.partitionBy("source").orderBy("bin"))  # at most 4096 bins
        ends = bins.withColumn("upto", upto).groupBy("source").agg(
            F.min(F.when(F.col("upto") > F.col("left"), F.struct("bin", "lo", "hi"))).alias("stop"), F.max(F.when(F.col("upto") <= F.col("left"), F.col("upto"))).alias("used"), F.max("bin").alias("last")
        )
        found = {r["source"]: r for r in ends.collect()}  # one row per listed source
        for s in open_:
            r = found.get(s)
            stopped[s] = r is not None and r["stop"] is not None
            left[s] -= (r["used"] or 0) if r is not None else 0
            if stopped[s]:
                below[s] = r["stop"]["bin"] << shift
                if r["stop"]["lo"] == r["stop"]["hi"]:  # a single hash is left: it is the one that does not fit
                    below[s] = r["stop"]["lo"]
                    settled.add(s)
            else:
                below[s] = (1 << DIGITS if level == 0 else r["last"] + 1 if r is not None else below[s] >> shift) << shift
    return {s: (below[s], left[s], stopped[s]) for s in want}


def _spans(sized: DataFrame, want: dict[str, float]) -> dict[str, list[tuple[int, int, float]]]:
    """Per source the stretches of hashes (from, below, greatest size) whose texts are chosen. Every pass begins behind the last."""
    spans: dict[str, list] = {s: [] for s in want}
    start, open_ = dict.fromkeys(want, 0), dict(want)
    while open_:
        found = _limits(sized, start, open_)
        for s, (below, _, _) in found.items():
            spans[s].append((start[s], below, float(open_[s])))
            start[s] = below
        open_ = {s: left for s, (_, left, stopped) in found.items() if stopped and left >= 1}
    return spans


def mix(documents: DataFrame, mix_targets: DataFrame, total_tokens: int | None = None, seed: int = 17, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, tokens, repeats) of every text in the mixture, and the report per listed source.

    total_tokens: size of the mixture; by default the size of all texts of the listed sources.
    """
    spark = documents.sparkSession
    targets = _targets(mix_targets)
    sized = sized_documents(documents, targets, seed, path)
    sizes = {r["source"]: r["t"] for r in sized.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}  # one row per listed source
    total = float(sum(sizes.values()) if total_tokens is None else total_tokens)
    amount = water_fill({s: w for s, (w, _) in targets.items()}, {s: sizes.get(s, 0) * c for s, (_, c) in targets.items()}, total)
    whole, want = {}, {}
    for s in targets:
        size = sizes.get(s, 0)
        whole[s] = int(amount[s] // size) if size else 0
        rest = amount[s] - whole[s] * size
        if size and whole[s] < targets[s][1] and rest >= 1:
            want[s] = rest
    spans = _spans(sized, want)
    plan = spark.createDataFrame(
        [(s, whole[s], spans.get(s, [])) for s in sorted(targets)] or [("", 0, [])], "source string, whole int, spans array<struct<start:long,below:long,most:double>>"
    )
    extra = F.exists("spans", lambda x: (F.col("h") >= x["start"]) & (F.col("h") < x["below"]) & (F.col("size") <= x["most"]))
    chosen = (
        sized.join(F.broadcast(plan), "source")  # one row per listed source
        .withColumn("repeats", F.col("whole") + (extra & (F.col("tokens") > 0)).cast("int"))
        .select("doc_id", "source", "tokens", "repeats").filter("repeats > 0")
    )
    asked = spark.createDataFrame(
        [(s, float(targets[s][0]), int(targets[s][1]), int(sizes.get(s, 0)), float(amount[s])) for s in sorted(targets)],
        "source string, target_share double, max_repeats int, source_tokens long, planned_tokens double",
    )
    got = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("mixed_tokens"), F.max("repeats").alias("most_repeats"))
    report = asked.join(F.broadcast(got), "source", "left").na.fill(0, ["mixed_tokens", "most_repeats"])  # one row per listed source
    all_tokens = report.agg(F.sum("mixed_tokens").alias("all_tokens"))
    share = F.when(F.col("all_tokens") > 0, F.col("mixed_tokens") / F.col("all_tokens")).otherwise(F.lit(0.0))
    return chosen, report.crossJoin(F.broadcast(all_tokens)).withColumn("actual_share", share).drop("all_tokens")  # a single row
