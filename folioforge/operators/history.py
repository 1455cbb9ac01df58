"""History of changing entity attributes: a bitemporal ledger.

A ledger row says: the entity had ``state`` during [valid_from, valid_to), and the ledger held that belief during
[recorded_from, recorded_to). Nothing is overwritten. An update that arrives late and overlaps earlier rows closes
their belief (recorded_to), re-enters what remains of them left and right of itself and adds its own row: a sweep
along recorded time with the currently believed intervals ordered by valid time.

The sweep of one entity is cut into slices of valid time which are swept independently and stitched together
afterwards, so that an entity with very many updates spreads over many tasks.

Defined results
* null entity: such updates describe nothing and are left out; null state is a state ("known to hold nothing");
* null valid_from or recorded_at, or valid_to <= valid_from: the update covers nothing and is left out;
* null valid_to: open;
* several updates of one entity recorded at the same instant: the greater ``tie`` (then state) wins the overlap;
* repeated rows: an update that repeats what is already believed adds nothing;
* empty input: empty ledger. Extra columns of the input are ignored whatever their names.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from folioforge.operators.groups import BROADCAST_ROWS

#: Width of a slice of valid time in days. Longer intervals are cut at slice borders and stitched together again.
SLICE_DAYS = 364
#: The day after the last that a date can have; stands for an open end inside the sweep.
OPEN = 2_932_897

LEDGER_SCHEMA = "entity string, state string, valid_from date, valid_to date, recorded_from timestamp_ntz, recorded_to timestamp_ntz"


def canonical_map(m: Column) -> Column:
    """A map's entries as one string: values trimmed, blank or null ones left out, keys in order. Null for a null map counts as empty."""
    white = r"(?U)^\s+|\s+$"
    pairs = F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("k"), F.regexp_replace(e["value"], white, "").alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda e: e["v"].isNotNull() & (e["v"] != "")))
    return F.coalesce(F.to_json(kept), F.lit("[]"))


def canonical_text(c: Column) -> Column:
    """The text without surrounding white space; null if nothing remains."""
    t = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.when(t != "", t)


def snapshot_calendar(snapshots: DataFrame, date: str = "snapshot_date") -> DataFrame:
    """Every snapshot date with the next one (null after the last). As many rows as there are days with snapshots."""
    days = snapshots.select(F.col(date).alias("valid_from")).na.drop().distinct()
    return days.withColumn("valid_to", F.lead("valid_from").over(Window.orderBy("valid_from")))


def updates_from_snapshots(snapshots: DataFrame, entity: str, state: Column, date: str = "snapshot_date", captured: str = "captured_at") -> DataFrame:
    """One update per distinct capture: it states the entity's attributes from its snapshot to the next one of the whole table.

    Repeated captures with the same state are merged map-side before anything is shuffled.
    """
    seen = (
        snapshots.select(F.col(entity).alias("entity"), F.col(date).alias("valid_from"), F.col(captured).alias("recorded_at"), state.alias("state"))
        .filter("entity is not null and valid_from is not null")
        .withColumn("recorded_at", F.coalesce("recorded_at", F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")))
        .distinct()
    )
    calendar = snapshot_calendar(snapshots, date)
    # days are bounded by the calendar; the size is checked all the same
    if calendar.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        calendar = F.broadcast(calendar)
    return seen.join(calendar, "valid_from").select("entity", "state", "valid_from", "valid_to", "recorded_at")


def sweep(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sweep each (entity, slice), whose updates come in order of recording. Carries only the slice that is open."""
    key = None
    starts: list[int] = []  # current belief, ordered by valid time: starts[i] belongs to held[i]
    held: list[tuple[int, object, int]] = []  # (end, state, recorded_from)
    out: list[tuple] = []

    def flush() -> None:
        out.extend((key[0], key[1], s, a, b, r, None) for a, (b, s, r) in zip(starts, held))
        starts.clear()
        held.clear()

    for pdf in rows:
        for entity, part, state, a, b, r in zip(pdf["entity"], pdf["part"], pdf["state"], pdf["a"], pdf["b"], pdf["r"]):
            if (entity, part) != key:
                if key is not None:
                    flush()
                key = (entity, part)
            i = bisect.bisect_right(starts, a) - 1
            if i < 0 or held[i][0] <= a:
                i += 1
            j = i
            while j < len(starts) and starts[j] < b:
                j += 1
            if j == i + 1 and starts[i] <= a and held[i][0] >= b and held[i][1] == state:
                continue  # already believed
            left = right = None
            for k in range(i, j):
                x, (y, s, q) = starts[k], held[k]
                if q != r:  # beliefs replaced at the instant they were recorded were never held
                    out.append((entity, part, s, x, y, q, r))
                if x < a:
                    left = (x, (a, s, r))
                if y > b:
                    right = (b, (y, s, r))
            new = [v for v in (left, (a, (b, state, r)), right) if v]
            starts[i:j] = [x for x, _ in new]
            held[i:j] = [v for _, v in new]
        if len(out) > 20_000:
            yield pd.DataFrame(out, columns=["entity", "part", "state", "a", "b", "q", "z"]).astype({"z": "Int64"})
            out = []
    if key is not None:
        flush()
    yield pd.DataFrame(out, columns=["entity", "part", "state", "a", "b", "q", "z"]).astype({"z": "Int64"})


def bitemporal_ledger(updates: DataFrame, slice_days: int = SLICE_DAYS, last_day: int | None = None) -> DataFrame:
    """The ledger of all updates(entity, state, valid_from, valid_to, recorded_at[, tie]).

    last_day: the last day (since 1970) that any update names, if the caller knows it; else one more pass finds it.
    """
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))
    tie = F.col("tie").cast("string") if "tie" in updates.columns else F.lit(None).cast("string")
    u = updates.select(
        "entity", "state", day("valid_from").alias("a"), F.coalesce(day("valid_to"), F.lit(OPEN)).alias("b"),
        F.unix_micros(F.col("recorded_at").cast("timestamp_ntz").cast("timestamp")).alias("r"), tie.alias("tie"),
    ).filter("entity is not null and a is not null and r is not null and b > a")
    # an open interval is cut at the borders up to the last known day only; its last slice keeps the open end
    last = u.agg(F.max(F.greatest("a", F.when(F.col("b") < OPEN, F.col("b")).otherwise(F.col("a"))))).head()[0] if last_day is None else last_day
    last = 0 if last is None else last
    top = last // slice_days
    part_of = lambda c: F.least(F.floor(c / slice_days), F.lit(top)).cast("long")
    sliced = (
        u.withColumn("part", F.explode(F.sequence(part_of(F.col("a")), part_of(F.col("b") - 1))))
        .withColumn("a", F.greatest(F.col("a"), F.when(F.col("part") == part_of(F.col("a")), F.col("a")).otherwise(F.col("part") * slice_days)).cast("int"))
        .withColumn("b", F.when(F.col("part") == top, F.col("b")).otherwise(F.least(F.col("b"), (F.col("part") + 1) * slice_days)).cast("int"))
    )
    swept = (
        sliced.repartition("entity", "part")
        .sortWithinPartitions("entity", "part", "r", "tie", F.col("state"), "a")
        .select("entity", "part", "state", "a", "b", "r")
        .mapInPandas(sweep, "entity string, part long, state string, a int, b int, q long, z long")
    )
    # stitch pieces of one belief that only a slice border separates
    same = ["entity", "state", "q", "z"]
    w = Window.partitionBy(*same).orderBy("a")
    run = F.sum(F.when(F.lag("b").over(w) == F.col("a"), 0).otherwise(1)).over(w)
    whole = swept.withColumn("run", run).groupBy(*same, "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    date = lambda c: F.date_from_unix_date(F.col(c))
    ntz = lambda c: F.timestamp_micros(F.col(c)).cast("timestamp_ntz")
    return whole.select(
        "entity", "state", date("a").alias("valid_from"), F.when(F.col("b") < OPEN, date("b")).alias("valid_to"),
        ntz("q").alias("recorded_from"), ntz("z").alias("recorded_to"),
    )


def ledger_as_updates(ledger: DataFrame) -> DataFrame:
    """What an existing ledger believes now, as updates to be swept together with newer ones."""
    return ledger.filter("recorded_to is null").select("entity", "state", "valid_from", "valid_to", F.col("recorded_from").alias("recorded_at"))


def apply_updates(ledger: DataFrame, updates: DataFrame, slice_days: int = SLICE_DAYS) -> DataFrame:
    """The ledger after newer updates: closed rows stay as they are, current ones and the updates are swept again.

    The updates must be recorded after everything in the ledger, as with any append.
    """
    cols = ["entity", "state", "valid_from", "valid_to", "recorded_at"]
    swept = bitemporal_ledger(ledger_as_updates(ledger).unionByName(updates.select(*cols)), slice_days)
    return ledger.filter("recorded_to is not null").select(*swept.columns).unionByName(swept)


def current_versions(ledger: DataFrame) -> DataFrame:
    """The periods of unchanged state in what is believed now: touching rows of equal state become one.

    After the sweep an entity has at most one current row for each day, so a period's rows are few.
    """
    w = Window.partitionBy("entity").orderBy("valid_from")
    starts = F.when((F.lag("valid_to").over(w) == F.col("valid_from")) & F.lag("state").over(w).eqNullSafe(F.col("state")), 0).otherwise(1)
    return (
        ledger.filter("recorded_to is null")
        .withColumn("_new", starts)
        .withColumn("version_no", F.sum("_new").over(w))
        .groupBy("entity", "version_no")
        .agg(F.min("valid_from").alias("valid_from"), F.max(F.struct("valid_from", "valid_to"))["valid_to"].alias("valid_to"), F.first("state").alias("state"))
    )


def last_snapshot(snapshots: DataFrame, date: str = "snapshot_date") -> int:
    """The last snapshot's day since 1970 (0 without snapshots), from that one column."""
    return snapshots.agg(F.coalesce(F.max(F.unix_date(date)), F.lit(0))).head()[0]


def metadata_updates(snapshots: DataFrame, digest: bool = False) -> DataFrame:
    """Updates of metadata_snapshots: the state is document_id, version and the metadata entries, canonically.

    With ``digest`` the state is its 128-bit digest, which is enough where states are only compared and is a tenth of the bytes to shuffle.
    """
    state = F.to_json(F.struct(canonical_text(F.col("document_id")).alias("d"), canonical_text(F.col("version")).alias("v"), canonical_map(F.col("metadata")).alias("m")))
    return updates_from_snapshots(snapshots, "source_path", F.md5(state) if digest else state)
