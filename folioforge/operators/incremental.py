"""Processing only new or changed records: a ledger of work items.

Two faces of one protocol.

``plan_work_items`` replays the protocol for all runs as a DataFrame plan. A record that becomes visible at a run puts its
path into the ledger as *pending*. A run takes what is pending under a lease, with its own number as fencing token and an
expiry. The lease of a run that did not succeed runs out: at the next run the item is pending again and is leased under a
greater token. A run that succeeds commits the items whose token is still its own, and moves them to *done*. Each path's
events are folded in the order of the runs through these states; the done records are what the fold leaves behind. An item
whose state at its done run equals that of the last done run is done without work.

``WorkLedger`` is the durable form that a job uses while it runs. The items of a run are spread over units, and each unit has
a log of numbered slots in the shared folder. A slot is a small file that appears whole and only if it does not exist. Slot
n + 1 after the lease in slot n is either its commit or the next lease after it has run out, whichever is there first; so a
worker that was overtaken cannot commit, however late it wakes up, and clocks matter only for when a unit is tried again.
Every attempt writes to a path of its own, named by run, unit and token. Nothing is ever moved or deleted to publish it: the
done record names the path, and readers go by it.

Defined results
* null source_path, delivery or last_delivery: the row (run) is never visible and is left out;
* indexed_at that is no instant counts as earlier than every instant; equal instants: the later delivery, then the greater entry_id;
* digests are compared in lower case and without surrounding white space; null equals null only;
* repeated rows change nothing; empty tables give an empty ledger; a run with nothing new has no items.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.window import Window

from folioforge.operators.groups import small_or_plain
from folioforge.sources.claims import Claims

#: A lease of the replay lasts until so many runs later.
LEASE_RUNS = 1


def instant(c: Column) -> Column:
    """Microseconds of an ISO instant in any offset; an instant without offset is UTC."""
    return F.unix_micros(F.trim(c).try_cast("timestamp"))


def ordered_runs(runs: DataFrame) -> DataFrame:
    """Runs in order: run_no, pos, succeeded, upto (the newest delivery visible) and the trail.

    Visible deliveries never shrink: a run sees at least what the runs before it saw. The trail of a run are the runs that
    deal with what it enqueues: itself and those after it up to the first that succeeds. One row per run.
    """
    order = Window.orderBy("run_no")
    ok = F.coalesce(F.lower(F.trim("status")) == "succeeded", F.lit(False))
    placed = (
        runs.filter("run_no is not null and last_delivery is not null")
        .withColumn("run_no", F.col("run_no").cast("long"))
        .withColumn("succeeded", ok)
        .withColumn("pos", F.row_number().over(order).cast("long"))
        .withColumn("upto", F.max(F.col("last_delivery").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("next_ok", F.min(F.when(F.col("succeeded"), F.col("pos"))).over(order.rowsBetween(0, Window.unboundedFollowing)))
    )
    # runs with the same next success follow each other; each one's trail is the rest of its stretch
    streak = Window.partitionBy("next_ok").orderBy("pos").rowsBetween(0, Window.unboundedFollowing)
    return placed.select("run_no", "pos", "succeeded", "upto", F.collect_list(F.struct("pos", "run_no", "succeeded")).over(streak).alias("trail"))


def run_of_delivery(entries: DataFrame, runs: DataFrame) -> DataFrame:
    """delivery, pos, trail: the first run that sees each delivery. One row per delivery number that any run sees.

    Numbers of deliveries and runs are laid in one order; rows of the feed then find their run by an equi-join.
    """
    numbers = entries.select(F.col("delivery").cast("long").alias("delivery")).filter("delivery is not null").distinct()
    run = F.struct("pos", "trail")
    both = numbers.withColumn("run", F.lit(None)).unionByName(runs.select(F.col("upto").alias("delivery"), run.alias("run")))
    first = F.min_by("run", F.col("run.pos")).over(Window.orderBy("delivery").rangeBetween(0, Window.unboundedFollowing))
    found = both.withColumn("found", first).filter("run is null and found is not null")
    return found.select("delivery", F.col("found.pos").alias("seen_pos"), F.col("found.trail").alias("trail"))


_STATE = "struct<content:string,metadata:string>"
_BEST = f"struct<at:bigint,d:bigint,entry_id:bigint,state:{_STATE}>"
_RECORD = f"struct<enqueued_run:bigint,attempts:bigint,token:bigint,status:string,done_run:bigint,needs_work:boolean,state:{_STATE}>"


def _replay(events: Column, lease_runs: int) -> Column:
    """The records that a path's events (pos, run_no, succeeded, best) leave in the ledger, in order."""
    none = lambda t: F.lit(None).cast(t)
    start = F.struct(
        F.lit("idle").alias("status"), none("bigint").alias("enqueued_run"), F.lit(0).cast("bigint").alias("attempts"), none("bigint").alias("token"),
        none("bigint").alias("expires"), none(_BEST).alias("best"), none(_BEST).alias("done"), F.array().cast(f"array<{_RECORD}>").alias("records"),
    )

    def record(a: Column, status: str, token: Column, done_run: Column) -> Column:
        known = a["best"]["state"]
        work = a["done"].isNull() | ~F.coalesce(a["done"]["state"].eqNullSafe(known), F.lit(False))
        return F.struct(
            a["enqueued_run"].alias("enqueued_run"), a["attempts"].alias("attempts"), token.alias("token"), F.lit(status).alias("status"),
            done_run.alias("done_run"), work.alias("needs_work"), known.alias("state"),
        ).cast(_RECORD)

    def bound(value: Column, use: Callable[[Column], Column]) -> Column:
        """use(value) with the value computed once: it becomes the variable of a lambda."""
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def lease(a: Column, e: Column) -> Column:
        """A lease that has run out is pending again; what is new is enqueued; what is pending is leased under this run's number."""
        held = (a["status"] == "leased") & (e["pos"] < a["expires"])
        waits = ((a["status"] == "leased") & ~held) | (~held & e["best"].isNotNull())
        best = F.when(a["best"].isNull() | (e["best"] > a["best"]), F.coalesce(e["best"], a["best"])).otherwise(a["best"])
        return F.struct(
            F.when(waits, F.lit("leased")).otherwise(a["status"]).alias("status"), F.coalesce(a["enqueued_run"], F.when(e["best"].isNotNull(), e["run_no"])).alias("enqueued_run"),
            (a["attempts"] + waits.cast("bigint")).alias("attempts"), F.when(waits, e["run_no"]).otherwise(a["token"]).alias("token"),
            F.when(waits, e["pos"] + lease_runs).otherwise(a["expires"]).alias("expires"), best.alias("best"), a["done"].alias("done"), a["records"].alias("records"),
        )

    def commit(a: Column, e: Column) -> Column:
        """A run that succeeded commits what it holds under its own token, and nothing else."""
        ok = e["succeeded"] & (a["status"] == "leased") & (a["token"] == e["run_no"])
        return F.struct(
            F.when(ok, F.lit("done")).otherwise(a["status"]).alias("status"), F.when(~ok, a["enqueued_run"]).alias("enqueued_run"), F.when(ok, F.lit(0).cast("bigint")).otherwise(a["attempts"]).alias("attempts"),
            a["token"].alias("token"), F.when(~ok, a["expires"]).alias("expires"), a["best"].alias("best"), F.when(ok, a["best"]).otherwise(a["done"]).alias("done"),
            F.when(ok, F.concat(a["records"], F.array(record(a, "done", a["token"], e["run_no"])))).otherwise(a["records"]).alias("records"),
        )

    def rest(a: Column) -> Column:
        left = a["status"] == "leased"
        return F.when(left, F.concat(a["records"], F.array(record(a, "pending", none("bigint"), none("bigint"))))).otherwise(a["records"])

    return F.aggregate(events, start, lambda a, e: bound(lease(a, e), lambda held: commit(held, e)), rest)


def plan_work_items(entries: DataFrame, runs: DataFrame, lease_runs: int = LEASE_RUNS) -> DataFrame:
    """The ledger after all runs.

    One row per (source_path, done_run): enqueued_run, attempts (leases taken), token (the fencing token that
    committed), status ``done`` or, while no run has succeeded since, ``pending``, and needs_work.
    """
    digest = lambda c: F.lower(F.trim(F.col(c)))
    state = F.struct(digest("content_sha256").alias("content"), digest("metadata_sha256").alias("metadata"))
    best = F.struct(
        F.coalesce(instant(F.col("indexed_at")), F.lit(-(2**63) + 1)).alias("at"), F.col("delivery").alias("d"), F.col("entry_id").cast("long").alias("entry_id"), state.alias("state")
    )
    seen = (
        entries.filter("source_path is not null and delivery is not null")
        .withColumn("delivery", F.col("delivery").cast("long"))
        .select("source_path", "delivery", best.alias("best"))
        .join(small_or_plain(run_of_delivery(entries, ordered_runs(runs))), "delivery")
        .select("source_path", "seen_pos", "best", F.explode("trail").alias("e"))
    )
    # per path and run the latest row: combined map-side, so a path that holds a third of the rows shuffles little
    events = seen.groupBy("source_path", "e").agg(F.max(F.when(F.col("seen_pos") == F.col("e.pos"), F.col("best"))).alias("best"))
    paths = events.groupBy("source_path").agg(F.array_sort(F.collect_list(F.struct("e.pos", "e.run_no", "e.succeeded", "best"))).alias("events"))  # at most one event per run
    return paths.select("source_path", F.explode(_replay(F.col("events"), lease_runs)).alias("r")).select("source_path", "r.*")


class StaleToken(RuntimeError):
    """The worker's lease has run out and another worker has taken the unit."""


class IncompleteRun(RuntimeError):
    """Units of the run are not done, so its result is not whole."""


@dataclass(frozen=True)
class Lease:
    run: int
    unit: int
    token: int
    expires: float


class WorkLedger(Claims):
    """Units of work of numbered runs in a shared folder.

    Below ``root/run=R`` lie ``units.json``, ``items.json`` (where the run's items were laid down) and per unit the slots
    ``unit=U/000001.json`` and on: leases with their expiry, and at last the done record. See Claims for what the folder needs.
    """

    def __init__(self, spark: SparkSession, root: str, lease_seconds: float = 600, clock: Callable[[], float] = time.time, claim: Callable[[str, bytes], bool] | None = None, sleep: Callable[[float], None] = time.sleep):
        super().__init__(spark, root, claim)
        self.lease_seconds, self.clock, self.sleep = lease_seconds, clock, sleep

    # files ------------------------------------------------------------------------------------------------------
    def _dir(self, run: int, unit: int | None = None) -> str:
        return f"{self.root}/run={run:06d}" + ("" if unit is None else f"/unit={unit:06d}")

    def _slots(self, run: int, unit: int) -> int:
        return max((int(n[:6]) for n in self._names(self._dir(run, unit)) if n.endswith(".json") and n[:6].isdigit()), default=0)

    def _slot(self, run: int, unit: int, n: int) -> str:
        return f"{self._dir(run, unit)}/{n:06d}.json"

    def _last(self, run: int, unit: int) -> tuple[int, dict]:
        n = self._slots(run, unit)
        return n, self._read(self._slot(run, unit, n)) if n else {"kind": "new"}

    # protocol ---------------------------------------------------------------------------------------------------
    def enqueue(self, run: int, units: int) -> None:
        """Declare the units of a run. Repeating it after a failure changes nothing; another number of units is an error."""
        if not self._create(f"{self._dir(run)}/units.json", {"units": units}) and self.units(run) != units:
            raise ValueError(f"run {run} already has {self.units(run)} units")

    def units(self, run: int) -> int:
        return self._read(f"{self._dir(run)}/units.json")["units"]

    def _status(self, last: dict) -> str:
        if last["kind"] == "lease":
            return "leased" if last["expires"] > self.clock() else "pending"
        return "done" if last["kind"] == "done" else "pending"

    def status(self, run: int, unit: int) -> str:
        return self._status(self._last(run, unit)[1])

    def lease(self, run: int, unit: int) -> Lease | None:
        """A lease with a token greater than all before, or None if the unit is done, leased or lost to another worker just now."""
        n, last = self._last(run, unit)
        if self._status(last) != "pending":
            return None
        token, expires = n + 1, self.clock() + self.lease_seconds
        ok = self._create(self._slot(run, unit, token), {"kind": "lease", "token": token, "expires": expires})
        return Lease(run, unit, token, expires) if ok else None

    def attempt_path(self, lease: Lease) -> str:
        """Where the holder of the lease writes; no other attempt does."""
        return f"{self.root}/out/run={lease.run:06d}/unit={lease.unit:06d}/token={lease.token:06d}"

    def commit(self, lease: Lease) -> None:
        """Mark the unit done with what the attempt wrote, by taking the slot after the lease. Repeating one's own commit changes nothing."""
        path = self.attempt_path(lease)
        done = {"kind": "done", "token": lease.token, "path": path if self._fs.exists(self._path(path)) else None, "at": self.clock()}
        if not self._create(self._slot(lease.run, lease.unit, lease.token + 1), done):
            taken = self._read(self._slot(lease.run, lease.unit, lease.token + 1))
            if (taken["kind"], taken["token"]) != ("done", lease.token):
                raise StaleToken(f"token {lease.token} of unit {lease.unit} has been superseded")

    def output_path(self, run: int, unit: int) -> str:
        """Where the result of a unit that is done lies."""
        last = self._last(run, unit)[1]
        if last["kind"] != "done":
            raise IncompleteRun(f"unit {unit} of run {run} is not done")
        return last["path"]

    def run_done(self, run: int) -> bool:
        return all(self.status(run, u) == "done" for u in range(self.units(run)))

    def result(self, run: int) -> DataFrame:
        """The whole result of a run; an error while a unit is not done."""
        paths = [p for p in (self.output_path(run, u) for u in range(self.units(run))) if p is not None]
        return self.spark.read.parquet(*paths)

    def sweep(self, run: int) -> None:
        """Remove what attempts that were overtaken have written. Only for a run that is done."""
        for unit in range(self.units(run)):
            kept = self._path(self.output_path(run, unit) or "/").getName()
            for s in self._fs.listStatus(self._path(f"{self.root}/out/run={run:06d}/unit={unit:06d}")):
                if s.getPath().getName() != kept:
                    self._fs.delete(s.getPath(), True)

    def _laid_down(self, run: int, items: DataFrame, key: str, units: int) -> Callable[[int], DataFrame]:
        """The run's items by unit. They are computed once and written by unit; every attempt of every worker reads that copy."""
        note = f"{self._dir(run)}/items.json"
        if not self._fs.exists(self._path(note)):
            at = f"{self.root}/items/run={run:06d}/{uuid.uuid4().hex}"
            unit_of = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(units)).cast("int")
            items.select(F.struct(*(F.col(f"`{c}`") for c in items.columns)).alias("item"), unit_of.alias("unit")).write.partitionBy("unit").parquet(at)
            self._create(note, {"path": at})  # if another worker was first, its copy counts
        schema = T.StructType([T.StructField("item", items.schema), T.StructField("unit", T.IntegerType())])
        rows = self.spark.read.schema(schema).parquet(self._read(note)["path"])
        return lambda unit: rows.filter(F.col("unit") == unit).select("item.*")

    def process(self, run: int, items: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], units: int = 8, parallel: int = 1, wait_seconds: float | None = None, poll_seconds: float = 1.0) -> DataFrame:
        """Work through a run's items once each, unit by unit, continuing where a failed attempt stopped; returns the whole result.

        Items belong to a unit by a hash of their key. ``parallel`` units are worked on at once, each as a job over all
        executors. Units that another worker holds are waited for, and taken over when their lease runs out; after
        ``wait_seconds`` (two leases by default) without an end, IncompleteRun is raised.
        """
        self.enqueue(run, units)
        of_unit = self._laid_down(run, items, key, units)

        def attempt(unit: int) -> None:
            lease = self.lease(run, unit)
            if lease is not None:
                work(of_unit(unit)).write.mode("overwrite").parquet(self.attempt_path(lease))
                try:
                    self.commit(lease)
                except StaleToken:
                    pass  # whoever took over brings the unit to its end

        waited, most = 0.0, 2 * self.lease_seconds if wait_seconds is None else wait_seconds
        while True:
            with ThreadPoolExecutor(parallel) as pool:
                for f in [pool.submit(attempt, u) for u in range(units)] if parallel > 1 else []:
                    f.result()
            if parallel <= 1:
                for u in range(units):
                    attempt(u)
            if self.run_done(run):
                return self.result(run)
            if waited >= most:
                raise IncompleteRun(f"run {run} has units that are not done")
            self.sleep(poll_seconds)
            waited += poll_seconds
