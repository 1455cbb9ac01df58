import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from folioforge.operators.incremental import IncompleteRun, StaleToken, WorkLedger, plan_work_items
from folioforge.streaming.ingest import process_stream
from tests.conftest import rows

ENTRY = "entry_id long, delivery int, source_path string, content_sha256 string, metadata_sha256 string, indexed_at string, run_no string, status string"
RUN = "run_no int, last_delivery int, started_at timestamp, finished_at timestamp, status string"


def plan(spark, entries, runs):
    e = [(*x, "clash", "clash") for x in entries]
    r = [(n, d, dt.datetime(2025, 1, n), None, s) for n, d, s in runs]
    return plan_work_items(spark.createDataFrame(e, ENTRY), spark.createDataFrame(r, RUN))


def brute(entries, runs):
    out, before = set(), None
    for n, last, status in sorted(runs):
        if (status or "").lower() != "succeeded":
            continue
        now = {}
        for i, d, p, c, m, at in entries:
            if p is not None and d is not None and d <= last:
                t = dt.datetime.fromisoformat(at.replace("Z", "+00:00"))
                if p not in now or (t, d, i) > now[p][0]:
                    now[p] = ((t, d, i), (c.lower(), m.lower()))
        out |= {(n, p) for p, (_, s) in now.items() if before is None or p not in before or before[p] != s}
        before = {p: s for p, (_, s) in now.items()}
    return out


def test_random_feeds_against_brute_force(spark):
    rnd = random.Random(3)
    entries = []
    for i in range(300):
        at = dt.datetime(2025, 1, 1, tzinfo=dt.UTC) + dt.timedelta(minutes=rnd.randrange(500))
        text = at.isoformat() if rnd.random() < 0.5 else at.astimezone(dt.timezone(dt.timedelta(hours=3))).isoformat()
        h = rnd.choice(["aa", "AA", "bb"])
        entries.append((i, rnd.randrange(1, 9), f"p{rnd.randrange(40)}", h, rnd.choice(["x", "y"]), text))
    entries += entries[:20]
    runs = [(1, 1, "succeeded"), (2, 3, "failed"), (3, 3, None), (4, 4, "SUCCEEDED"), (5, 6, "running"), (6, 8, "Succeeded")]
    got = plan(spark, entries, runs).filter("status = 'done' and needs_work")
    assert {(r.done_run, r.source_path) for r in got.collect()} == brute(entries, runs)


def test_failed_runs_lease_again(spark):
    entries = [(1, 1, "p", "a", "b", "2025-01-01T00:00:00Z"), (2, 2, "q", "a", "b", "2025-01-01T00:00:00Z"), (3, 9, "r", "a", "b", "2025-01-01T00:00:00Z")]
    runs = [(1, 1, "failed"), (2, 2, None), (3, 2, "succeeded"), (4, 9, "failed")]
    got = rows(plan(spark, entries, runs), "source_path", "enqueued_run", "attempts", "token", "status")
    assert got == [("p", 1, 3, 3, "done"), ("q", 2, 2, 3, "done"), ("r", 4, 1, None, "pending")]


def test_change_and_return_is_no_work_and_nulls(spark):
    t = "2025-01-0{}T00:00:00Z"
    entries = [
        (1, 1, "p", "a", "b", t.format(1)), (2, 2, "p", "z", "b", t.format(2)), (3, 3, "p", " A ", "b", t.format(3)), (4, 3, None, "a", "b", t.format(3)),
        (5, None, "n", "a", "b", t.format(3)), (6, 1, "bad", "a", None, "no instant"), (7, 3, "bad", "a", None, None),
    ]
    runs = [(1, 1, "succeeded"), (2, 3, "succeeded"), (3, None, "succeeded"), (4, 3, "succeeded")]
    got = rows(plan(spark, entries, runs).filter("needs_work"), "done_run", "source_path")
    assert got == [(1, "bad"), (1, "p")]
    assert plan(spark, [], runs).count() == 0 and plan(spark, entries, []).count() == 0


def test_ledger_survives_failures_without_loss_or_repetition(spark, tmp_path):
    clock = [1000.0]
    ledger = WorkLedger(spark, f"file://{tmp_path}/ledger", lease_seconds=10, clock=lambda: clock[0])
    items = spark.range(40).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    calls = []

    def work(df):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("executor lost")
        return df.withColumn("done_by", F.lit(len(calls)))

    with pytest.raises(RuntimeError):
        ledger.process(1, items, "key", work, units=4)
    assert [ledger.status(1, u) for u in range(4)] == ["done", "done", "leased", "pending"]
    assert ledger.lease(1, 2) is None  # still held
    clock[0] += 11
    assert ledger.status(1, 2) == "pending"
    out = ledger.process(1, items, "key", work, units=4)
    assert sorted(r.key for r in out.collect()) == sorted(r.key for r in items.collect())
    assert ledger.run_done(1) and len(calls) == 5  # two units were not repeated
    with pytest.raises(ValueError):
        ledger.enqueue(1, 5)


def test_stale_writer_is_rejected(spark, tmp_path):
    clock = [0.0]
    ledger = WorkLedger(spark, f"file://{tmp_path}/ledger", lease_seconds=10, clock=lambda: clock[0])
    ledger.enqueue(1, 1)
    old = ledger.lease(1, 0)
    clock[0] = 20
    new = ledger.lease(1, 0)
    assert new.token == old.token + 1
    spark.range(3).write.parquet(ledger.attempt_path(old))
    with pytest.raises(StaleToken):
        ledger.commit(old)
    spark.range(5).write.parquet(ledger.attempt_path(new))
    ledger.commit(new)
    assert spark.read.parquet(ledger.output_path(1, 0)).count() == 5 and ledger.lease(1, 0) is None


def test_stream_is_worked_through_once(spark, tmp_path):
    spark.range(10).select(F.col("id").cast("string").alias("key")).write.parquet(f"{tmp_path}/in")
    ledger = WorkLedger(spark, f"file://{tmp_path}/ledger")
    stream = spark.readStream.schema("key string").parquet(f"{tmp_path}/in")
    process_stream(stream, ledger, "key", lambda df: df, f"{tmp_path}/state", units=2).awaitTermination()
    process_stream(stream, ledger, "key", lambda df: df, f"{tmp_path}/state", units=2).awaitTermination()
    out = spark.read.parquet(*[ledger.output_path(0, u) for u in range(2)])
    assert sorted(int(r.key) for r in out.collect()) == list(range(10))


def test_found_rows_hang_on_the_lease_rule(spark):
    """With leases that outlive the next run, what a failed run held is not taken by the run after it."""
    t = "2025-01-01T00:00:00Z"
    entries = [(1, 1, "p", "a", "b", t), (2, 2, "q", "a", "b", t)]
    runs = [(1, 1, "failed"), (2, 2, "succeeded"), (3, 2, "succeeded")]
    e = spark.createDataFrame([(*x, "clash", "clash") for x in entries], ENTRY)
    r = spark.createDataFrame([(n, d, None, None, s) for n, d, s in runs], RUN)
    done = lambda n: rows(plan_work_items(e, r, n).filter("status = 'done' and needs_work"), "done_run", "source_path")
    assert done(1) == [(2, "p"), (2, "q")] and done(2) == [(2, "q")]


def test_no_product_of_feed_and_runs(spark):
    plan_text = plan(spark, [(1, 1, "p", "a", "b", None)], [(1, 1, "succeeded")])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan_text and "Cartesian" not in plan_text


class Crash(Exception):
    pass


def crashing(ledger, at):
    """Lets the worker die before or after the given step of its file operations (counted over all of them)."""
    step = [0]

    def guard(f):
        def run(*args):
            step[0] += 1
            if step[0] == at:
                raise Crash
            out = f(*args)
            step[0] += 1
            if step[0] == at:
                raise Crash
            return out

        return run

    for name in ("_aside", "_appear"):
        setattr(ledger, name, guard(getattr(ledger, name)))
    return step


def test_a_crash_at_any_step_loses_and_repeats_nothing(spark, tmp_path):
    items = spark.range(6).select(F.col("id").cast("string").alias("key")).coalesce(1).cache()
    at, over = 0, False
    while not over:
        at += 1
        clock = [0.0]
        make = lambda: WorkLedger(spark, f"file://{tmp_path}/ledger-{at}", lease_seconds=10, clock=lambda: clock[0], sleep=lambda s: clock.__setitem__(0, clock[0] + 11))  # noqa: B023, E731
        ledger = make()
        step = crashing(ledger, at)
        try:
            out = ledger.process(1, items, "key", lambda df: df, units=2)
            over = step[0] < at
        except Crash:
            out = make().process(1, items, "key", lambda df: df, units=2, wait_seconds=100)
        assert sorted(r.key for r in out.collect()) == list("012345")
        assert make().run_done(1)
    assert at > 20


def test_a_late_writer_leaves_the_result_untouched(spark, tmp_path):
    clock = [0.0]
    ledger = WorkLedger(spark, f"file://{tmp_path}/ledger", lease_seconds=10, clock=lambda: clock[0])
    ledger.enqueue(1, 1)
    old = ledger.lease(1, 0)
    spark.range(1).write.parquet(ledger.attempt_path(old))
    clock[0] = 20
    new = ledger.lease(1, 0)
    spark.range(5).write.parquet(ledger.attempt_path(new))
    real = ledger._create
    # the old worker has passed whatever it checks and only now gets to its file; the new one commits before it
    ledger._create = lambda path, what: (setattr(ledger, "_create", real), ledger.commit(new), real(path, what))[-1]
    with pytest.raises(StaleToken):
        ledger.commit(old)
    spark.range(7).write.mode("overwrite").parquet(ledger.attempt_path(old))
    assert ledger.result(1).count() == 5
    ledger.commit(new)
    ledger.sweep(1)
    assert ledger.result(1).count() == 5 and not (tmp_path / "ledger/out/run=000001/unit=000000/token=000001").exists()


def test_another_worker_is_waited_for_and_the_upstream_runs_once(spark, tmp_path):
    clock, seen = [0.0], spark.sparkContext.accumulator(0)
    slept = []
    ledger = WorkLedger(spark, f"file://{tmp_path}/ledger", lease_seconds=10, clock=lambda: clock[0], sleep=slept.append)
    count = F.udf(lambda x: (seen.add(1), x)[1])
    items = spark.range(9).select(count(F.col("id").cast("string")).alias("unit"), F.lit(1).alias("item"))
    ledger.enqueue(1, 3)
    ledger.lease(1, 1)
    with pytest.raises(IncompleteRun):
        ledger.process(1, items, "unit", lambda df: df, units=3, wait_seconds=2)
    assert len(slept) == 2 and not ledger.run_done(1)
    with pytest.raises(IncompleteRun):
        ledger.result(1)
    clock[0] = 11
    out = ledger.process(1, items, "unit", lambda df: df, units=3, parallel=3)
    assert sorted(int(r.unit) for r in out.collect()) == list(range(9)) and out.columns == ["unit", "item"] and seen.value == 9
    assert WorkLedger(spark, f"file://{tmp_path}/none").process(2, items.limit(0), "unit", lambda df: df, units=2).count() == 0


def test_a_store_without_atomic_create_needs_a_claim(spark, tmp_path):
    made = {}
    ledger = WorkLedger(spark, f"file://{tmp_path}/ledger", claim=lambda path, content: made.setdefault(path, content) is content)
    ledger._read = lambda path: json.loads(made[path])
    ledger.enqueue(1, 2)
    ledger.enqueue(1, 2)
    assert ledger.units(1) == 2 and len(made) == 1
