import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from folioforge.operators.history import apply_updates, bitemporal_ledger, current_versions, metadata_updates
from tests.conftest import rows

UPDATE = "entity string, state string, valid_from date, valid_to date, recorded_at timestamp_ntz"
SNAPSHOT = "snapshot_date date, captured_at timestamp, source_path string, document_id string, version string, metadata map<string,string>, extra string, entity string"


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def at(n):
    return dt.datetime(2024, 6, 1) + dt.timedelta(seconds=n)


def believed(updates, when):
    """Brute force: per day and entity the state of the latest update recorded up to ``when``."""
    out = {}
    for e, s, a, b, r in sorted(updates, key=lambda u: (u[4], str(u[1]))):
        if r <= when:
            for d in range((b - a).days):
                out[(e, a + dt.timedelta(days=d))] = s
    return out


def expand(ledger, when):
    out = {}
    for r in ledger:
        if r.recorded_from <= when and (r.recorded_to is None or when < r.recorded_to):
            for d in range((r.valid_to - r.valid_from).days):
                key = (r.entity, r.valid_from + dt.timedelta(days=d))
                assert key not in out, "two beliefs about one day"
                out[key] = r.state
    return out


@pytest.mark.parametrize("slice_days", [7, 364])
def test_random_updates_against_brute_force(spark, slice_days):
    rnd = random.Random(5)
    ups = []
    for i in range(160):
        a = rnd.randrange(60)
        ups.append((rnd.choice("abc"), rnd.choice("xyz"), day(a), day(a + rnd.randrange(1, 30)), at(i)))
    ledger = bitemporal_ledger(spark.createDataFrame(ups, UPDATE), slice_days).collect()
    for when in (0, 3, 40, 99, 159, 1000):
        assert expand(ledger, at(when)) == believed(ups, at(when))
    closed = [r for r in ledger if r.recorded_to is not None]
    assert closed and all(r.recorded_from < r.recorded_to for r in closed)


def test_late_update_splits_and_supersedes(spark):
    ups = [("e", "old", day(0), day(10), at(0)), ("e", "late", day(3), day(5), at(1))]
    got = rows(bitemporal_ledger(spark.createDataFrame(ups, UPDATE)))
    assert got == sorted(
        [
            ("e", "old", day(0), day(10), at(0), at(1)), ("e", "old", day(0), day(3), at(1), None),
            ("e", "late", day(3), day(5), at(1), None), ("e", "old", day(5), day(10), at(1), None),
        ], key=str,
    )


def test_open_end_repeats_nulls_and_empty(spark):
    ups = [
        ("e", "s", day(0), None, at(0)), ("e", "s", day(0), None, at(0)), ("e", "t", day(900), None, at(5)), (None, "s", day(0), None, at(0)),
        ("e", None, day(2), day(3), at(9)), ("e", "u", None, day(3), at(9)), ("e", "u", day(3), day(3), at(9)), ("e", "u", day(4), day(5), None),
    ]
    ledger = bitemporal_ledger(spark.createDataFrame(ups, UPDATE))
    now = rows(current_versions(ledger), "state", "valid_from", "valid_to")
    assert now == sorted([("s", day(0), day(2)), (None, day(2), day(3)), ("s", day(3), day(900)), ("t", day(900), None)], key=str)
    assert bitemporal_ledger(spark.createDataFrame([], UPDATE)).count() == 0
    assert current_versions(bitemporal_ledger(spark.createDataFrame([], UPDATE))).count() == 0


def test_apply_updates_equals_one_sweep(spark):
    first = [("e", "a", day(0), day(20), at(0)), ("e", "b", day(5), day(9), at(1))]
    second = [("e", "c", day(7), day(30), at(2))]
    once = bitemporal_ledger(spark.createDataFrame(first + second, UPDATE))
    twice = apply_updates(bitemporal_ledger(spark.createDataFrame(first, UPDATE)), spark.createDataFrame(second, UPDATE))
    now = lambda x: rows(x.filter("recorded_to is null"), "state", "valid_from", "valid_to")
    assert now(once) == now(twice)


def versions(spark, data):
    df = spark.createDataFrame(data, SNAPSHOT)
    got = current_versions(bitemporal_ledger(metadata_updates(df)))
    return rows(got, "entity", "valid_from", "valid_to")


def test_snapshots(spark):
    def snap(d, path, meta, cap=0, doc="D", version="1"):
        return (day(d), dt.datetime(2024, 1, 1) + dt.timedelta(days=d, hours=cap), path, doc, version, meta, "x", "clash")

    data = [
        snap(0, "p", {"a": "1", "b": " "}), snap(7, "p", {"a": " 1 "}), snap(14, "p", {"a": "2"}), snap(14, "p", {"a": "1"}, cap=5),  # the later capture counts
        snap(28, "p", {"a": "1"}),  # 21 was taken without p
        snap(21, "q", None), snap(28, "q", {}), snap(28, "q", {}), snap(28, None, {}),
        snap(0, "r", {"x": "y"}, version=None), snap(7, "r", {"x": "y"}, version="  "), snap(14, "r", {"x": "y"}, doc=None, version=""),
    ]
    assert versions(spark, data) == sorted(
        [
            ("p", day(0), day(21)), ("p", day(28), None), ("q", day(21), None), ("r", day(0), day(14)), ("r", day(14), day(21)),
        ], key=str,
    )
    assert versions(spark, []) == []


def test_digest_gives_the_same_versions(spark):
    data = [(day(i), dt.datetime(2024, 1, 1), "p", "d", str(i // 3), {"k": "v" * 3000}, None, None) for i in range(9)]
    df = spark.createDataFrame(data, SNAPSHOT)
    a, b = (rows(current_versions(bitemporal_ledger(metadata_updates(df, g))), "entity", "valid_from", "valid_to") for g in (False, True))
    assert a == b and len(a) == 3
    assert df.select(F.max("snapshot_date")).head()[0] == day(8)
