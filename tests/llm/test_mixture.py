import random

import pytest

from folioforge.llm import encoding, mixture

DOC = "doc_id long, text string, source string, tokens string, h string, repeats string"
TARGET = "source string, target_share double, max_repeats int, extra string"


def frames(spark, docs, targets):
    return spark.createDataFrame([(*d, "x", "x", "x") for d in docs], DOC), spark.createDataFrame([(*t, "x") for t in targets], TARGET)


def test_water_filling():
    fill = mixture.water_fill
    assert fill({"a": 0.5, "b": 0.5}, {"a": 100, "b": 1000}, 400) == {"a": 100, "b": 300}
    assert fill({"a": 0.2, "b": 0.3, "c": 0.5}, {"a": 9, "b": 9, "c": 9}, 100) == {"a": 9, "b": 9, "c": 9}
    got = fill({"a": 0.1, "b": 0.2, "c": 0.3, "d": 0.4, "e": 0.0}, {"a": 500, "b": 50, "c": 500, "d": 0, "e": 9}, 300)
    assert got["b"] == 50 and got["d"] == got["e"] == 0 and got["c"] == pytest.approx(3 * got["a"]) and sum(got.values()) == pytest.approx(300)
    assert fill({}, {}, 5) == {} and fill({"a": 1.0}, {"a": 5}, 0) == {"a": 0.0}


def corpus(seed=0):
    rnd = random.Random(seed)
    docs = [(i, "word " * rnd.randint(1, 60), rnd.choice(["big", "big", "big", " BIG ", "mid_one", "mid-one"])) for i in range(600)]
    docs += [(1000 + i, "word " * 20, "small") for i in range(5)] + [(2000, None, "big"), (2001, "", "small"), (2002, "x", None), (2003, "x", "unlisted"), (2004, "x", " ")]
    return docs


TARGETS = [("big", 0.4, 1), ("mid-one", 0.3, 4), ("small", 0.2, 3), ("nothing", 0.1, 5)]


def test_shares(spark):
    docs, targets = frames(spark, corpus(), TARGETS)
    records, report = mixture.mix(docs, targets)
    r = {x.source: x for x in report.collect()}
    assert r["small"].mixed_tokens == 3 * r["small"].source_tokens and r["small"].most_repeats == 3  # clamped
    assert r["nothing"].mixed_tokens == 0 and set(r) == {"big", "mid-one", "small", "nothing"}
    for s in ("big", "mid-one"):
        assert r[s].planned_tokens - 61 <= r[s].mixed_tokens <= r[s].planned_tokens  # within one text
        assert r[s].mixed_tokens <= r[s].max_repeats * r[s].source_tokens
    assert sum(x.actual_share for x in r.values()) == pytest.approx(1.0)
    assert r["big"].actual_share / r["mid-one"].actual_share == pytest.approx(4 / 3, rel=0.02)
    assert records.filter("source not in ('big', 'mid-one', 'small')").count() == 0
    again = sorted(map(tuple, mixture.mix(docs, targets)[0].collect()))
    assert again == sorted(map(tuple, records.collect()))  # seeded
    other = sorted(map(tuple, mixture.mix(docs, targets, seed=5)[0].collect()))
    assert other != again


def test_total_and_whole_repetitions(spark):
    docs, targets = frames(spark, [(i, "word " * 10, "a") for i in range(50)], [("A", 1.0, 7)])
    size = sum(encoding.Encoder.of(encoding.vocabulary_path()).count("word " * 10) for _ in range(50))
    records, report = mixture.mix(docs, targets, total_tokens=int(size * 2.5))
    counts = {r.doc_id: r.repeats for r in records.collect()}
    assert set(counts.values()) == {2, 3} and sum(v == 3 for v in counts.values()) == 25
    assert report.head().mixed_tokens == int(size * 2.5)
    assert {r.repeats for r in mixture.mix(docs, targets, total_tokens=10**9)[0].collect()} == {7}


def test_ties_repeats_and_empty(spark):
    docs, targets = frames(spark, [(1, "w", "a")] * 30, [("a", 0.5, 1), ("a", 0.5, 3), (None, 0.5, 1), ("b", None, None), ("c", float("nan"), 1)])
    records, report = mixture.mix(docs, targets, total_tokens=15)  # equal hashes stand or fall together
    assert records.count() in (0, 30) and {x.source: x.max_repeats for x in report.collect()}["a"] == 1
    for d, t in ((docs.limit(0), targets), (docs, targets.limit(0))):
        a, b = mixture.mix(d, t)
        assert a.count() == 0 and b.filter("mixed_tokens > 0").count() == 0


def test_a_long_text_does_not_end_the_choice(spark):
    data = [(i, "word " * (3 + i % 4), "a") for i in range(40)] + [(100 + i, "word " * 300, "a") for i in range(4)] + [(7, "word " * 5, "a")]
    docs, targets = frames(spark, data, [("a", 1.0, 1)])
    count = encoding.Encoder.of(encoding.vocabulary_path()).count
    for seed in range(4):
        records, report = mixture.mix(docs, targets, total_tokens=150, seed=seed)
        got = {(r.doc_id, r.tokens) for r in records.collect()}
        gap = 150 - report.head().mixed_tokens
        free = {}
        for i, text, _ in data:
            if (i, count(text)) not in got:
                free[i] = free.get(i, 0) + count(text)
        assert 0 <= gap < min(free.values()) and sum(i == 7 for i, _ in got) in (0, 2)
