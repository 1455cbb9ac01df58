import datetime as dt
import math
import random
import statistics

import pytest

from folioforge.llm import score_fusion
from tests.conftest import rows

PASSAGE = "passage_id long, question_id string, retriever string, chunk_id string, score double, retrieved_at timestamp, s string, rank int, higher string"


def frame(spark, data):
    return spark.createDataFrame([(i, q, r, c, s, at, "clash", 1, "clash") for i, (q, r, c, s, at) in enumerate(data)], PASSAGE)


def retrievers(spark):
    return spark.createDataFrame([("a", True), ("b", True), ("d", False), ("n", None), (None, True)], "retriever string, higher_is_better boolean")


def at(n):
    return dt.datetime(2025, 1, 1) + dt.timedelta(seconds=n)


def brute(data):
    """(fused scores, leaders) in plain Python."""
    latest = {}
    for i, (q, r, c, s, t) in enumerate(data):
        if None not in (q, r, c):
            key = (t or dt.datetime.min, i)
            if (q, r, c) not in latest or key > latest[q, r, c][0]:
                latest[q, r, c] = (key, s)
    lists = {}
    for (q, r, c), (_, s) in latest.items():
        if s is not None and not math.isnan(s):
            lists.setdefault(q, {}).setdefault(r, {})[c] = -s if r == "d" else s
    fused, leaders = {}, set()
    for q, by in lists.items():
        logs, floors = {}, {}
        for r, scores in by.items():
            med = statistics.median(scores.values())
            dev = {c: s - med for c, s in scores.items()}
            mad = statistics.median(map(abs, dev.values()))
            unit = 1.4826 * mad or 1.2533 * statistics.fmean(map(abs, dev.values()))
            b = {c: min(max(1 / (1 + math.exp(-max(min(x / unit if unit else 0.0, 700), -700))), 1e-9), 1 - 1e-9) for c, x in dev.items()}
            floors[r] = math.log(min(b.values()) * 0.5)
            logs[r] = {c: math.log(v) for c, v in b.items()}
        every = {c for s in by.values() for c in s}
        for c in every:
            fused[q, c] = math.exp(sum(logs[r].get(c, floors[r]) for r in by) / len(by))
            if len(by) >= 3 and len(every) >= 2 and all(c in s for s in by.values()):
                others = [sum(o >= s[c] for k, o in s.items() if k != c) for s in by.values()]
                if sum(n > 0 for n in others) <= 1 and max(others) <= 1:
                    leaders.add((q, c))
    return fused, leaders


def random_data(seed, n, questions=6):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        s = rnd.choice([None, float("nan"), round(rnd.gauss(0, 1), 1), rnd.gauss(0, 1), 1e6, 5.0])
        out.append((rnd.choice([f"q{i}" for i in range(questions)] + [None] * (rnd.random() < 0.02)), rnd.choice("abdn"), f"c{rnd.randrange(6)}", s, rnd.choice([None, at(rnd.randrange(5))])))
    for q in range(questions):  # one clear leader
        out += [(f"q{q}", r, "c0", -1e7 if r == "d" else 1e7, at(99)) for r in "abdn"[: rnd.randrange(2, 5)]]
    return out


@pytest.mark.parametrize("hot_rows", [10**9, 10])
def test_against_brute_force(spark, hot_rows):
    data = random_data(2, 260)
    got = score_fusion.fuse_scores(frame(spark, data), retrievers(spark), hot_rows=hot_rows)
    fused, leaders = brute(data)
    mine = {(r.question_id, r.chunk_id): r.fused for r in got.collect()}
    assert set(mine) == set(fused) and all(mine[k] == pytest.approx(fused[k], rel=1e-9) for k in fused)
    assert set(rows(score_fusion.leads_almost_everywhere(got))) == leaders and leaders
    for q in {q for q, _ in fused}:
        order = [r.chunk_id for r in got.filter(f"question_id = '{q}'").orderBy("rank").collect()]
        assert order == sorted(order, key=lambda c: (-mine[q, c], c))


def test_no_list_dominates_by_range(spark):
    data = [("q", "a", f"c{i}", float(i), at(0)) for i in range(9)] + [("q", "b", f"c{i}", 1e9 * (8 - i), at(0)) for i in range(9)]
    got = {r.chunk_id: r.fused for r in score_fusion.fuse_scores(frame(spark, data), retrievers(spark)).collect()}
    assert got["c0"] == pytest.approx(got["c8"]) and max(got, key=got.get) == "c4"
    heavy = score_fusion.fuse_scores(frame(spark, data), retrievers(spark), weights={"b": 5.0}).filter("rank = 1").head()
    assert heavy.chunk_id in ("c0", "c1", "c2")


def test_infinite_equal_and_empty(spark):
    data = [("q", "a", "x", float("inf"), at(0)), ("q", "a", "y", 1.0, at(0)), ("q", "a", "z", float("-inf"), at(0)), ("q", "b", "x", 2.0, at(0)), ("q", "b", "y", 2.0, at(0))]
    order = [r.chunk_id for r in score_fusion.fuse_scores(frame(spark, data), retrievers(spark)).orderBy("rank").collect()]
    assert order == ["x", "y", "z"]
    assert score_fusion.fuse_scores(frame(spark, []), retrievers(spark)).count() == 0
    assert score_fusion.fuse_scores(frame(spark, data), retrievers(spark).limit(0)).count() == 3


@pytest.mark.parametrize("hot_rows", [10**9, 3])
def test_leaders_come_from_the_fusion(spark, hot_rows):
    scores = {"a": {"lead": 1.0, "wide": 0.99}, "b": {"lead": 1.0, "wide": 0.99}, "n": {"lead": 0.5, "wide": 90.0}}
    data = [("q", r, c, scores[r].get(c, x), at(1)) for r in scores for c, x in (("lead", 0), ("wide", 0), ("x", 0.45), ("y", 0.4), ("z", 0.3))]
    got = score_fusion.fuse_scores(frame(spark, data), retrievers(spark), hot_rows=hot_rows)
    found = score_fusion.leads_almost_everywhere(got)
    assert [r.chunk_id for r in got.orderBy("rank").collect()][:2] == ["wide", "lead"] and rows(found) == [("q", "lead")]
    if hot_rows > 3:  # the method is in the plan, not pruned from it
        plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "median(" in plan or "percentile(" in plan
        assert "exp(" in plan and "log(" in plan or "ln(" in plan


def test_found_rows_hang_on_the_standardised_values(spark, monkeypatch):
    data = random_data(5, 200)
    found = lambda: set(rows(score_fusion.leads_almost_everywhere(score_fusion.fuse_scores(frame(spark, data), retrievers(spark)))))
    assert found() == brute(data)[1]
    right = score_fusion._squash
    monkeypatch.setattr(score_fusion, "_squash", lambda dev, mad, mean, steep: right(-dev, mad, mean, steep))
    assert found() != brute(data)[1]
