import datetime as dt
import random

import pytest

from folioforge.llm import consensus

ROW = "judgement_id long, trace_id long, annotator string, correct boolean, citation_supported boolean, proper_refusal boolean, error string, judged_at timestamp, item string, label string, code string"
T = dt.datetime(2025, 1, 1)


def frame(spark, data):
    return spark.createDataFrame([(*x, "i", "l", "c") for x in data], ROW)


def planted(seed=1, traces=400):
    """Truth and votes of reliable, sloppy, contrary and yes-saying annotators of very uneven activity."""
    rnd = random.Random(seed)
    skill = {"good1": (0.95, 0.95), "good2": (0.9, 0.95), "good3": (0.9, 0.9), "coin": (0.5, 0.5), "contrary": (0.1, 0.1), "yes1": (0.98, 0.3), "yes2": (0.97, 0.35), "rare": (0.9, 0.9)}
    truth, data, n = {}, [], 0
    for t in range(traces):
        truth[t] = rnd.random() < 0.6
        for a, (sens, spec) in skill.items():
            if a == "rare" and t > 5 or rnd.random() < 0.25:
                continue
            v = (rnd.random() < sens) if truth[t] else (rnd.random() >= spec)
            data.append((n, t, a, v, v, None, None, T))
            n += 1
    return truth, data


def test_beats_the_majority_and_finds_reliabilities(spark):
    truth, data = planted()
    items, matrices = consensus.fit(consensus.votes_of(frame(spark, data)))
    got = {r["item"]: r.posterior > 0.5 for r in items.filter("label = 'correct'").collect()}
    votes = {}
    for _, t, _, v, *_ in data:
        votes.setdefault(t, []).append(v)
    right = sum(got[t] == truth[t] for t in got) / len(got)
    majority = sum((sum(v) > len(v) / 2) == truth[t] for t, v in votes.items()) / len(votes)
    assert right > 0.95 and right > majority + 0.05
    m = {r.annotator: (r.sensitivity, r.specificity) for r in matrices.filter("label = 'correct'").collect()}
    assert m["good1"][0] > 0.88 and m["contrary"][0] < 0.25 and m["yes1"][1] < 0.5 and 0.35 < m["coin"][0] < 0.65
    assert items.filter("label = 'proper_refusal'").count() == 0  # null labels are no votes


def test_what_counts_as_a_vote(spark):
    data = [
        (1, 1, "a", True, None, None, None, T), (2, 1, "a", False, None, None, None, T + dt.timedelta(1)), (3, 1, "a", True, None, None, "boom", T + dt.timedelta(9)),
        (3, 1, "a", True, None, None, None, None), (4, 1, None, True, None, None, None, T), (5, None, "a", True, None, None, None, T), (6, 2, "b", True, True, None, None, T), (6, 2, "b", True, True, None, None, T),
    ]
    got = sorted(tuple(r) for r in consensus.votes_of(frame(spark, data)).collect())
    assert got == [(1, "correct", "a", False), (2, "citation_supported", "b", True), (2, "correct", "b", True)]


def alpha(votes):
    """Krippendorff's alpha by all pairs."""
    units = [v for v in votes if len(v) > 1]
    n = sum(map(len, units))
    do = sum(sum(a != b for i, a in enumerate(u) for j, b in enumerate(u) if i != j) / (len(u) - 1) for u in units) / n
    flat = [x for u in units for x in u]
    de = sum(a != b for i, a in enumerate(flat) for j, b in enumerate(flat) if i != j) / (n * (n - 1))
    return 1 - do / de


def test_agreement(spark):
    _, data = planted(3, 40)
    got = consensus.agreement(consensus.votes_of(frame(spark, data))).filter("label = 'correct'").head()
    votes = {}
    for _, t, _, v, *_ in data:
        votes.setdefault(t, []).append(v)
    assert got.alpha == pytest.approx(alpha(list(votes.values())))
    same = [(i, 1, a, True, None, None, None, T) for i, a in enumerate("abc")]
    assert consensus.agreement(consensus.votes_of(frame(spark, same))).head().alpha == 1.0


def test_empty(spark):
    items, matrices = consensus.fit(consensus.votes_of(frame(spark, [])))
    assert items.count() == 0 and matrices.count() == 0 and consensus.agreement(consensus.votes_of(frame(spark, []))).count() == 0


def test_many_annotators_as_a_table_give_the_same(spark, monkeypatch):
    _, data = planted(5, 120)
    data += [(9000 + i, i % 30, f"once{i:03d}", i % 3 == 0, i % 2 == 0, None, None, T) for i in range(60)]
    votes = consensus.votes_of(frame(spark, data))
    results = []
    for most in (5000, 3):
        monkeypatch.setattr(consensus, "MOST_ANNOTATORS", most)
        items, matrices = consensus.fit(votes)
        results.append(({(r["item"], r.label): r.posterior for r in items.collect()}, {(r.label, r.annotator): (r.sensitivity, r.specificity) for r in matrices.collect()}))
    (a, m), (b, n) = results
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)
    assert m.keys() == n.keys() and all(m[k] == pytest.approx(n[k], abs=1e-9) for k in m)
