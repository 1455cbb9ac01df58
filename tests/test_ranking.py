import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.functions.vectors import cosine, hashed_embedding, model_embedding, model_pair_score
from folioforge.operators import ranking
from tests.conftest import rows

CHUNK = "chunk_id string, source_path string, chunk_index int, text string, status string, score string"
RANKED = "query_id string, rank int, chunk_id string, source_path string, score double"


def chunk_table(spark, texts, status=None):
    return spark.createDataFrame([(i, i.split(":")[0], int(i.split(":")[1]), t, (status or {}).get(i), "clash") for i, t in texts.items()], CHUNK)


def queries(spark, **q):
    return spark.createDataFrame(list(q.items()), "query_id string, text string")


TEXTS = {"a:0": "Use form FIN-EXP-19 for hotels", "b:0": "Use form FIN-EXP-22 for trains", "c:0": "Use form for taxis", "d:0": "", "e:0": None}


def test_bm25_by_hand(spark):
    got = ranking.bm25(queries(spark, q="fin-exp-22 fin-exp-22 form"), chunk_table(spark, TEXTS)).collect()
    idf = lambda df: math.log(1 + (5 - df + 0.5) / (df + 0.5))
    part = lambda df, tf, dl: idf(df) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (14 / 5)))
    best = got[0] if got[0]["rank"] == 1 else sorted(got, key=lambda r: r["rank"])[0]
    assert best.chunk_id == "b:0" and best.score == pytest.approx(part(1, 1, 5) + part(3, 1, 5), abs=1e-6)
    assert [r.chunk_id for r in sorted(got, key=lambda r: r["rank"])] == ["b:0", "c:0", "a:0"]


def test_bm25_filter_keeps_statistics(spark):
    c = chunk_table(spark, {"a:0": "same words", "b:0": "same words", "c:0": "other"}, {"a:0": "superseded", "b:0": "current"})
    free = {r.chunk_id: r.score for r in ranking.bm25(queries(spark, q="same"), c).collect()}
    kept = ranking.bm25(queries(spark, q="same"), c, keep=F.col("status") == "current").collect()
    assert [(r.chunk_id, r["rank"], r.score) for r in kept] == [("b:0", 1, free["b:0"])]
    for bad in ({"k1": 0}, {"b": 2}):
        with pytest.raises(ValueError):
            ranking.bm25(queries(spark, q="x"), c, **bad)
    assert ranking.bm25(queries(spark, q=None, r=""), c).count() == 0
    assert ranking.bm25(queries(spark, q="same"), c.limit(0)).count() == 0


def test_nearest_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(ranking, "VECTOR_BLOCK", 40)
    monkeypatch.setattr(ranking, "QUERY_BLOCK", 7)
    rnd = np.random.default_rng(1)
    m = rnd.integers(-2, 3, (150, 4)).astype(float)  # many ties
    m[3] = 0
    v = spark.createDataFrame([(f"v{i:03d}", row.tolist(), i % 3) for i, row in enumerate(m)] + [("none", None, 0), (None, [0.0] * 4, 0)], "chunk_id string, embedding array<float>, label int")
    q = spark.createDataFrame([(f"q{i}", m[i].tolist()) for i in range(0, 150, 10)], "query_id string, embedding array<float>")
    n = np.linalg.norm(m, axis=1)
    for keep, use in ((None, range(150)), (F.col("label") == 1, range(1, 150, 3))):
        got = {}
        for r in ranking.nearest(q, v, 5, keep).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = (r.chunk_id, r.score)
        for i in range(0, 150, 10):
            sim = {j: round(float(m[i] @ m[j] / (n[i] * n[j])), 6) + 0.0 if n[i] * n[j] else 0.0 for j in use}
            want = sorted(((-s, f"v{j:03d}") for j, s in sim.items()))[:5]
            assert [got[f"q{i}"][k] for k in range(1, 6)] == [(c, -s) for s, c in want]
    assert ranking.nearest(q, v.limit(0), 3).count() == 0


def test_cosine(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [1.0]), ([3.0, 4.0], [4.0, 3.0], [1.0, 1.0])], "a array<double>, b array<double>, c array<double>")
    assert [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == pytest.approx([0.0, 0.96])
    with pytest.raises(Exception, match="dimensions"):
        df.select(cosine(F.col("a"), F.col("c"))).collect()


def ranked(spark, *data):
    return spark.createDataFrame([("q", i + 1, c, c.split(":")[0], s) for i, (c, s) in enumerate(data)], RANKED)


def order(df, q="q"):
    return [r.chunk_id for r in df.filter(F.col("query_id") == q).orderBy("rank").collect()]


def test_rrf(spark):
    out = ranking.rrf([ranked(spark, ("sem:0", 0.9), ("shared:0", 0.8)), ranked(spark, ("shared:0", 7.0), ("key:0", 6.0))], 2).orderBy("rank").collect()
    assert [r.chunk_id for r in out] == ["shared:0", "sem:0"] and out[0].score == pytest.approx(1 / 62 + 1 / 61, abs=1e-6)


def test_neighbours(spark):
    c = chunk_table(spark, {f"d:{i}": "t" for i in range(5)})
    assert order(ranking.neighbours(ranked(spark, ("d:1", 2.0), ("d:2", 1.0)), c)) == ["d:1", "d:2", "d:0", "d:3"]
    assert order(ranking.neighbours(ranked(spark, ("d:1", 2.0), ("d:3", 1.0)), c, source_k=1)) == ["d:1", "d:3", "d:0", "d:2"]


def test_parents(spark):
    d = spark.createDataFrame([("d", "x" * 10), ("big", "x" * 5000)], "source_path string, content string")
    r = ranked(spark, ("d:0", 3.0), ("big:1", 2.0), ("d:4", 1.0), ("lost:0", 0.5), ("big:2", 0.4))
    assert order(ranking.parents(r, d, 1000)) == ["d", "big:1", "lost:0", "big:2"] and order(ranking.parents(r, d)) == ["d", "big", "lost:0"]


def test_scope_rerank(spark):
    c = chunk_table(spark, {"a:0": "red red apple", "a:1": "apple pie", "b:0": "red car", "c:0": "blue sky"})
    q = queries(spark, q="red apple", z="unknownword")
    assert order(ranking.scoped(ranking.bm25(q, c, 20), q, ranking.weighted_postings(c), document_k=1)) == ["a:0", "a:1"]
    top = ranking.bm25(q, c, 20)
    assert order(ranking.rerank(top, q, c, 1)) == ["a:0"]
    with pytest.raises(ValueError):
        ranking.leading_sources(top, 0)


def test_subqueries_and_coverage(spark):
    data = [("q", "Main question?", 'Main question?\n1. "supplier name"\n- Supplier Name\n\n```\n2) lead time\n* third\n3. fourth')]
    subs = ranking.parse_subqueries(spark.createDataFrame(data, "query_id string, question string, response string"))
    assert rows(subs) == [("q", 1, "supplier name"), ("q", 2, "lead time"), ("q", 3, "third")]
    tagged = spark.createDataFrame(
        [("q", 0, "m1", "m", 1, 9.0), ("q", 0, "m2", "m", 2, 8.0), ("q", 1, "m1", "m", 1, 5.0), ("q", 1, "s1", "s", 2, 4.0), ("q", 2, "m1", "m", 1, 3.0), ("q", 2, "l1", "l", 2, 2.0)],
        "query_id string, list_no int, chunk_id string, source_path string, rank int, score double",
    )
    fused = ranking.rrf_tagged(tagged, 3)
    assert order(fused)[0] == "m1"
    out = ranking.with_coverage(tagged, fused, 1, 3)
    assert order(out) == ["m1", "l1", next(x for x in order(fused) if x not in ("m1", "l1"))]
    assert order(ranking.with_coverage(tagged, fused, 0, 3)) == order(fused)


def test_multi_hop(spark):
    c = chunk_table(spark, {"a:0": "alpha beta", "b:0": "gamma delta"})
    q = queries(spark, q="alpha", same="gamma", none="beta")
    f = queries(spark, q="gamma", same=" GAMMA ", none=None)
    out = ranking.multi_hop(q, f, lambda x, k: ranking.bm25(x, c, k))
    assert set(order(out)) == {"a:0", "b:0"} and order(out, "same") == ["b:0"] and order(out, "none") == ["a:0"]


def test_strategies_and_models(spark):
    c = chunk_table(spark, {"a:0": "alpha beta", "a:1": "beta", "b:0": "gamma delta"})
    d = spark.createDataFrame([("a", "alpha beta"), ("b", "gamma")], "source_path string, content string")
    q = queries(spark, q="alpha beta")
    for name in ranking.STRATEGIES:
        got = ranking.retrieve(name, q, c, d, hashed_embedding, k=2).orderBy("rank").collect()
        assert got[0].chunk_id in ("a:0", "a"), name
    with pytest.raises(ValueError):
        ranking.retrieve("other", q, c, d, hashed_embedding)

    class Model:
        def embed(self, texts):
            return [[float(len(t)), 1.0] for t in texts]

        def score(self, pairs):
            return [float(len(b)) for _, b in pairs]

    assert rows(c.select(model_embedding(Model)(F.col("text")).alias("e")))[0] == ([10.0, 1.0],)
    assert order(ranking.rerank(ranking.bm25(q, c), q, c, 5, model_pair_score(Model)))[0] == "a:0"


def test_blocks_do_not_matter(spark, monkeypatch):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(30)]
    c = chunk_table(spark, {f"d{i % 40}:{i}": " ".join(rnd.choices(words, k=12)) for i in range(200)})
    q = queries(spark, **{f"q{i}": " ".join(rnd.choices(words, k=4)) for i in range(25)})
    once = rows(ranking.bm25(q, c, 7), "query_id", "rank", "chunk_id", "source_path", "score")
    monkeypatch.setattr(ranking, "BM25_CHUNKS", 17)
    monkeypatch.setattr(ranking, "BM25_QUERIES", 4)
    assert rows(ranking.bm25(q, c, 7), "query_id", "rank", "chunk_id", "source_path", "score") == once and len(once) == 25 * 7


def test_ties_go_to_the_lesser_id(spark):
    rnd = random.Random(0)
    ids = [f"d{i}:0" for i in range(30)]
    rnd.shuffle(ids)
    assert order(ranking.bm25(queries(spark, q="w"), chunk_table(spark, dict.fromkeys(ids, "w")), 4)) == sorted(ids)[:4]


def test_hybrid_finds_what_only_vectors_find(spark):
    c = chunk_table(spark, {"a:0": "alpha beta", "b:0": "gamma delta"})
    q = queries(spark, q="gamma", unknown="退款")
    assert order(ranking.bm25(q, c), "unknown") == []
    got = ranking.hybrid(q, c, hashed_embedding)
    assert order(got)[0] == "b:0" and order(got, "unknown") == ["a:0", "b:0"]
    best = {r.query_id: r.score for r in got.filter("rank = 1").collect()}
    assert best["q"] == pytest.approx(2 / 61, abs=1e-6) and best["unknown"] == pytest.approx(1 / 61, abs=1e-6)
    with pytest.raises(ValueError):
        ranking.hybrid(q, c, hashed_embedding, 21)


def test_stages_compose(spark):
    texts = {"a:0": "alpha beta", "a:1": "alpha omega", "b:0": "gamma delta", "c:0": "epsilon zeta", "c:1": "eta", "d:0": "theta iota"}
    c = chunk_table(spark, texts)
    d = spark.createDataFrame([(s, "x" * n) for s, n in (("a", 9), ("b", 9), ("c", 99), ("d", 9))], "source_path string, content string")
    q = queries(spark, q="alpha beta", alone="theta iota")
    subs = spark.createDataFrame([("q", 1, "gamma delta"), ("q#followup", 1, "eta")], "query_id string, sub_no int, text string")
    hops = queries(spark, q="epsilon zeta", alone=" THETA iota ")
    go = lambda s, k=6, **o: ranking.retrieve(s, q, c, d, hashed_embedding, k, 6, subqueries=subs, followups=hops, **o)
    score = lambda df: {(r.query_id, r.chunk_id): r.score for r in df.collect()}
    one = lambda text, n=6: [r.chunk_id for r in ranking.hybrid(queries(spark, q=text), c, hashed_embedding, n, 6).orderBy("rank").collect()]

    def fuse(*lists):
        s = {i: round(sum(1 / (60 + x.index(i) + 1) for x in lists if i in x), 6) for i in texts}
        return sorted(s, key=lambda i: (-s[i], i)), s

    asked, asked_scores = fuse(one("alpha beta"), one("gamma delta"))
    hop, _ = fuse(one("epsilon zeta"), one("eta"))
    got = score(go("hybrid-decomposed"))
    assert {i: got["q", i] for i in texts} == pytest.approx(asked_scores, abs=2e-6) and order(go("hybrid-decomposed")) == asked
    assert order(go("hybrid-decomposed", 2, coverage_per_query=1))[0] == "b:0"
    assert order(go("hybrid-decomposed", 2, coverage_per_query=1), "alone")[0] == "d:0"
    both, both_scores = fuse(asked, hop)
    many = go("hybrid-decomposed-multihop")
    assert {i: score(many)["q", i] for i in texts} == pytest.approx(both_scores, abs=2e-6) and order(many) == both
    assert order(many, "alone") == order(go("hybrid-decomposed"), "alone")  # its follow-up is the question itself
    assert set(order(go("hybrid-decomposed-reranked", 1))) == {"a:0"}

    scoped = go(("hybrid", "decompose", "multihop", "scoped"), document_k=1)
    assert {i.split(":")[0] for i in order(scoped)} == {both[0].split(":")[0]}
    full = go(("hybrid", "decompose", "multihop", "scoped", "rerank", "parent", "neighbor"), 4, document_k=2, max_characters=50)
    rest = order(full)
    places = {i.split(":")[0] for i in order(go(("hybrid", "decompose", "multihop", "scoped"), document_k=2))}
    assert len(places) == 2 and {i.split(":")[0] for i in rest} == places and ("a" in rest or "b" in rest)
    assert all(r.source_path == r.chunk_id.split(":")[0] for r in full.collect())
    for bad in (("hybrid", "rerank", "decompose"), ("rerank",), ()):
        with pytest.raises(ValueError):
            go(bad)
    with pytest.raises(ValueError):
        ranking.retrieve("hybrid-decomposed", q, c, d, hashed_embedding)


def test_searches_are_equi_joins_in_blocks(spark):
    c = chunk_table(spark, TEXTS)
    q = queries(spark, q="form hotels", r="trains")
    for df in (ranking.bm25(q, c), ranking.nearest(q.select("query_id", hashed_embedding(F.col("text")).alias("embedding")), c.select("chunk_id", hashed_embedding(F.col("text")).alias("embedding")))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "FlatMapCoGroupsInArrow" in plan


@pytest.mark.parametrize("positive", [False, True])
def test_best_cells(positive):
    rnd = np.random.default_rng(4)
    scores = rnd.integers(-2, 5, (20, 30)) / 2
    for k in (1, 4, 30, 50):
        r, c, s = ranking.best_cells(scores, k, positive)
        got = sorted(zip(r.tolist(), (-s).tolist(), c.tolist()))
        want = [(i, *x) for i in range(20) for x in sorted((-scores[i, j], j) for j in range(30) if not positive or scores[i, j] > 0)[:k]]
        assert got == sorted(want)


@pytest.mark.parametrize("shares", [(1.0,), (0.3,), (0.05,), (0.0,)])
def test_rare_terms_over_common_ones(spark, monkeypatch, shares):
    """All terms rare, all common, and mixtures give what a loop over all pairs gives."""
    monkeypatch.setattr(ranking, "COMMON_SHARES", shares)
    monkeypatch.setattr(ranking, "BATCH_QUERIES", 3)
    monkeypatch.setattr(ranking, "BATCH_PAIRS", 10)
    monkeypatch.setattr(ranking, "BM25_CHUNKS", 40)
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(12)] + [f"r{i}" for i in range(60)]
    texts = {f"d{i:03d}:0": " ".join(rnd.choice(words[:12] if rnd.random() < 0.8 else words) for _ in range(9)) for i in range(150)}
    asked = {f"q{i}": " ".join(rnd.sample(words[:4], 2) + rnd.sample(words, 2)) for i in range(30)} | {"only": "r1 r2", "none": "x y", "same": "w0 w1 R3", "again": "r3 w1 w0 w1 unknown"}
    c = chunk_table(spark, texts)
    weight = {}
    for r in ranking.weighted_postings(c).collect():
        weight.setdefault(r.chunk_id, {})[r.token] = r.weight
    got = {}
    for r in ranking.bm25(queries(spark, **asked), c, 4).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.chunk_id, r.score)
    for q, text in asked.items():
        score = {i: round(sum(w.get(t, 0.0) for t in set(text.lower().split())), 6) for i, w in weight.items()}
        want = sorted((-s, i) for i, s in score.items() if s > 0)[:4]
        assert [got.get(q, {})[k] for k in range(1, len(want) + 1)] == [(i, pytest.approx(-s, abs=2e-6)) for s, i in want] and len(got.get(q, {})) == len(want), q


def searched(monkeypatch):
    """How many rows each search is given to look for."""
    seen, plain = [], ranking.in_blocks
    monkeypatch.setattr(ranking, "in_blocks", lambda q, *a: seen.append(q.count()) or plain(q, *a))
    return seen


def test_shared_texts_are_searched_once(spark, monkeypatch):
    """decompose_hybrid_rrf: questions share sub-queries, vectors and terms."""
    c = chunk_table(spark, {"a:0": "alpha beta", "b:0": "gamma delta", "c:0": "alpha gamma"})
    every = ranking.with_subqueries(queries(spark, p="alpha one", q="alpha two"), spark.createDataFrame([(i, n, t) for i in "pq" for n, t in ((1, "gamma"), (2, "Gamma!"))], "query_id string, sub_no int, text string"))
    seen = searched(monkeypatch)
    vectors, index = c.select("chunk_id", "source_path", hashed_embedding(F.col("text")).alias("embedding")), ranking.build_index(c)
    once = ranking.lists_of_texts(every, lambda q: ranking.hybrid_indexed(q, vectors, index, hashed_embedding, 3))
    assert seen == [3, 2]  # vectors of "alpha one", "alpha two", "gamma"; terms in the index: alpha, gamma
    each = ranking.lists_of(every, ranking.hybrid_indexed(every.select("query_id", "text"), vectors, index, hashed_embedding, 3))
    assert rows(once) == rows(each, *once.columns) and once.count() == 18


def test_follow_ups_of_same_terms_are_searched_once(spark, monkeypatch):
    """multihop_evidence_rrf: the follow-ups of many questions are the same passages' lines."""
    c = chunk_table(spark, {"a:0": "alpha beta\nlast", "b:0": "beta gamma", "c:0": "delta"})
    q = queries(spark, **{f"q{i}": f"alpha beta unknown{i}" for i in range(20)})
    seen = searched(monkeypatch)
    index = ranking.build_index(c)
    got = ranking.multi_hop_from_evidence(q, c, lambda x, k: ranking.bm25_indexed(x, index, k), lambda question, evidence: F.regexp_extract(evidence, r"\]\n([^\n]*)", 1))
    assert got.count() == 40 and seen == [1, 1] and order(got, "q7") == ["a:0", "b:0"]


def test_best_cells_of_wide_rows():
    rnd = np.random.default_rng(5)
    for scores in (rnd.integers(0, 4, (7, 1000)) / 4, rnd.random((7, 1003)), np.zeros((2, 900))):
        for k in (1, 20, 100):
            for positive in (False, True):
                r, c, s = ranking.best_cells(scores, k, positive)
                micro = np.rint(scores * 1e6).astype(int)
                want = [(i, -x[0] / 1e6, x[1]) for i in range(len(scores)) for x in sorted((-micro[i, j], j) for j in range(scores.shape[1]) if not positive or micro[i, j] > 0)[:k]]
                assert sorted(zip(r.tolist(), c.tolist(), s.tolist())) == sorted((i, j, x) for i, x, j in want)


def test_index_is_made_without_shuffling_postings(spark, monkeypatch):
    """multihop_evidence_rrf: a chunk's terms are counted where it is; rows of the same chunk count as one text, as in SQL."""
    c = chunk_table(spark, {"a:0": "alpha beta alpha", "b:0": "beta", "c:0": "", "d:0": None})
    assert "Exchange hashpartitioning" not in ranking.weighted_postings(c)._jdf.queryExecution().executedPlan().toString()
    c = c.unionByName(chunk_table(spark, {"a:0": "alpha gamma beta"}))
    got = {(r.chunk_id, r.token): r.weight for r in ranking.weighted_postings(c).collect()}
    df, dl, tf = {"alpha": 1, "beta": 2, "gamma": 1}, {"a:0": 3, "b:0": 1}, {("a:0", "alpha"): 3, ("a:0", "beta"): 2, ("a:0", "gamma"): 1, ("b:0", "beta"): 1}
    want = {(i, t): math.log(1 + (5 - df[t] + 0.5) / (df[t] + 0.5)) * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * dl[i] / (7 / 5))) for (i, t), n in tf.items()}
    assert got == {k: pytest.approx(v, rel=1e-12) for k, v in want.items()}
    monkeypatch.setattr(ranking, "FREQUENCY_ROWS", 0)
    assert {(r.chunk_id, r.token): r.weight for r in ranking.weighted_postings(c).collect()} == got
