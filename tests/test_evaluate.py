import math

import pytest
from pyspark.sql import functions as F

from folioforge.operators import answers, evaluate
from tests.conftest import rows

CHUNKS = "array<struct<chunk_id:string,source_path:string,rank:int,score:double>>"
PAIR = f"trace_id int, answerable boolean, source_files array<string>, concept string, retrieved_chunks {CHUNKS}, answer string, error string"


def pair(i, chunks, wanted=("b.md",), answer="x [S1]", answerable=True, error=None):
    return (i, answerable, list(wanted) if wanted is not None else None, "c", None if chunks is None else [(f"{s}:{r}", s, r, 1.0) for r, s in chunks], answer, error)


def test_retrieval_metrics(spark):
    data = [pair(1, [(1, "a.md"), (2, "a.md"), (3, "b.md")]), pair(2, [(1, "a.md")], answerable=False), pair(3, [], ()), pair(4, None), pair(5, [(2, "b.md"), (1, "z.md")], error="down")]
    df = evaluate.retrieval_metrics(spark.createDataFrame(data, PAIR))
    got = {r.trace_id: (r.precision_at_k, r.recall_at_k, r.reciprocal_rank, r.ndcg_at_k) for r in df.collect()}
    assert got[1] == pytest.approx((0.2, 1.0, 0.5, 1 / math.log2(3)))
    assert got[2] == (None,) * 4 and got[3] == (0.0, None, 0.0, None) and got[4] == (0.0, 0.0, 0.0, 0.0)
    s = evaluate.retrieval_summary(df).head()
    assert (s.question_count, s.answerable_count, s.error_count) == (5, 4, 1) and s.recall_at_k == pytest.approx(0.25)
    assert evaluate.retrieval_summary(df.limit(0)).head().recall_at_k == 0.0


def test_scorecard_uses_chunk_ranks(spark):
    data = [pair(1, [(1, "a.md"), (2, "a.md"), (3, "b.md")]), pair(2, [(1, "b.md")]), pair(3, [(9, "b.md")]), pair(4, [(1, "q.md")])]
    card = evaluate.concept_scorecard(spark.createDataFrame(data, PAIR)).head()
    assert (card.questions, card.hit_at_1, card.hit_at_k, card.missing) == (4, 1, 2, 1) and card.mrr == pytest.approx((1 / 3 + 1) / 4)
    line = evaluate.format_scorecard(evaluate.concept_scorecard(spark.createDataFrame(data, PAIR))).head().line
    assert line.split() == ["c", "4", "1", "2", "1", "0.333"]


def test_answers(spark):
    ch = [(1, "b.md"), (2, "c.md")]
    data = [
        pair(1, ch), pair(2, ch, answer="x [S3]"), pair(3, ch, answer="none"), pair(4, ch, answer=answers.REFUSAL, answerable=False), pair(5, ch, answer=None, error="e"),
        pair(6, ch, answer="[b.md:1] and [S2]"), pair(7, None, answer="[S1]"), pair(8, ch, answer="[S2]", wanted=None),
    ]
    got = {r.trace_id: (r.produced_answer, r.refused, r.citations_valid, r.cites_expected_source) for r in evaluate.answer_metrics(spark.createDataFrame(data, PAIR)).collect()}
    assert got[1] == (True, False, True, True) and got[2] == (True, False, False, False) and got[3] == (True, False, False, False)
    assert got[4] == (False, True, False, False) and got[5] == (False, False, False, False) and got[6][2:] == (True, True)
    assert got[7][2:] == (False, False) and got[8][2:] == (True, False)


def test_grounding(spark):
    p = [(1, "c1"), (2, "c2")]
    data = [(1, "a [S2] [S1] [S2]", p), (2, "a [S9] [S7]", p), (3, "a", p), (4, answers.REFUSAL, p), (5, "a [S1]", []), (6, None, p), (7, "x", None)]
    df = answers.ground(spark.createDataFrame(data, "i int, answer string, passages array<struct<rank:int,chunk_id:string>>"))
    got = {r.i: (r.grounding_error, r.cited_chunk_ids, r.final_answer) for r in df.collect()}
    assert got[1] == (None, ["c2", "c1"], "a [S2] [S1] [S2]") and got[2][0].endswith("S7, S9") and "no context citations" in got[3][0]
    assert got[4][0] is None and got[5] == (None, [], answers.REFUSAL) and got[6][0] is not None and got[7][2] == answers.REFUSAL


def test_judge(spark):
    good = '{"correct": true, "citation_supported": false, "used_correct_version": true, "proper_refusal": false, "reason": "r"}'
    data = [
        (1, True, "a", None, "text " + good + " more"), (2, True, "a", None, good.replace("true", '"true"')), (3, True, "a", None, "no json"), (4, True, "a", None, good.replace('"r"', '" "')),
        (5, True, "a", "boom", good), (6, False, answers.REFUSAL, None, None), (7, True, answers.REFUSAL, None, None), (8, True, "a", None, good.replace("true", "1")), (9, True, "a", None, good.replace('"r"', "3")),
    ]
    df = answers.judge(spark.createDataFrame(data, "i int, answerable boolean, answer string, trace_error string, response string"))
    got = {r.i: r for r in df.collect()}
    assert got[1].correct and not got[1].citation_supported and got[1].error is None
    assert all(got[i].failure_stage == "judge" for i in (2, 3, 4, 7, 8, 9)) and got[5].failure_stage == "pipeline" and got[5].error == "Pipeline error: boom"
    assert got[6].correct and got[6].proper_refusal and got[6].error is None
    s = evaluate.judgement_summary(df).head()
    assert (s.error_count, s.pipeline_error_count, s.judged_answerable_question_count, s.correctness_rate, s.proper_refusal_rate) == (7, 1, 1, 1.0, 1.0)


def both(spark, a, b):
    schema = "question_id string, correct boolean, citation_supported boolean, used_correct_version boolean, proper_refusal boolean, error string"
    make = lambda d: spark.createDataFrame([(k, v, True, True, False, e) for k, v, e in d], schema)
    return evaluate.paired(make(a), make(b))


def test_agreement_and_runs(spark):
    k = lambda a, b: {r.label: r.kappa for r in evaluate.agreement(both(spark, [(str(i), v, None) for i, v in enumerate(a)], [(str(i), v, None) for i, v in enumerate(b)])).collect()}
    assert k([True, False], [True, False])["correct"] == 1 and k([True, False], [False, True])["correct"] == -1
    assert k([True, True, False, False], [True, False, True, False])["correct"] == 0 and k([True, False], [True, False])["citation_supported"] == 1
    pairs = both(spark, [("1", True, None), ("2", False, None), ("3", True, "e"), ("4", True, None)], [("1", False, None), ("2", True, None), ("3", True, None), ("5", True, None)])
    assert rows(pairs.filter("compared"), "question_id") == [("1",), ("2",)]
    r = {x.label: x for x in evaluate.compare_runs(pairs).collect()}["correct"]
    assert (r.fixed_count, r.broken_count, r.churn, r.rate_change, r.p_value) == (1, 1, 2, 0.0, pytest.approx(1.0))
    assert rows(evaluate.changed(pairs)) == [("correct", "1", "broken"), ("correct", "2", "fixed")]
    assert evaluate.compare_runs(both(spark, [], [])).count() == 0


def test_mcnemar_against_exact(spark):
    data = [(f, b) for f in (0, 1, 2, 8, 30, 700) for b in (0, 1, 9, 650)]
    df = spark.createDataFrame(data, "f long, b long").withColumn("p", evaluate.mcnemar(F.col("f"), F.col("b")))
    for r in df.collect():
        n, m = r.f + r.b, min(r.f, r.b)
        want = 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(m + 1)) / 2**n if n < 1000 else 2 * float(sum(math.comb(n, i) for i in range(m + 1)) / (1 << n)))
        assert r.p == pytest.approx(want, rel=1e-6)
    assert df.filter("f = 8 and b = 0").head().p == pytest.approx(2 / 256)


def test_missing_traces_and_rounding(spark):
    g = spark.createDataFrame([("a",), ("b",)], "id string")
    with pytest.raises(evaluate.Incomplete, match="b"):
        evaluate.require_traces(g, spark.createDataFrame([("a",)], "question_id string"))
    ms = spark.createDataFrame([(500_000,), (1_500_000,), (2_500_000,), (None,)], "n long").select(answers.milliseconds(F.col("n")))
    assert [r[0] for r in ms.collect()] == [0, 2, 2, None]
