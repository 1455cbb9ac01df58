import pytest
from pyspark.sql import functions as F

from folioforge.functions.vectors import hashed_embedding, model_completion
from folioforge.operators import chunking, ranking, runs, sync
from folioforge.operators.answers import REFUSAL
from folioforge.sources import jsonl
from folioforge.sources.store import Settings, VectorTable
from tests.conftest import rows

RANKED = "query_id string, rank int, chunk_id string, source_path string, score double, text string, question string, error string"
GOLD = "id string, question string, expected_answer string, source_files array<string>, answerable boolean, rank int, error string"


class Model:
    def complete(self, *, system_prompt, user_prompt):
        if "broken" in user_prompt:
            raise TimeoutError("slow")
        return "It is nine [S1]." if "nine" in user_prompt else "It is not said."


def ranked(spark, data):
    return spark.createDataFrame([(q, r, c, c.split(":")[0] if p else None, 1.0 / r, t, "clash", "clash") for q, r, c, p, t in data], RANKED)


def gold(spark, *data):
    return spark.createDataFrame([(i, q, "x", s, a, 1, "clash") for i, q, s, a in data], GOLD)


LISTS = [("a", 1, "d1:0", True, "nine days"), ("a", 2, "d2:0", True, "other"), ("b", 1, "d1:0", True, "eight days"), ("c", 1, "d1:0", True, "broken text")]


def test_answers_with_errors_in_their_rows(spark):
    q = spark.createDataFrame([("a", "how long"), ("b", "how far"), ("c", "why"), ("d", "nothing found")], "query_id string, text string")
    got = {r.question_id: r for r in runs.answer_questions(q, ranked(spark, LISTS), model_completion(Model), config={"k": "1"}).collect()}
    assert (got["a"].answer, got["a"].error, got["a"].cited_chunk_ids) == ("It is nine [S1].", None, ["d1:0"]) and [c.chunk_id for c in got["a"].retrieved_chunks] == ["d1:0", "d2:0"]
    assert got["b"].answer is None and got["b"].error == "GroundingError: Model answer has no context citations" and "eight days" in got["b"].context_sent_to_model
    assert got["c"].answer is None and got["c"].error == "TimeoutError: slow" and len(got["c"].retrieved_chunks) == 1
    assert got["d"].answer == REFUSAL and got["d"].error is None and got["d"].retrieved_chunks == []
    assert runs.answer_questions(q.limit(0), ranked(spark, LISTS), model_completion(Model)).count() == 0


def test_evaluate_retrieval(spark):
    g = gold(spark, ("a", "how long", ["d2"], True), ("b", "how far", ["d9"], True), ("z", None, [], False))
    traces, metrics, summary = runs.evaluate_retrieval(g, ranked(spark, LISTS), 2)
    got = {r.question_id: r for r in metrics.collect()}
    assert traces.count() == 3 and (got["a"].precision_at_k, got["a"].recall_at_k, got["a"].reciprocal_rank) == (0.5, 1.0, 0.5)
    assert got["z"].precision_at_k is None and got["z"].retrieved_chunks == [] and got["b"].reciprocal_rank == 0.0
    s = summary.head()
    assert (s.question_count, s.answerable_count, s.recall_at_k) == (3, 2, 0.5)


def test_passages_and_trace_chunks(spark):
    m = spark.createDataFrame([("c", 0.5, {"text": "t", "source_path": "p"})], "id string, score double, metadata map<string,string>")
    assert rows(runs.passages_of(m)) == [("c", "t", 0.5, {"source_path": "p"})]
    for bad in ({"id": None}, {"metadata": {"source_path": "p"}}):
        row = {"id": "c", "score": 0.5, "metadata": {"text": "t"}} | bad
        with pytest.raises(Exception, match="match without"):
            runs.passages_of(spark.createDataFrame([tuple(row.values())], m.schema)).collect()
    with pytest.raises(Exception, match="no source path"):
        runs.trace_chunks(ranked(spark, [("a", 1, "d1:0", False, "t")])).collect()


def test_judging_again(spark):
    class Judge:
        def complete(self, *, system_prompt, user_prompt):
            if "broken" in user_prompt:
                raise ValueError("bad")
            return '{"correct": true, "citation_supported": true, "used_correct_version": true, "proper_refusal": false, "reason": "ok"}'

    g = gold(spark, ("a", "how long", [], True), ("b", "how far", [], False), ("c", "broken?", [], True), ("z", "not run", [], True))
    t = spark.createDataFrame([("a", "how long", "It is.", "ctx", None), ("b", "how far", REFUSAL, "ctx", None), ("c", "broken?", "x", None, None)], "question_id string, question string, answer string, context_sent_to_model string, error string")
    verdicts, summary = runs.rejudge(g, t, model_completion(Judge))
    got = {r.question_id: (r.correct, r.error, r.failure_stage) for r in verdicts.collect()}
    assert got == {"a": (True, None, None), "b": (True, None, None), "c": (False, "ValueError: bad", "judge")}
    assert summary.head().judge_error_count == 1
    with pytest.raises(ValueError, match="Missing answer traces"):
        runs.judge_traces(g, t, model_completion(Judge))
    with pytest.raises(ValueError, match="No gold question"):
        runs.rejudge(g.filter("id = 'z'"), t, model_completion(Judge))


def test_first_rows(spark, tmp_path):
    jsonl.write_lines(spark.range(20).selectExpr("cast(id as string) as question_id", "'q' as question").coalesce(1), f"{tmp_path}/t")
    assert [r.question_id for r in runs.first_rows(jsonl.read_traces(spark, f"{tmp_path}/t"), 3).collect()] == ["0", "1", "2"]
    with pytest.raises(ValueError):
        runs.first_rows(spark.range(3), 0)


def test_followups_from_evidence(spark):
    c = spark.createDataFrame([("a:0", "a", 0, "supplier of pumps\nlead"), ("b:0", "b", 0, "lead time of the supplier"), ("c:0", "c", 0, "nothing")], "chunk_id string, source_path string, chunk_index int, text string")
    q = spark.createDataFrame([("q", "pumps"), ("same", "nothing"), ("none", "zzz")], "query_id string, text string")
    first_line = lambda question, evidence: F.regexp_extract(evidence, r"\A\[Evidence 1\]\n([^\n]*)", 1)
    got = ranking.multi_hop_from_evidence(q, c, lambda qs, k: ranking.bm25(qs, c, k), first_line)
    assert [r.chunk_id for r in got.filter("query_id = 'q'").orderBy("rank").collect()] == ["a:0", "b:0"]
    assert rows(got.filter("query_id <> 'q'"), "query_id", "chunk_id") == [("same", "c:0")]


def test_filter_in_every_pass(spark):
    texts = {"a:0": "pump valve", "a:1": "pump oil", "b:0": "pump valve", "b:1": "valve"}
    c = spark.createDataFrame([(i, i[0], int(i[2]), t, "current" if i[0] == "b" else "old") for i, t in texts.items()], "chunk_id string, source_path string, chunk_index int, text string, status string")
    d = spark.createDataFrame([("a", "A"), ("b", "B")], "source_path string, content string")
    q = spark.createDataFrame([("q", "pump valve")], "query_id string, text string")
    got = ranking.retrieve(("hybrid", "scoped"), q, c, d, hashed_embedding, keep=F.col("status") == "current")
    assert {r.source_path for r in got.collect()} == {"b"} and got.count() == 2


def test_parents_with_their_text(spark):
    c = spark.createDataFrame([("a:0", "a", 0, "part"), ("b:0", "b", 0, "other part")], "chunk_id string, source_path string, chunk_index int, text string")
    d = spark.createDataFrame([("a", "the whole"), ("b", "x" * 50)], "source_path string, content string")
    p = ranking.parents(ranked(spark, [("q", 1, "a:0", True, "t"), ("q", 2, "b:0", True, "t")]).drop("text"), d, 20)
    assert rows(ranking.with_parent_text(p, d, c), "rank", "chunk_id", "text") == [(1, "a", "the whole"), (2, "b:0", "other part")]


def corpus(spark, **texts):
    return spark.createDataFrame([(p, t, "D", "1", {"m": m}) for p, (t, m) in texts.items()], "source_path string, content string, doc_id string, version string, metadata map<string,string>")


def test_index_build_and_synchronization_write_the_manifest_last(spark, tmp_path):
    store = VectorTable(spark, Settings(f"file://{tmp_path}/store", "i"), dimension=64).ensure()
    layout = lambda docs: chunking.chunk_table(docs, chunking.fixed_chunks(F.col("content"), 5), "fixed-size-v1")
    path = f"file://{tmp_path}/manifest.json"
    save = lambda m: jsonl.write_manifest_json(m, path, {"size": "5"})
    now = F.lit("2026-01-01T00:00:00+00:00")
    stored = lambda: {r.chunk_id: (r.text, [round(x, 6) for x in r.embedding]) for r in store.read("default").collect()}

    old = corpus(spark, a=("aaaaabbbbbcc", "1"), b=("bbbbb", "1"), c=("ccccc", "1"), d=("ddddd", "1"))
    assert sync.build_index(old, layout(old), hashed_embedding, store) == (4, 6) == sync.build_index(old, layout(old), hashed_embedding, store)
    assert len(stored()) == 6 and jsonl.read_manifest(spark, path) is None
    none = old.limit(0).select("source_path", F.lit("").alias("content_sha256"), F.lit("").alias("metadata_sha256"), F.array().cast("array<string>").alias("chunk_ids"), F.lit("").alias("indexed_at"))
    sync.synchronize(old, none, layout(old), hashed_embedding, store, save, now)
    manifest, config = jsonl.read_manifest(spark, path)
    assert config == {"size": "5"} and {r.source_path: len(r.chunk_ids) for r in manifest.collect()} == {"a": 3, "b": 1, "c": 1, "d": 1}

    new = corpus(spark, a=("aaaaaxx", "1"), b=("bbbbb", "2"), c=("ccccc", "1"), e=("eeeee", "1"))
    calls = spark.sparkContext.accumulator(0)
    count = F.udf(lambda t: (calls.add(1), t)[1])
    embed = lambda t: hashed_embedding(count(t))
    assert rows(sync.synchronize(new, manifest, layout(new), embed, store, save, now, dry_run=True)) == [("a", "content"), ("b", "metadata"), ("c", "unchanged"), ("d", "deleted"), ("e", "new")]
    assert calls.value == 0 and len(stored()) == 6

    def fail(m):
        raise OSError("disk")

    with pytest.raises(OSError):
        sync.synchronize(new, manifest, layout(new), embed, store, fail, now)
    again, _ = jsonl.read_manifest(spark, path)
    assert rows(again, "source_path", "content_sha256") == rows(manifest, "source_path", "content_sha256")
    sync.synchronize(new, again, layout(new), embed, store, save, now)
    assert {k: t for k, (t, _) in stored().items()} == {"a:0000": "aaaaa", "a:0001": "xx", "b:0000": "bbbbb", "c:0000": "ccccc", "e:0000": "eeeee"}
    last, _ = jsonl.read_manifest(spark, path)
    assert {r.source_path for r in last.collect()} == {"a", "b", "c", "e"}
    assert {r.kind for r in sync.synchronize(new, last, layout(new), embed, store, save, now).collect()} == {"unchanged"}


def test_manifest_is_checked(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"index_config": {}, "documents": []}')
    with pytest.raises(ValueError, match="schema_version"):
        jsonl.read_manifest(spark, f"file://{tmp_path}/m.json")
    (tmp_path / "n.json").write_text('{"schema_version": 1, "index_config": {}, "documents": [{"source_path": "a"}]}')
    with pytest.raises(Exception, match="manifest entry without"):
        jsonl.read_manifest(spark, f"file://{tmp_path}/n.json")[0].collect()
