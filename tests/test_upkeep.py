import pytest
from pyspark.sql import functions as F

from folioforge.operators import agent, sync
from folioforge.sources import corpus, jsonl
from folioforge.sources.store import Settings, VectorTable
from tests.conftest import rows

DOC = "source_path string, content string, doc_id string, version string, metadata map<string,string>"


def test_sync_plan_and_manifest(spark):
    now = spark.createDataFrame([("new", "n", None, None, {}), ("con", "x", "d", "1", {"b": "2", "a": None}), ("met", "y", "d", "1", {"a": "1"}), ("same", None, "d", "1", None)], DOC)
    before = spark.createDataFrame([("con", "old", "d", "1", {"a": None, "b": "2"}), ("met", "y", "d", "1", {"a": ""}), ("same", None, "d", "1", None), ("gone", "z", "d", "1", {})], DOC)
    manifest = sync.hashes(before).withColumn("chunk_ids", F.array(F.concat("source_path", F.lit(":0000")))).withColumn("indexed_at", F.lit("t0"))
    assert rows(sync.plan(now, manifest)) == [("con", "content"), ("gone", "deleted"), ("met", "metadata"), ("new", "new"), ("same", "unchanged")]
    assert {k for _, k in rows(sync.plan(now, manifest, config_changed=True))} == {"content", "deleted", "new"}
    assert {k for _, k in rows(sync.plan(now, manifest.limit(0)))} == {"new"}
    chunks = spark.createDataFrame([("con:0000", "con", 0, "x"), ("con:0001", "con", 1, "x"), ("met:0000", "met", 0, "y"), ("new:0000", "new", 0, "n")], "chunk_id string, source_path string, chunk_index int, text string")
    assert rows(sync.stale_chunks(manifest, chunks)) == [("gone", "gone:0000"), ("same", "same:0000")]
    stored = spark.createDataFrame([("met:0000", [1.0])], "chunk_id string, embedding array<double>")
    done = sync.apply_plan(sync.plan(now, manifest), stored, chunks, lambda t: F.array(F.length(t).cast("double") + 10))
    assert rows(done, "chunk_id", "embedding") == [("con:0000", [11.0]), ("con:0001", [11.0]), ("met:0000", [1.0]), ("new:0000", [11.0])]
    with pytest.raises(Exception, match="no stored vector"):
        sync.apply_plan(sync.plan(now, manifest), stored.limit(0), chunks, lambda t: F.array(F.lit(1.0))).collect()
    made = sync.new_manifest(now, sync.plan(now, manifest), manifest, chunks, F.lit("t1"))
    assert rows(made, "source_path", "chunk_ids", "indexed_at") == [("con", ["con:0000", "con:0001"], "t1"), ("met", ["met:0000"], "t1"), ("new", ["new:0000"], "t1"), ("same", ["same:0000"], "t0")]


def files(tmp_path, **texts):
    root = tmp_path / "data"
    (root / "policies").mkdir(parents=True)
    for name, text in texts.items():
        (root / "policies" / f"{name}.md").write_text(text, encoding="utf-8")
    return str(root)


def test_markdown_scan(spark, tmp_path):
    root = files(
        tmp_path, one='---\ndoc_id: POL-1\nversion: "2.1"  # quoted\nstatus: current\neffective_date: 2024-01-01\nempty:\nnote: a: b\n---\n\n# Title\n\nBody --- here\n---\nmore\n',
        two="---\ndoc_id: 'POL-1'\nstatus: superseded\n---\nOld\n",
    )
    got = {r.source_path: r for r in corpus.read_markdown(spark, root).collect()}
    one = got["data/policies/one.md"]
    assert one.content == "# Title\n\nBody --- here\n---\nmore" and one.version == "2.1" and str(one.effective_date) == "2024-01-01" and one.metadata["note"] == "a: b" and one.metadata["empty"] is None
    assert got["data/policies/two.md"].doc_id == "POL-1" and got["data/policies/two.md"].version is None
    pytest.importorskip("yaml")
    nested = files(tmp_path / "general", n='---\ndoc_id: POL-9\ntags: [a, b]\neffective_date: 2024-01-01\nversion: "1"\n---\nText\n')
    r = corpus.read_markdown(spark, nested, general=True).head()
    assert r.metadata["tags"] == '["a", "b"]' and str(r.effective_date) == "2024-01-01" and r.content == "Text"


def test_unclosed_front_matter(spark, tmp_path):
    with pytest.raises(Exception, match="front matter"):
        corpus.read_markdown(spark, files(tmp_path, bad="---\ndoc_id: x\nno end")).collect()


def test_json_lines(spark, tmp_path):
    q = tmp_path / "q.jsonl"
    q.write_text('{"id":"1","question":"é?","expected_answer":"a","source_files":["x"],"concept":"c","difficulty":"d","answerable":true}\n\n', encoding="utf-8")
    r = jsonl.read_questions(spark, str(q)).head()
    assert (r.question, r.distractor_files, r.note) == ("é?", [], None)
    q.write_text('{"id":"1"}\n')
    with pytest.raises(Exception, match="question without"):
        jsonl.read_questions(spark, str(q)).collect()
    q.write_text("nonsense\n")
    with pytest.raises(Exception):
        jsonl.read_questions(spark, str(q)).collect()
    t = tmp_path / "t.jsonl"
    t.write_text('{"question_id":"1","question":"q","retrieved_chunks":[{"chunk_id":"a:0","source_path":"a","rank":1,"score":0.5}],"answer":null}\n')
    traces = jsonl.read_traces(spark, str(t))
    jsonl.write_lines(traces, str(tmp_path / "out"))
    again = jsonl.read_traces(spark, str(tmp_path / "out")).head()
    assert again == traces.head() and again.queries_used == []
    assert jsonl.read_verdicts(spark, str(t)).head().error is None
    assert jsonl.read_manifest(spark, str(tmp_path / "none.json")) is None
    m = tmp_path / "m.json"
    m.write_text('{"schema_version": 1, "index_config": {"chunk_size": "500"},\n "documents": [{"source_path": "a", "content_sha256": "x", "metadata_sha256": "y", "chunk_ids": ["a:0"], "indexed_at": "t"}]}')
    entries, config = jsonl.read_manifest(spark, str(m))
    assert entries.head().chunk_ids == ["a:0"] and config == {"chunk_size": "500"}
    jsonl.write_manifest(entries, str(tmp_path / "manifest"), config)
    assert jsonl.read_manifest_table(spark, str(tmp_path / "manifest")).head().index_config == config


def test_vector_table(spark, tmp_path):
    with pytest.raises(ValueError, match="FOLIOFORGE_INDEX"):
        Settings.from_environment({"FOLIOFORGE_ROOT": "x"})
    t = VectorTable(spark, Settings(f"file://{tmp_path}", "ix"), 2).ensure().ensure()
    row = lambda i, v: (i, "p", 0, "t", v)
    make = lambda *r: spark.createDataFrame(list(r), "chunk_id string, source_path string, chunk_index int, text string, embedding array<double>")
    t.upsert(make(row("a", [1.0, 0.0]), row("b", [0.0, 1.0])))
    t.upsert(make(row("a", [5.0, 5.0])))
    t.upsert(make(row("a", [9.0, 9.0])), "other")
    assert rows(t.read("default"), "chunk_id", "embedding") == [("a", [5.0, 5.0]), ("b", [0.0, 1.0])]
    t.delete(spark.createDataFrame([("a",)], "chunk_id string"))
    assert rows(t.read(), "chunk_id", "namespace") == [("a", "other"), ("b", "default")]
    ids = spark.createDataFrame([("b",), ("zz",)], "chunk_id string")
    assert t.fetch(ids.limit(1)).count() == 1
    with pytest.raises(Exception, match="no stored vector"):
        t.fetch(ids).collect()
    with pytest.raises(Exception, match="dimensions"):
        t.upsert(make(row("c", [1.0])))
    assert rows(t.read("default"), "chunk_id") == [("b",)]  # the failed write left nothing


def message(role, *blocks):
    full = [{"text": None, "toolUse": None, "toolResult": None, **b} for b in blocks]
    return {"role": role, "content": full}


def use(i, q="x"):
    return {"toolUse": {"toolUseId": i, "name": "search_documents", "query": q}}


def result(i, text, status=None):
    return {"toolResult": {"toolUseId": i, "status": status, "text": text}}


def histories(spark, *messages):
    return spark.createDataFrame([(k, m) for k, m in enumerate(messages)], f"trace_id int, messages {agent.MESSAGES}")


def test_agent_history(spark):
    h = histories(
        spark,
        [message("user", {"text": "q"}), message("assistant", use("1"), use("2", "y")), message("user", result("1", "[1] chunk_id: b.md:0\n[2] chunk_id: a.md:3"), result("2", "[1] chunk_id: a.md:3\nchunk_id: c.md:1", "error")), message("assistant", use("3"))],
        [], None,
    )
    calls = agent.tool_calls(h)
    assert rows(calls, "call_no", "query", "status", "chunk_ids") == [(1, "x", "success", ["b.md:0", "a.md:3"]), (2, "y", "error", ["a.md:3", "c.md:1"]), (3, "x", None, [])]
    assert rows(agent.first_sightings(calls), "rank", "chunk_id", "source_path") == [(1, "b.md:0", "b.md"), (2, "a.md:3", "a.md"), (3, "c.md:1", "c.md")]


def test_strip_trailing_tool_use(spark):
    h = histories(
        spark,
        [message("user", {"text": "q"}), message("assistant", {"text": "t"}, use("1"))], [message("user", {"text": "q"}), message("assistant", use("1")), message("assistant", use("2"))],
        [message("assistant", use("1"))], [message("user", {"text": "q"})], [], [message("assistant", use("1")), message("user", {"text": "end"})],
    )
    got = [[(m.role, len(m.content)) for m in r.m] for r in h.select("trace_id", agent.strip_trailing_tool_use(F.col("messages")).alias("m")).orderBy("trace_id").collect()]
    assert got == [[("user", 1), ("assistant", 1)], [("user", 1)], [], [("user", 1)], [], [("assistant", 1), ("user", 1)]]


def test_agent_tools(spark):
    for bad in ("", "../etc/passwd", "data/../../x", "/data/a.md", "other/a.md"):
        with pytest.raises(ValueError):
            agent.check_path(bad)
    assert agent.check_path("data/x/../a.md") == "data/a.md" and agent.clamp(50, 1, 20) == 20
    d = spark.createDataFrame([("a", "x" * 30), ("b", None), ("c", "short")], "source_path string, content string")
    got = dict(rows(agent.read_document(d, 10)))
    assert got["a"].startswith("a (truncated to 10 of 30 characters)\n\n" + "x" * 10 + "\n\n[TRUNCATED.") and got["b"] == "b (0 characters)\n\n" and got["c"].endswith("short")
