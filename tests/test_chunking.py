import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from folioforge.operators import chunking

DOC = "source_path string, content string, text string, chunk_index string"


def chunks_of(spark, text, how):
    df = spark.createDataFrame([("d", text)], "source_path string, content string")
    return df.select(how(F.col("content")).alias("c")).head()[0]


def test_fixed_size(spark):
    cut = lambda t: chunks_of(spark, t, lambda c: chunking.fixed_chunks(c, 5))
    assert cut("abcdefghijkl") == ["abcde", "fghij", "kl"] and cut("") == [] and cut("äöü𝄞ß!") == ["äöü𝄞ß", "!"]
    made = chunking.chunk_table(spark.createDataFrame([("d", "abcdefghijkl", "x", "y")], DOC), chunking.fixed_chunks(F.col("content"), 5), "fixed", with_offsets=True)
    assert [tuple(r) for r in made.select("chunk_id", "character_start", "character_end").collect()][1] == ("d:0001", 5, 10)
    with pytest.raises(ValueError):
        chunking.fixed_chunks(F.lit("x"), 0)


def test_markdown(spark):
    cut = lambda t, n: chunks_of(spark, t, lambda c: chunking.markdown_chunks(c, n))
    first, second = "First sentence is here and it is rather a long one indeed.", "Second sentence is here and it is long as well, is it not."
    text = f"# Title\n\n{first} {second}"
    assert cut(text, 60) == ["# Title", first, second] and cut(text, 200) == [text]
    assert cut("## 2. Seal supply\n\nA. B.", 20)[0].startswith("## 2. Seal supply")
    assert cut("intro\n\nmore\n# A\nbody\n## B\nrest", 12) == ["intro\n\nmore", "# A\nbody", "## B\nrest"]
    assert cut("", 10) == [] and cut("#\n\n## joined\nx\n## y", 15) == ["#\n\n## joined\nx", "## y"]


def reference_pack(pieces, size):
    out, cur = [], ""
    for p in pieces:
        joined = cur + "\n\n" + p if cur else p
        if cur and len(joined) > size:
            out.append(cur)
            cur = p
        else:
            cur = joined
    return out + [cur] * bool(cur)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab", min_size=1, max_size=9), max_size=12), st.integers(1, 20))
def test_packing(spark, pieces, size):
    df = spark.createDataFrame([(pieces,)], "p array<string>")
    assert df.select(chunking.pack(F.col("p"), size)).head()[0] == reference_pack(pieces, size)


def test_offsets_find_or_drift(spark):
    df = spark.createDataFrame([(["abc", "zzz", "abc"], "abc abc abc")], "c array<string>, t string")
    got = df.select(chunking.offsets(F.col("c"), F.col("t"))).head()[0]
    assert [tuple(x) for x in got] == [(0, 3), (3, 6), (8, 11)]


def test_semantic(spark):
    units = chunks_of(spark, "pre one. Pre two.\n# Head 1.\nBody A. Body B.\n\n| a | b |\n| c. D | d |\n\n- item. Item", lambda c: chunking.semantic_units(c))
    assert units == ["pre one.", "Pre two.", "# Head 1.", "Body A.", "Body B.", "| a | b |\n| c. D | d |", "- item. Item"]
    df = spark.createDataFrame([(["a", "b", "c", "d"], [[1.0, 0.0], [1.0, 0.0], [0.9, 0.1], [0.0, 1.0]])], "u array<string>, v array<array<double>>")
    assert df.select(chunking.pack_units(F.col("u"), F.col("v"), 200, 1, 0.8)).head()[0] == ["a\n\nb\n\nc", "d"]
    assert df.select(chunking.pack_units(F.col("u"), F.col("v"), 4, 1, -1.0)).head()[0] == ["a\n\nb", "c\n\nd"]
    with pytest.raises(ValueError):
        chunking.pack_units(F.col("u"), F.col("v"), 10, 20)
    bad = spark.createDataFrame([(["a", "b"], [[1.0]])], "u array<string>, v array<array<double>>")
    with pytest.raises(Exception, match="one vector"):
        bad.select(chunking.pack_units(F.col("u"), F.col("v"), 10, 1, 0.5)).collect()


def test_long_ids_and_long_texts(spark):
    df = spark.createDataFrame([("d", "x" * 12_000)], "source_path string, content string")
    made = chunking.chunk_table(df, chunking.fixed_chunks(F.col("content"), 1), "fixed")
    assert made.filter("chunk_index = 10001").head().chunk_id == "d:10001"
    long = "Sentence one. " * 3000
    assert all(len(c) <= 500 for c in chunks_of(spark, long, chunking.markdown_chunks))
    assert re.sub(r"\s+", "", "".join(chunks_of(spark, long, chunking.markdown_chunks))) == re.sub(r"\s+", "", long)


def test_the_mark_is_an_ordinary_character(spark):
    from folioforge.functions.text import sections, sentences

    text = "One \x01 two. Three\x01\x02 four.\x01\n# Head \x01\nbody"
    r = spark.createDataFrame([(text,)], "t string").select(sentences(F.col("t")).alias("s"), sections(F.col("t")).alias("h")).head()
    assert r.s == ["One \x01 two.", "Three\x01\x02 four.\x01\n# Head \x01\nbody"] and r.h == ["One \x01 two. Three\x01\x02 four.\x01\n", "# Head \x01\nbody"]


def test_headings_are_sought_once(spark):
    """multihop_evidence_rrf: the steps of a chunker are evaluated once, however often the next step looks at them."""
    plan = spark.range(1).select(chunking.markdown_chunks(F.col("id").cast("string")).alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?md)^(") == 1
