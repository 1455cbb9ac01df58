import random

import pytest
from pyspark.sql import functions as F

from folioforge.llm import encoding
from tests.conftest import rows

PATH = encoding.vocabulary_path()


@pytest.fixture(scope="module")
def public():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(encoding.vocabulary_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def texts():
    rnd = random.Random(4)
    out = ["", " ", "\n\n \t x", "<|endoftext|> is text", "it's they'LL", "x" * 3000, "ab" * 2500, "á" * 700 + "ß" * 700, "日本語テスト" * 200, "🙂👍🏽" * 60, "1234567890" * 300, "aaaaabaaaaaac" * 200]
    out += ["".join(chr(rnd.choice([rnd.randint(32, 126), rnd.randint(128, 0x2FFF), rnd.randint(0x1F300, 0x1FAFF), 10, 9, 32, 0x3000])) for _ in range(150)) for _ in range(80)]
    out += ["".join(rnd.choice("abehtinos") for _ in range(rnd.randint(1, 900))) for _ in range(60)]
    return out


def test_ids_equal_the_public_tokenizer(public):
    e = encoding.Encoder(PATH)
    sample = texts()
    assert [e.encode(t) for t in sample] == public(sample)
    assert [e.count(t) for t in sample] == [len(e.encode(t)) for t in sample]
    assert [e.decode(e.encode(t)) for t in sample] == sample


def test_caches_do_not_matter(public, monkeypatch):
    monkeypatch.setattr(encoding, "CACHE_WORDS", 3)
    monkeypatch.setattr(encoding, "CACHE_STATES", 5)
    e = encoding.Encoder(PATH)
    sample = texts()[5:40]
    assert [e.encode(t) for t in sample] == public(sample)


def test_other_vocabulary():
    tiktoken = pytest.importorskip("tiktoken")
    e = encoding.Encoder(encoding.vocabulary_path("byte_bpe_multi_50k.tiktoken"))
    other = tiktoken.Encoding("own", pat_str=encoding.PATTERN, mergeable_ranks=e.ranks, special_tokens={})
    assert [e.encode(t) for t in texts()] == [other.encode_ordinary(t) for t in texts()]


def test_utf8_machine_in_pieces_and_on_garbage():
    data = "aé€🙂z".encode()
    for cut in range(len(data) + 1):
        m = encoding.Utf8Machine()
        assert m.feed(data[:cut]) + m.feed(data[cut:]) + m.end() == "aé€🙂z"
    rnd = random.Random(0)
    for _ in range(2000):
        raw = bytes(rnd.choice([rnd.randrange(256), 0xE2, 0x82, 0xF0, 0x9F, 0xED, 0xA0]) for _ in range(rnd.randrange(9)))
        m = encoding.Utf8Machine()
        assert "".join(m.feed(raw[i : i + 1]) for i in range(len(raw))) + m.end() == raw.decode("utf-8", "replace")


def test_frame(spark, public):
    data = [(1, None, "x"), (2, "", "x"), (3, " a b", "x"), (4, "long word " * 20_000, None), (4, " a b", "x"), (None, "n", "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, tokens string")
    got = encoding.encode(df, "text", ["doc_id"])
    assert got.columns == ["doc_id", "ids"] and got.filter("ids is null").count() == 0
    want = public([t or "" for _, t, _ in data])
    assert sorted((str(r.doc_id), r.ids) for r in got.collect()) == sorted((str(i), w) for (i, _, _), w in zip(data, want))
    counts = encoding.token_counts(df, "text", ["doc_id"])
    assert sorted(str(tuple(r)) for r in counts.collect()) == sorted(str((i, len(w))) for (i, _, _), w in zip(data, want))
    back = encoding.decode(got, "ids", ["doc_id"])
    assert sorted(str(r.text) for r in back.collect()) == sorted(t or "" for _, t, _ in data)
    assert encoding.encode(df.limit(0), "text", ["doc_id"]).count() == 0
    assert rows(encoding.decode(spark.createDataFrame([(1, None)], "k int, i array<int>"), "i", ["k"])) == [(1, None)]
    with pytest.raises(Exception):
        encoding.decode(spark.createDataFrame([(1, [10**6])], "k int, i array<int>"), "i", ["k"]).select(F.length("text")).collect()


def test_ranks_from_json(tmp_path):
    encoding.export_ranks(encoding.vocabulary_path("byte_bpe_50k.json"), str(tmp_path / "r.tiktoken"))
    assert encoding.Encoder(str(tmp_path / "r.tiktoken")).ranks == encoding.Encoder(PATH).ranks
