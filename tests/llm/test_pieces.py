import random

import pytest
from hypothesis import given, settings, strategies as st

from folioforge.llm import pieces as P
from tests.conftest import rows

ITEM = "source_path string, content string, item_kind string, item_id string, text string"


def check(text, limit, overlap):
    cut = P.split(text, limit, overlap)
    if len(text) <= limit:
        assert cut == ([(0, len(text), "end")] if text else [])
        return cut
    assert cut[0][0] == 0 and cut[-1][1] == len(text) and all(0 < b - a <= limit for a, b, _ in cut)
    for (_, end, _), (start, after, _) in zip(cut, cut[1:]):
        assert start == max(0, end - overlap) and after > end
    whole = text[: cut[0][1]] + "".join(text[p[1] : q[1]] for p, q in zip(cut, cut[1:]))
    assert whole == text
    return cut


@settings(max_examples=150, deadline=None)
@given(st.text("ab .\n,字。\r!é́", max_size=400), st.integers(10, 60), st.integers(0, 9))
def test_cover_limit_overlap(text, limit, overlap):
    check(text, limit, overlap)


def exhaustive(text, limit, overlap):
    """Least cost over all choices of the same boundaries, by recursion."""
    from functools import cache

    marks = dict(P.candidates(text, limit - overlap)) | {len(text): "end"}
    at = sorted(marks)
    pieces = -(-(len(text) - overlap) // (limit - overlap))
    even = (len(text) + (pieces - 1) * overlap) / pieces

    @cache
    def best(begin):
        if begin == len(text):
            return 0.0
        start = max(0, begin - overlap) if begin else 0
        costs = [P.PENALTY[marks[e]] + P.BALANCE * ((e - start - even) / limit) ** 2 + best(e) for e in at if e > begin and e - start <= limit]
        return min(costs, default=float("inf"))

    return best(0)


def test_minimal_cost():
    rnd = random.Random(2)
    for _ in range(60):
        text = "".join(rnd.choice(["word ", "x. ", "\n", "\n\n", "y, ", "longerword "]) for _ in range(rnd.randint(10, 60)))
        limit, overlap = rnd.choice([(40, 0), (50, 10), (80, 20)])
        if len(text) <= limit:
            continue
        cut = check(text, limit, overlap)
        pieces = -(-(len(text) - overlap) // (limit - overlap))
        even = (len(text) + (pieces - 1) * overlap) / pieces
        cost = sum(P.PENALTY[k] + P.BALANCE * ((b - a - even) / limit) ** 2 for a, b, k in cut)
        assert cost == pytest.approx(exhaustive(text, limit, overlap))


def test_prefers_natural_boundaries():
    text = ("First sentence here. Second one there. " * 8 + "\n\n") * 3
    assert {k for _, _, k in P.split(text.strip(), 400, 0)} <= {"paragraph", "end"}
    assert {k for _, _, k in P.split("字字字。" * 300)} == {"sentence", "end"}
    assert {k for _, _, k in P.split("word " * 300)} == {"space", "end"}
    assert [k for _, _, k in P.split("x" * 1200, 500, 0)] == ["forced", "forced", "end"]
    for a, b, _ in P.split("é" * 700, 500, 50)[:-1]:
        assert b % 2 == 0  # no mark is torn from its base
    with pytest.raises(ValueError):
        P.split("x" * 600, 100, 100)


def test_frame(spark):
    run = "y" * 501
    data = [("a", "short"), ("b", "w " * 400), ("c", run), ("d", None), ("e", ""), ("b", "w " * 400), (None, "w " * 400), ("f", "ab cd. " * 20_000), ("g", "z" * 500 + " " + "q" * 500), ("h", "z" * 500 + "。" + "q" * 500)]
    df = spark.createDataFrame([(*d, "k", "i", "t") for d in data], ITEM)
    items = P.oversized(df, "document", "source_path", "content", dedupe=True)
    got = P.pieces(items)
    found = P.cut_kinds(got).select("item_id", "cut")
    assert rows(found) == [("b", "boundary"), ("c", "forced"), ("f", "boundary"), ("g", "boundary"), ("h", "boundary")]
    text = {r.item_id: r.text for r in items.collect()}
    for r in got.collect():
        assert r.text == text[r.item_id][r.start : r.end] and len(r.text) <= 500
    assert P.oversized(df, "document", "source_path", "content").filter("item_id = 'b'").count() == 2
    assert P.pieces(items.limit(0)).count() == 0


def longest(text):
    return max((b - a for a, b in (m.span() for m in P._RUN.finditer(text))), default=0)


@settings(max_examples=200, deadline=None)
@given(st.text("ab .,字，。”!é\u0301", max_size=300), st.integers(3, 40), st.integers(0, 2))
def test_a_stretch_beyond_the_limit_is_always_broken(text, limit, overlap):
    cut = P.split(text, limit, overlap)
    broken = P.broken_stretches(text, [b for _, b, _ in cut])
    assert (max(broken, default=0) > limit) == (longest(text) > limit)


def test_broken_stretches():
    assert P.broken_stretches("ab cdef. g", [0, 1, 2, 3, 5, 7, 8, 10]) == [0, 2, 0, 0, 4, 0, 0, 0]
    # a stretch that fits a piece but not beside the overlap is broken, and is no forced cut for that
    text = "w " * 100 + "x" * 480 + " w" * 100
    cut = P.split(text, 500, 50)
    assert max(P.broken_stretches(text, [b for _, b, _ in cut])) == 480


def test_marks_without_end():
    check("e" + "\u0301" * 1500, 500, 50)
    cut = check("a" * 400 + "e" + "\u0301" * 60 + "b" * 700, 500, 50)
    assert not any(400 < b <= 460 + 1 and b != 400 for _, b, _ in cut[:-1])


def test_found_rows_hang_on_the_chosen_cuts(spark, monkeypatch):
    items = spark.createDataFrame([("k", "run", "z" * 700), ("k", "words", "word " * 200)], "item_kind string, item_id string, text string")
    found = lambda: rows(P.cut_kinds(P.pieces(items, with_text=False)))
    assert found() == [("k", "run", "forced"), ("k", "words", "boundary")]
    monkeypatch.setattr(P, "split", lambda text, limit, overlap: [(0, len(text), "end")])
    assert found() == [("k", "run", "boundary"), ("k", "words", "boundary")]
