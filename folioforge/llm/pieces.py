"""Splitting oversized items at natural boundaries.

A text longer than the limit becomes consecutive pieces that cover it without a gap: each begins ``overlap`` code points
before the end of the piece before it and is no longer than the limit. The ends are chosen by dynamic programming over
boundary positions, minimising the sum of the cuts' penalties and of the squared deviations of the pieces' lengths from an
even division.

Boundaries, by rising penalty: paragraph, line, sentence, clause, white space (and after any of ``. ! ? 。 ！ ？``), forced.
Weaker boundaries enter only in stretches that the stronger ones leave longer than a piece can advance, so that a sentence is
cut only where sentences are too long, and a word only where there is no space. Forced cuts divide their stretch evenly and
never separate a combining mark from its base, unless marks alone fill a whole piece.

``breaks`` of a piece is the length of the stretch (code points that are neither white space nor an end mark) that its end
falls into, 0 where it breaks none. The pieces cover the text and none exceeds the limit, so every stretch beyond the limit is
broken by some chosen cut; a shorter one is broken only at a clause mark or because the overlap takes up its room.

Defined results: null, empty and texts within the limit are not oversized and give no pieces; null ids are left out; repeated
rows of an id are one item if ``dedupe`` is set (the least text counts); an empty table gives an empty result; extra columns are
ignored; overlap 0 gives a partition of the text.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

LIMIT, OVERLAP = 500, 50
#: Penalties of a cut by the kind of boundary; a forced cut costs more than any number of others around it.
PENALTY = {"paragraph": 0.0, "line": 1.0, "sentence": 2.0, "clause": 6.0, "space": 10.0, "forced": 200.0, "end": 0.0}
#: Weight of a piece's squared relative deviation from the even length.
BALANCE = 4.0

_EOL = r"(?:\r\n|[\n\r\x0b\x0c\x85\u2028\u2029])"
_STRONG = re.compile(rf"(?:[.!?…]+[\"”»’')\]*_]*\s+|[。！？]+[”」』）\"]*\s*)|{_EOL}\s*")
_TWO_EOL = re.compile(rf"{_EOL}[^\S\r\n]*{_EOL}")
_ONE_EOL = re.compile(_EOL)
_CLAUSE = re.compile(r"[;:,)\]—–]\s+|[；：，、）]\s*")
_ANY = re.compile(r"\s|[.!?。！？]")
_RUN = re.compile(r"[^\s.!?。！？]+")

SCHEMA = "item_kind string, item_id string, piece_no int, start int, end int, boundary string, breaks int, n_pieces int"


def _whole_character(text: str, at: int, low: int) -> int:
    """The position, moved back so that no mark is separated from its base; as it is if all from ``low`` on are marks."""
    for p in range(at, low, -1):
        c = text[p]
        if not (unicodedata.combining(c) or c in "\u200d\ufe0e\ufe0f" or "\U0001f3fb" <= c <= "\U0001f3ff" or text[p - 1] == "\u200d"):
            return p
    return at


def _strong_kind(gap: str) -> str:
    """What a gap of end marks and white space is; line ends after a sentence count as what they are."""
    return "paragraph" if _TWO_EOL.search(gap) else "line" if _ONE_EOL.search(gap) else "sentence"


def candidates(text: str, advance: int) -> list[tuple[int, str]]:
    """Boundary positions with their kinds, dense enough that none is more than ``advance`` after the one before it."""
    n = len(text)
    found = {m.end(): _strong_kind(m.group()) for m in _STRONG.finditer(text)}
    found.pop(n, None)
    found.pop(0, None)
    for rx, kind in ((_CLAUSE, "clause"), (_ANY, "space")):
        at = [0, *sorted(found), n]
        for a, b in zip(at, at[1:]):
            if b - a > advance:
                for m in rx.finditer(text, a, b):
                    if a < m.end() < b:
                        found.setdefault(m.end(), kind)
    at = [0, *sorted(found), n]
    for a, b in zip(at, at[1:]):
        while b - a > advance:
            parts = -(-(b - a) // advance)
            a = _whole_character(text, a + -(-(b - a) // parts), a)
            found[a] = "forced"
    return sorted(found.items())


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(start, end, kind of the boundary at the end) of the pieces."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and less than the limit")
    n = len(text)
    if n <= limit:
        return [(0, n, "end")] if n else []
    advance = limit - overlap
    marks = candidates(text, advance)
    at = [0, *(p for p, _ in marks), n]
    kinds = ["", *(k for _, k in marks), "end"]
    pieces = -(-(n - overlap) // advance)
    even = (n + (pieces - 1) * overlap) / pieces
    best = [0.0] + [float("inf")] * (len(at) - 1)
    back = [0] * len(at)
    low = 0
    for j in range(1, len(at)):
        e = at[j]
        while at[low] < e - advance and not (low == 0 and e <= limit):
            low += 1
        cost = PENALTY[kinds[j]]
        top, arg = float("inf"), low
        for i in range(low, j):
            b = best[i]
            if b >= top:
                continue
            size = e - at[i] + (overlap if i else 0)
            if size > limit:
                continue
            dev = (size - even) / limit
            b += BALANCE * dev * dev
            if b < top:
                top, arg = b, i
        best[j], back[j] = top + cost, arg
    ends, j = [], len(at) - 1
    while j:
        ends.append(j)
        j = back[j]
    out, start = [], 0
    for j in reversed(ends):
        out.append((start, at[j], kinds[j]))
        start = max(0, at[j] - overlap)
    return out


def broken_stretches(text: str, ends: list[int]) -> list[int]:
    """For each position the length of the stretch without white space and end marks that it falls into, 0 for none."""
    runs = [m.span() for m in _RUN.finditer(text)]
    starts = [a for a, _ in runs]
    out = []
    for e in ends:
        i = bisect_left(starts, e) - 1  # the last stretch that begins before the position
        out.append(runs[i][1] - runs[i][0] if i >= 0 and e < runs[i][1] else 0)
    return out


def oversized(df: DataFrame, kind: str, item: str, text: str, limit: int = LIMIT, dedupe: bool = False) -> DataFrame:
    """item_kind, item_id and text of the items beyond the limit. Only these texts are ever shuffled, and only to dedupe."""
    rows = df.select(F.col(item).cast("string").alias("item_id"), F.col(text).alias("text")).filter((F.char_length("text") > limit) & F.col("item_id").isNotNull())
    if dedupe:
        rows = rows.groupBy("item_id").agg(F.min("text").alias("text"))
    return rows.select(F.lit(kind).alias("item_kind"), "item_id", "text")


def pieces(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """The pieces of items(item_kind, item_id, text) in order, with their texts or, for statistics, without."""
    schema = SCHEMA + (", text string" if with_text else "")
    columns = [c.split()[0] for c in schema.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for big in batches:
            for lo in range(0, len(big), 500):
                pdf = big.iloc[lo : lo + 500]
                rows = []
                for kind, item, text in zip(pdf["item_kind"], pdf["item_id"], pdf["text"]):
                    cut = split(text, limit, overlap)
                    broken = broken_stretches(text, [b for _, b, _ in cut])
                    for no, ((a, b, boundary), breaks) in enumerate(zip(cut, broken), 1):
                        rows.append((kind, item, no, a, b, boundary, breaks, len(cut), *((text[a:b],) if with_text else ())))
                yield pd.DataFrame(rows, columns=columns)

    return items.mapInPandas(work, schema)


def cut_kinds(cut: DataFrame, limit: int = LIMIT) -> DataFrame:
    """item_kind, item_id, cut: ``forced`` if a chosen cut breaks a stretch beyond the limit, else ``boundary``. One row per item.

    An item's pieces lie in one task as they were made, so nothing but flags is aggregated.
    """
    forced = F.max(F.col("breaks") > limit)
    return cut.groupBy("item_kind", "item_id").agg(F.when(forced, F.lit("forced")).otherwise(F.lit("boundary")).alias("cut"))
