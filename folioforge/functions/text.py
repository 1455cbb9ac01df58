"""Text functions as column expressions; everything stays inside the JVM.

White space means what Python's ``\\s`` means, and only a line feed ends a line in patterns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: Fixed value: the white space characters, as a class usable in Java and RE2 patterns.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The same characters as a text; a heading line, a term, a sentence border and the two forms of citation.
WS_CHARACTERS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
HEADING = rf"#{{1,6}}{WS}+.+"
TERM = r"[a-z0-9]+(?:[-_][a-z0-9]+)*"
SENTENCE_GAP = rf"([.!?]){WS}+([A-Z0-9*#])"
LABEL_CITATION = r"\[S(\d+)\]"
CHUNK_CITATION = r"\[([^\[\]\s]+\.md:\d+)\]"
#: Separator for splitting after marking. In the text itself it is followed by ESCAPE while it is split, which no marked place is.
MARK, ESCAPE = "\x01", "\x02"


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c) with c evaluated once: inside functions of arrays Spark evaluates an expression wherever it stands."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def _split_marked(c: Column, pattern: str, marked: str) -> Column:
    """The text split where the replacement ``marked`` puts a MARK; one that the text has is kept."""
    safe = F.replace(c, F.lit(MARK), F.lit(MARK + ESCAPE))
    parts = F.split(F.regexp_replace(safe, pattern, marked), f"{MARK}(?!{ESCAPE})", -1)
    return F.transform(parts, lambda p: F.replace(p, F.lit(MARK + ESCAPE), F.lit(MARK)))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARACTERS))


def terms(c: Column) -> Column:
    """All index terms in order of appearance, lower case; empty for a null text."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(TERM), F.lit(0)), F.array().cast("array<string>"))


def not_blank(pieces: Column) -> Column:
    """The stripped pieces that hold anything."""
    return F.filter(F.transform(pieces, strip), lambda p: p != "")


def paragraphs(c: Column) -> Column:
    return not_blank(F.split(c, rf"\n{WS}*\n", -1))


def sentences(c: Column) -> Column:
    """Pieces between an end mark and a capital, figure, asterisk or number sign."""
    return not_blank(_split_marked(c, SENTENCE_GAP, f"$1{MARK}$2"))


def is_heading(c: Column) -> Column:
    """The whole text is one heading."""
    return F.regexp_like(c, F.lit(rf"(?d)\A{HEADING}\z"))


def sections(c: Column) -> Column:
    """What precedes the first heading, then each heading with what follows it, unstripped."""
    return _split_marked(c, rf"(?md)^({HEADING})$", f"{MARK}$1")


def heading_blocks(c: Column) -> Column:
    """Paragraphs of the preamble and one stripped block per heading."""
    return once(sections(c), lambda parts: F.concat(paragraphs(F.get(parts, F.lit(0))), not_blank(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))))))
