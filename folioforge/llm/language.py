"""Languages of documents and of the stretches inside them.

Word-first backoff. A known word scores by its log frequency in each language. An unseen word falls back to the longest
character n-grams (4, 3, 2, then 1 characters, with word borders) of which the model knows any. A sentence's score is the
sum over its words; the posterior over the languages is its confidence. Chinese text has no spaces: a run of Han characters
is an unseen word and backs off to its characters.

The model is fitted in two rounds on a bounded sample of labelled documents (``SAMPLE_ROWS``, chosen by a hash of the
document id): first with the labels as they are, which may be wrong, then with the language that the first model gives to
every single sentence. Fixed function words of each language are pseudo-counts, so that a language that the labels hardly
name is still known. The counts of the sample are what is broadcast.

Prose is what remains without front matter, headings, table rows, code blocks, list marks, quoted titles, codes and
figures. The main language is that of most of the prose, measured in letters (a Han character counts as three). A segment
is a run of consecutive sentences of one language; a foreign segment needs at least one whole sentence.

Defined results: null, empty and blank texts and texts without prose have no main language and no segments; rows with a
null document id are kept; repeated rows give repeated results except in p9_found, which names each case once; extra columns
are ignored; an empty table gives an empty result, and without any labelled row the model consists of the function words.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from folioforge.session import cut

#: The languages.
LANGS = ("en", "de", "fr", "es", "nl", "ms", "zh")
#: Labelled documents that the model is fitted on, at most (in expectation; chosen by hash).
SAMPLE_ROWS = 8_000
#: Size of a model that is fitted on all texts, whose words have no other bound: words and n-grams per language. Words beyond it are
#: unseen words, n-grams beyond it are passed over for shorter ones. A model fitted on SAMPLE_ROWS documents is not cut.
KEEP_WORDS, KEEP_GRAMS = 20_000, 8_000
SIZES = (4, 3, 2, 1)
#: Distinct words that a task counts before it hands them on.
SEEN_WORDS = 100_000
#: A sentence counts as foreign with at least this posterior.
SURE = 0.9

#: Names of the languages in labels besides the two-letter code (which may carry a region).
NAMES = {
    "en": ("eng", "english"),
    "de": ("deu", "ger", "german"),
    "fr": ("fra", "fre", "french"),
    "es": ("spa", "spanish"),
    "nl": ("nld", "dut", "dutch"),
    "ms": ("msa", "may", "zsm", "malay"),
    "zh": ("zho", "chi", "cmn", "chinese"),
}
#: Frequent function words of each language.
FUNCTION_WORDS = {
    "en": "the of and to in is that for with on as are this be by from at or an not have it was which can",
    "de": "der die das und ist nicht ein eine zu den von mit auf für dem des im sich auch als nach wird bei oder",
    "fr": "le la les et est des une du dans pour que qui par sur au avec ne pas ce aux ou sont cette plus",
    "es": "el la los las y es de del una por que con para en se no al un su como más está según o",
    "nl": "de het een en van is niet dat op te voor met zijn aan door bij naar ook als dit wordt uit of deze",
    "ms": "yang dan di dengan untuk ini itu tidak dari pada adalah oleh akan telah boleh kepada dalam atau sebelum jika ke bagi",
    "zh": "的 是 在 不 了 和 有 为 这 中 以 把 被 与 或 由 对 之 前 后",
}

HAN = "一-鿿㐀-䶿𠀀-𪛟"
_ADDRESS = re.compile(r"https?://\S+|\S+@\S+")
LATIN = "A-Za-zªºÀ-ÖØ-öø-ɏ\u0300-\u036fḀ-ỿﬀ-ﬆ"
#: Han runs, and Latin words that are no part of a code such as KT-294/2 or HSE-LK-152-X.
_WORD = re.compile(rf"[{HAN}]+|(?<![{LATIN}])(?<!\d[-/])[{LATIN}]++(?:['’][{LATIN}]+)*+(?![-_/]?[A-Za-z]*[-_/]?\d)")
_QUOTES = re.compile(r"[“„«《「『‹\"]")
#: A quoted title, of any length; what ends like a sentence inside its quotes is prose.
_QUOTED = re.compile(r"[“„«《「『‹\"][^“”„«»《》「」『』‹›\"\n。]*[^“”„«»《》「」『』‹›\"\n。.!?！？][”“»》」』›\"]")
#: A line of front matter: a key, a list item, something indented, a comment or nothing.
_FRONT = re.compile(r"\s*$|\s+\S|[\w.\-]+(?: [\w.\-]+)*\s*:|-\s|#")
_MARK = re.compile(r"^(?:\s|[>\-*+•·–—]+(?=\s)|>+|\(?\d{1,3}[.)](?=\s)|\*\*|__)+")
_END = re.compile(r"(?<=[.!?…])[\"”»’')\]*_]*\s+|(?<=[。！？])[”」』）)]*\s*")
_WHOLE = re.compile(r"[.!?。！？][\"”»’')\]*_」』）\s]*$")
_LINES = re.compile(r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")


def label_code(c: Column) -> Column:
    """The language that a label names, as a two-letter code; null if it names none of the seven."""
    t = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    first = F.regexp_extract(t, r"^([a-z]+)(?:[-_](?:[a-z]{2,4}|\d{3}))*$", 1)
    out = F.lit(None).cast("string")
    for lang, names in NAMES.items():
        out = F.when(first.isin(lang, *names), lang).otherwise(out)
    return out


def sentences(text: str | None) -> list[tuple[str, bool]]:
    """The prose as (sentence, whether it is whole), without headings, tables, codes and quoted titles."""
    if not text or text.isspace():
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFC", _INVISIBLE.sub("", text))
    lines = _LINES.split(text)
    first = next(i for i, x in enumerate(lines) if x and not x.isspace()) if any(x and not x.isspace() for x in lines) else 0
    if lines[first].strip() == "---":  # front matter
        end = next((i for i in range(first + 1, len(lines)) if lines[i].strip() == "---" or not _FRONT.match(lines[i])), first)
        lines = lines[(end if end < len(lines) and lines[end].strip() == "---" else first) + 1 :]
    out: list[tuple[str, bool]] = []
    fenced = False
    for line in lines:
        s = line.strip()
        if s.startswith(("```", "~~~")):
            fenced = not fenced
            continue
        if fenced or not s or s[0] in "|#" or s.startswith(("---", "===", "> Re:")):
            continue
        if not s[0].isalpha():
            s = _MARK.sub("", s)
            if s.startswith(("|", "#")):
                continue
        if _QUOTES.search(s):
            s = _QUOTED.sub(" ", s)
        for part in _END.split(s):
            if part and not part.isspace():
                out.append((part, bool(_WHOLE.search(part))))
    return out


def words(sentence: str) -> list[str]:
    if "://" in sentence or "@" in sentence:
        sentence = _ADDRESS.sub(" ", sentence)
    return _WORD.findall(sentence.lower())


def letters(found: list[str]) -> int:
    """Amount of prose in the words of a sentence; a Han character counts as three letters."""
    return sum(map(len, found)) + 2 * sum([len(w) for w in found if w[0] >= "㐀"])


def is_prose(found: list[str]) -> bool:
    """Enough words to be more than a code or a name: three words or four Han characters."""
    return len(found) >= 3 or sum([len(w) for w in found if w[0] >= "㐀"]) >= 4


def grams(word: str, size: int) -> list[str]:
    if word[0] >= "㐀":
        padded = word
    else:
        padded = f" {word} " if size > 1 else word
    return [padded[i : i + size] for i in range(len(padded) - size + 1)]


class Model:
    """Log frequencies per language of words and of n-grams by size. Rows of a matrix; unseen words get theirs when met."""

    #: Unseen words whose rows are kept.
    CACHE = 200_000

    def __init__(self, words: dict[str, np.ndarray], grams: dict[int, dict[str, np.ndarray]]):
        self.words, self.grams = words, grams
        self._prepare()

    def _prepare(self) -> None:
        self._row = {w: i for i, w in enumerate(self.words)}
        self._matrix = np.zeros((len(self.words) + 4096, len(LANGS)))
        for i, v in enumerate(self.words.values()):
            self._matrix[i] = v

    def __getstate__(self) -> dict:
        return {"words": self.words, "grams": self.grams}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._prepare()

    def row(self, word: str) -> int:
        """The word's row: its own if it is known, else one made of its longest known n-grams."""
        i = self._row.get(word)
        if i is None:
            i = self._row[word] = len(self._row)
            if i >= len(self._matrix):
                self._matrix = np.concatenate([self._matrix, np.zeros_like(self._matrix)])
            self._matrix[i] = self._backoff(word)
        return i

    def _backoff(self, word: str) -> np.ndarray:
        for size in SIZES:
            table = self.grams[size]
            known = [table[g] for g in grams(word, size) if g in table]
            if known:
                total = np.sum(known, axis=0)
                # n-grams overlap and would count the same evidence again and again
                return total if word[0] >= "㐀" else total / size
        return np.zeros(len(LANGS))

    def posterior(self, found: list[str]) -> np.ndarray:
        return self.posteriors([found])[0]

    def posteriors(self, found: list[list[str]]) -> np.ndarray:
        """Posteriors of many sentences at once; even ones where a sentence has no words."""
        if not found:
            return np.zeros((0, len(LANGS)))
        sizes = np.fromiter((len(f) for f in found), np.int64, len(found))
        s = np.zeros((len(found), len(LANGS)))
        if sizes.sum():
            if len(self._row) > len(self.words) + self.CACHE:
                self._prepare()
            known = self._row.get
            flat = [self.row(w) if (i := known(w)) is None else i for f in found for w in f]
            full = np.flatnonzero(sizes)
            starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
            s[full] = np.add.reduceat(self._matrix[np.array(flat)], starts, axis=0)
        p = np.exp(s - s.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def _tabulate(rows: list[tuple[str, int, str, float]]) -> Model:
    """Model of (language, size or 0 for words, gram, count). Frequencies are smoothed and relative to a gram's mean."""
    counts: dict[int, dict[str, np.ndarray]] = {k: {} for k in (0, *SIZES)}
    for lang, size, gram, n in rows:
        row = counts[size].setdefault(gram, np.zeros(len(LANGS)))
        row[LANGS.index(lang)] += n
    for lang, text in FUNCTION_WORDS.items():
        for w in text.split():
            size = 1 if lang == "zh" else 0
            counts[size].setdefault(w, np.zeros(len(LANGS)))[LANGS.index(lang)] += 3
    tables: dict[int, dict[str, np.ndarray]] = {}
    for size, table in counts.items():
        total = np.sum(list(table.values()), axis=0) + 1.0
        floor = 0.5 / max(200.0, float(np.median(total)))
        tables[size] = {}
        for g, row in table.items():
            freq = np.log(row / total + floor)
            tables[size][g] = freq - float(np.log(np.mean(row / total + floor)))
    return Model(tables.pop(0), tables)


def _count(relabel: Model | None, whole: bool = False):
    """Counts words and n-grams by language: that of the label, or the one a model gives to each sentence (or whole text)."""

    def table(seen: dict[tuple[str, str], int]) -> pd.DataFrame:
        counts: dict[tuple[str, int, str], int] = {}
        for (of, w), n in seen.items():
            if w[0] < "㐀":
                counts[(of, 0, w)] = counts.get((of, 0, w), 0) + n
            else:  # Han characters belong to the amount of text against which a language's words are measured
                counts[(of, 0, "")] = counts.get((of, 0, ""), 0) + n * len(w)
            for size in SIZES:
                for g in grams(w, size):
                    counts[(of, size, g)] = counts.get((of, size, g), 0) + n
        keys = list(counts)
        return pd.DataFrame({"lang": [k[0] for k in keys], "size": [k[1] for k in keys], "gram": [k[2] for k in keys], "n": [counts[k] for k in keys]})

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[str, str], int] = {}
        for big in batches:
            for at in range(0, len(big), 500):
                pdf = big.iloc[at : at + 500]
                units: list[tuple[str, list[str], int]] = []
                for lang, text, times in zip(pdf["label"], pdf["text"], pdf["n"]):
                    each = [words(sentence) for sentence, _ in sentences(text)]
                    units += [(lang, found, times) for found in ([[w for u in each for w in u]] if whole else each) if is_prose(found)]
                if relabel is not None:  # all of the batch are told at once
                    p = relabel.posteriors([found for _, found, _ in units])
                    units = [(LANGS[k], found, times) for k, sure, (_, found, times) in zip(p.argmax(axis=1), p.max(axis=1) >= SURE, units) if sure]
                for of, found, times in units:
                    for w in found:
                        seen[(of, w)] = seen.get((of, w), 0) + times
                if len(seen) > SEEN_WORDS:
                    yield table(seen)
                    seen.clear()
        if seen:
            yield table(seen)

    return work


def _sample(rows: DataFrame, key: str, sample_rows: int) -> DataFrame:
    """Rows chosen by a hash of their key, sample_rows of them in expectation."""
    n = rows.count()
    return rows if n <= sample_rows else rows.filter(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(1_000_000 * sample_rows / n))


def _fit_round(labelled: DataFrame, model: Model | None, whole: bool = False, kept: tuple[int, int] | None = None) -> Model:
    """``kept``: words and n-grams per language and size at most; without it all counts of the bounded sample."""
    times = F.col("n") if "n" in labelled.columns else F.lit(1).cast("long").alias("n")
    counts = labelled.select("label", "text", times).mapInPandas(_count(model, whole), "lang string, size int, gram string, n long")
    summed = counts.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    if kept:
        w = Window.partitionBy("lang", "size").orderBy(F.col("n").desc(), "gram")
        summed = summed.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= F.when(F.col("size") == 0, kept[0]).otherwise(kept[1]))
    return _tabulate([(r["lang"], r["size"], r["gram"], float(r["n"])) for r in summed.collect()])  # bounded by ``kept`` or by the sample


def fit(documents: DataFrame, sample_rows: int = SAMPLE_ROWS, rounds: int = 2) -> Model:
    """The model from the labels of ``documents`` (columns doc_id, lang and text)."""
    labelled = documents.select("doc_id", label_code(F.col("lang")).alias("label"), "text").filter("label is not null")
    labelled, model = _sample(labelled, "doc_id", sample_rows), None
    for _ in range(rounds):
        model = _fit_round(labelled, model)
    return model


def fit_unlabelled(texts: DataFrame, rounds: int = 2) -> Model:
    """The model from all texts (column text) without labels.

    Function words alone first tell whole texts apart, which is easy; the words of these then tell single sentences apart.
    Repeated texts, and after that repeated lines, are read once and count as often as they occur.
    """
    times = F.count(F.lit(1)).alias("n")
    rows = cut(texts.filter("text rlike '\\\\S'").groupBy("text").agg(times).withColumn("label", F.lit("en")))
    kept = (KEEP_WORDS, KEEP_GRAMS)
    model = _fit_round(rows, _tabulate([]), True, kept)
    if rounds > 1:
        lines = rows.select("label", "n", F.explode(F.split("text", "\n")).alias("text")).filter("text rlike '\\\\S'")
        lines = cut(lines.groupBy("text", "label").agg(F.sum("n").alias("n")))
    for _ in range(rounds - 1):
        model = _fit_round(lines, model, False, kept)
    return model


def spans(model: Model, texts: list[str | None]) -> list[list[tuple[str, float, int, bool, str]]]:
    """Per text its prose sentences as (language, confidence, letters, whole, sentence)."""
    found, owner, info = [], [], []
    for i, text in enumerate(texts):
        for sentence, whole in sentences(text):
            f = words(sentence)
            if is_prose(f):
                found.append(f)
                owner.append(i)
                info.append((letters(f), whole, sentence))
    out: list[list[tuple[str, float, int, bool, str]]] = [[] for _ in texts]
    p = model.posteriors(found)
    best = p.argmax(axis=1) if len(p) else []
    for k, i in enumerate(owner):
        out[i].append((LANGS[best[k]], float(p[k, best[k]]), *info[k]))
    return out


def main_language(parts: list[tuple[str, float, int, bool, str]]) -> tuple[str | None, float]:
    """The language of most of the prose, with its share weighted by confidence."""
    if not parts:
        return None, 0.0
    weight: dict[str, float] = {}
    for lang, conf, size, _, _ in parts:
        weight[lang] = weight.get(lang, 0.0) + size * conf
    lang = max(sorted(weight), key=weight.get)
    return lang, weight[lang] / sum(p[2] for p in parts)


def classify(documents: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, label (code or null), main, confidence and its segments (no, lang, confidence, letters, sentences, whole)."""
    bc = documents.sparkSession.sparkContext.broadcast(model)  # bounded by its sample
    schema = "doc_id long, label string, main string, confidence double, segments array<struct<no:int,lang:string,confidence:double,letters:int,sentences:int,whole:boolean>>"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = bc.value
        for big in batches:
            for at in range(0, len(big), 500):
                pdf = big.iloc[at : at + 500]
                rows = []
                for doc, label, parts in zip(pdf["doc_id"], pdf["label"], spans(m, list(pdf["text"]))):
                    lang, conf = main_language(parts)
                    segments: list[dict] = []
                    for s_lang, s_conf, size, whole, _ in parts:
                        # a sentence that cannot be told from the main language does not end a stretch of it
                        here = lang if s_lang != lang and s_conf < SURE else s_lang
                        p = s_conf if here == s_lang else 1 - s_conf
                        if segments and segments[-1]["lang"] == here:
                            g = segments[-1]
                            total = g["letters"] + size
                            g["confidence"] = (g["confidence"] * g["letters"] + p * size) / total
                            g["letters"], g["sentences"], g["whole"] = total, g["sentences"] + 1, g["whole"] or whole
                        else:
                            segments.append({"no": len(segments) + 1, "lang": here, "confidence": p, "letters": size, "sentences": 1, "whole": whole})
                    rows.append((doc, label, lang, conf if lang else None, segments))
                yield pd.DataFrame(rows, columns=["doc_id", "label", "main", "confidence", "segments"]).astype({"doc_id": "Int64"})

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), label_code(F.col("lang")).alias("label"), "text").mapInPandas(work, schema)


def found_cases(classified: DataFrame) -> DataFrame:
    """doc_id, kind, lang: missing or wrong labels, and languages of whole sentences besides the main one."""
    label = F.when(F.col("main").isNotNull() & ~F.col("label").eqNullSafe(F.col("main")), F.array(F.struct(F.lit("label").alias("kind"), F.col("main").alias("lang")))).otherwise(
        F.array().cast("array<struct<kind:string,lang:string>>")
    )
    foreign = F.filter("segments", lambda s: (s["lang"] != F.col("main")) & s["whole"])
    segment = F.array_distinct(F.transform(foreign, lambda s: F.struct(F.lit("segment").alias("kind"), s["lang"].alias("lang"))))
    return classified.select("doc_id", F.explode(F.concat(label, segment)).alias("c")).select("doc_id", "c.kind", "c.lang").distinct()
