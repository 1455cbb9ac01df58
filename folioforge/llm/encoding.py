"""Encoding and decoding of a corpus with a public byte-level BPE vocabulary.

The merges become a finite-state transducer that is determinised lazily, state by state, as the texts ask for it. Input
symbols are bytes, output symbols are ids. The construction rests on a property of byte-pair encoding: the encoding of a
prefix ends in one certain token, and the encoding of the whole is found by following these last tokens backwards. The
last token at a position is the one among the vocabulary's tokens ending there that may follow the last token at its own
start, i.e. whose pair the merges leave as it is. A state of the transducer is what the future can depend on: the
last-token lengths of the positions that may still be reached, and the bytes since the oldest of them. A token is emitted
once every position that can still be a token's start leads back through its end; no token is longer than the longest of
the vocabulary, so that twice this length of pending bytes is looked at before tokens are emitted. Within a word the pending
bytes are the whole of it so far, so paths of different words meet again only at the words' borders.

Words (the pieces that the pre-tokenising pattern cuts) recur, so paths from the start state to the end of a word are kept
as single arcs; that is only a cache and is emptied when it is full.

Decoding concatenates the tokens' bytes and runs an incremental UTF-8 state machine over them, which keeps the unfinished
code point between calls and replaces ill-formed bytes by U+FFFD.

Defined results: null and empty texts have no tokens, so their ids are the empty list. Strings that look like control
tokens are ordinary text. White space is kept.
"""

from __future__ import annotations

import base64
import importlib.util
import json
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

#: Fixed value: the pre-tokenising pattern that belongs to the byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words and states kept by a worker at most.
CACHE_WORDS = 400_000
CACHE_STATES = 400_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """Place of a vocabulary file. The folder is a parameter; by default that of the installed public tokenizers."""
    if folder:
        return str(Path(folder) / name)
    spec = importlib.util.find_spec("public_tokenizers")
    return str(Path(spec.origin).parent / name) if spec and spec.origin else f"/opt/tokenizers/{name}"


class Transducer:
    """Byte-pair encoding as a lazily determinised transducer."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.tokens = ranks, {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self._pair: dict[tuple[bytes, bytes], bool] = {}
        self._whole: dict[bytes, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.words: dict[str, tuple[int, ...]] = {}
        #: state: (pending bytes, length of the last token at each pending position)
        self.start = (b"", ())
        self.arcs: dict[tuple, dict[int, tuple]] = {}

    # the merges' judgement ----------------------------------------------------------------------------------------
    def _merge(self, piece: bytes) -> list[bytes]:
        """Reference merging, only for the short byte strings by which arcs are justified."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stands(self, token: bytes) -> bool:
        """The merges make this one token of its bytes."""
        ok = self._whole.get(token)
        if ok is None:
            ok = self._whole[token] = self._merge(token) == [token]
        return ok

    def _may_follow(self, left: bytes, right: bytes) -> bool:
        """The merges leave this pair as it is."""
        key = (left, right)
        ok = self._pair.get(key)
        if ok is None:
            if len(self._pair) > CACHE_STATES:
                self._pair.clear()
            ok = self._pair[key] = self._merge(left + right) == [left, right]
        return ok

    # determinisation ------------------------------------------------------------------------------------------------
    def _step(self, state: tuple, byte: int) -> tuple:
        """(next state, ids emitted) after one more byte. The pending bytes begin at a certain token border.

        lasts[k]: length of the last token of the encoding of the first k + 1 pending bytes.
        """
        pending, lasts = state
        text = pending + bytes((byte,))
        n = len(text)
        here = 0
        for size in range(min(n, self.longest), 0, -1):
            token = text[n - size :]
            if token not in self.ranks or not self._stands(token):
                continue
            if size == n:
                here = size
                break
            before = lasts[n - size - 1]
            if before and self._may_follow(text[n - size - before : n - size], token):
                here = size
                break
        lasts = (*lasts, here)
        if len(text) <= 2 * self.longest:
            return (text, lasts), ()
        border = self._border(text, lasts)
        return (text[border:], lasts[border:]), tuple(self._path(text, lasts, border))

    def _border(self, text: bytes, lasts: tuple[int, ...]) -> int:
        """The last position through which all positions lead back from which a later token may start."""
        on_path, at = {0}, len(text)
        while at:
            on_path.add(at)
            at -= lasts[at - 1]
        border = len(text)
        for end in range(len(text) - self.longest + 1, len(text) + 1):
            at = end
            while at > border or at not in on_path:
                at -= lasts[at - 1]
            border = min(border, at)
        return border

    def _path(self, text: bytes, lasts: tuple[int, ...], end: int) -> list[int]:
        """Ids of the encoding of the first ``end`` pending bytes: the last tokens, backwards."""
        out, at = [], end
        while at:
            size = lasts[at - 1]
            out.append(self.ranks[text[at - size : at]])
            at -= size
        return out[::-1]

    def run(self, piece: bytes) -> list[int]:
        """Ids of one word, byte by byte through the transducer."""
        if piece in self.ranks and self._stands(piece):
            return [self.ranks[piece]]
        state, out = self.start, []
        for byte in piece:
            arcs = self.arcs.get(state)
            if arcs is None:
                if len(self.arcs) > CACHE_STATES:
                    self.arcs.clear()
                arcs = self.arcs[state] = {}
            to = arcs.get(byte)
            if to is None:
                to = arcs[byte] = self._step(state, byte)
            state = to[0]
            if to[1]:
                out += to[1]
        return out + self._path(*state, len(state[0]))

    def word(self, word: str) -> tuple[int, ...]:
        ids = self.words.get(word)
        if ids is None:
            ids = tuple(self.run(word.encode("utf-8")))
            if len(word) <= 64:
                if len(self.words) > CACHE_WORDS:
                    self.words.clear()
                self.words[word] = ids
        return ids


class Encoder:
    """Texts to ids and back for one vocabulary."""

    _loaded: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        raw = Path(path).read_bytes()
        if path.endswith(".json"):
            raise ValueError("give the vocabulary as ranks (.tiktoken)")
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        self.fst = Transducer(self.ranks)
        self._split = regex.compile(PATTERN).findall
        table = max(self.ranks.values()) + 1
        self.bytes_of: list[bytes | None] = [None] * table
        for t, i in self.ranks.items():
            self.bytes_of[i] = t

    @classmethod
    def of(cls, path: str) -> "Encoder":
        """One per worker process and file."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        known, word = self.fst.words.get, self.fst.word
        for w in self._split(text):
            ids = known(w)
            out += word(w) if ids is None else ids
        return out

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        known, word = self.fst.words.get, self.fst.word
        return sum(len(word(w)) if (ids := known(w)) is None else len(ids) for w in self._split(text))

    def decode(self, ids: Iterable[int] | None) -> str:
        machine = Utf8Machine()
        return "".join(machine.feed(self.bytes_of[i]) for i in ids or ()) + machine.end()


class Utf8Machine:
    """Incremental UTF-8: feed() gives the characters that are complete so far, end() closes the stream.

    The state is the code point so far, how many continuation bytes are missing and the range that the next byte must
    lie in (which keeps out overlong forms, surrogates and values beyond U+10FFFF).
    """

    def __init__(self) -> None:
        self.value = self.missing = 0
        self.low, self.high = 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        if not self.missing and data.isascii():
            return data.decode("ascii")
        out: list[str] = []
        for b in data:
            if self.missing:
                if self.low <= b <= self.high:
                    self.value, self.missing, self.low, self.high = self.value << 6 | b & 0x3F, self.missing - 1, 0x80, 0xBF
                    if not self.missing:
                        out.append(chr(self.value))
                    continue
                out.append("�")
                self.missing, self.low, self.high = 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.value, self.missing = b & 0x1F, 1
            elif 0xE0 <= b <= 0xEF:
                self.value, self.missing = b & 0x0F, 2
                self.low, self.high = (0xA0, 0xBF) if b == 0xE0 else (0x80, 0x9F) if b == 0xED else (0x80, 0xBF)
            elif 0xF0 <= b <= 0xF4:
                self.value, self.missing = b & 0x07, 3
                self.low, self.high = (0x90, 0xBF) if b == 0xF0 else (0x80, 0x8F) if b == 0xF4 else (0x80, 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        cut, self.missing = self.missing, 0
        return "�" if cut else ""


def _lists(rows: list[list[int]]) -> pa.Array:
    sizes = np.fromiter((len(r) for r in rows), np.int64, len(rows))
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    flat = np.fromiter((i for r in rows for i in r), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))


def encode(df: DataFrame, text: str, keep: list[str], ids: str = "ids", path: str | None = None) -> DataFrame:
    """The columns ``keep`` and the ids of ``text`` of every row; no shuffle, two columns read."""
    path = path or vocabulary_path()
    picked = df.select(*keep, F.col(text).alias("_text"))
    schema = picked.select(*keep).schema.add(ids, T.ArrayType(T.IntegerType()), False)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):  # the ids of a large batch would fill memory
                part = batch.slice(at, 1000)
                rows = [encoder.encode(t) for t in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], _lists(rows)], names=[*keep, ids])

    return picked.mapInArrow(work, schema)


def token_counts(df: DataFrame, text: str, keep: list[str], name: str = "tokens", path: str | None = None) -> DataFrame:
    """The columns ``keep`` and the number of tokens of every row (0 for null and empty texts)."""
    path = path or vocabulary_path()
    picked = df.select(*keep, F.col(text).alias("_text"))
    schema = picked.select(*keep).schema.add(name, "long", False)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            counts = pa.array([encoder.count(t) for t in batch.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], counts], names=[*keep, name])

    return picked.mapInArrow(work, schema)


def decode(df: DataFrame, ids: str, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """The columns ``keep`` and the text of every list of ids; null for a null list. An id outside the vocabulary is an error."""
    path = path or vocabulary_path()
    picked = df.select(*keep, F.col(ids).alias("_ids"))
    schema = picked.select(*keep).schema.add(text, "string", True)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            texts = pa.array([None if i is None else encoder.decode(i) for i in batch.column(len(keep)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], texts], names=[*keep, text])

    return picked.mapInArrow(work, schema)


def export_ranks(json_path: str, to: str) -> None:
    """Write a byte-level vocabulary in JSON form as ranks, for vocabularies that come in that form only."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars, extra = {}, 0
    for b in range(256):
        if b in visible:
            chars[chr(b)] = b
        else:
            chars[chr(256 + extra)] = b
            extra += 1
    special = {t["content"] for t in json.loads(Path(json_path).read_text()).get("added_tokens", [])}
    vocab = json.loads(Path(json_path).read_text())["model"]["vocab"]
    lines = [(i, base64.b64encode(bytes(chars[c] for c in t)).decode()) for t, i in vocab.items() if t not in special]
    Path(to).write_text("".join(f"{t} {i}\n" for i, t in sorted(lines)))
