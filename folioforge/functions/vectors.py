"""Vectors: similarity as expressions, a deterministic stand-in for an embedding model, and the model protocols."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from folioforge.functions.text import terms

#: Dimensions of the stand-in embedding.
DIMENSIONS = 64


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class PairScorer(Protocol):
    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class ChatModel(Protocol):
    def complete(self, *, system_prompt: str, user_prompt: str) -> str: ...


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if either has no length; an error if their dimensions differ."""
    same = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different dimensions")).cast("double"))
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(same, F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm))


def hashed_embedding(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Counts of the text's terms in hashed bins: the stand-in where no embedding model is given."""
    bins = F.transform(terms(text), lambda t: (F.conv(F.substring(F.md5(t), 1, 7), 16, 10).cast("long") % dimensions).cast("int"))

    def counts(found: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda b: F.size(F.filter(found, lambda x: x == b)).cast("double"))

    # bound as a lambda's variable, the bins are computed once and not once per dimension
    return F.get(F.transform(F.array(bins), counts), F.lit(0))


def model_embedding(make: callable, batch: int = 64):
    """A column function around an embedding model; the model is made once per Python worker and fed in batches."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model: Embedder = make()
        for series in texts:
            out: list[list[float]] = []
            for at in range(0, len(series), batch):
                part = series.iloc[at : at + batch].fillna("").tolist()
                got = model.embed(part)
                if len(got) != len(part):
                    raise ValueError("the model returned another number of vectors than it was given texts")
                out += got
            yield pd.Series(out, index=series.index)

    return embed


def model_pair_score(make: callable, batch: int = 8):
    """A column function around a cross-encoder, as model_embedding."""

    @F.pandas_udf(T.DoubleType())
    def score(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model: PairScorer = make()
        for left, right in pairs:
            both = list(zip(left.fillna(""), right.fillna("")))
            out: list[float] = []
            for at in range(0, len(both), batch):
                out += model.score(both[at : at + batch])
            if len(out) != len(both):
                raise ValueError("the model returned another number of scores than it was given pairs")
            yield pd.Series(out, index=left.index)

    return score


def model_completion(make: callable):
    """A column function (system prompt, user prompt) to struct<text, error> around a chat model; a call that fails gives its error and no text."""

    @F.pandas_udf("text string, error string")
    def complete(prompts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model: ChatModel = make()
        for system, user in prompts:
            out = []
            for s, u in zip(system, user):
                try:
                    out.append((model.complete(system_prompt=s, user_prompt=u), None) if u is not None else (None, None))
                except Exception as e:  # noqa: BLE001  any failure belongs to its row
                    out.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["text", "error"], index=system.index, dtype="object")

    return complete


def overlap_score(question: Column, text: Column) -> Column:
    """Share of the question's distinct terms that the text holds: the stand-in for a cross-encoder."""
    q = F.array_distinct(terms(question))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, terms(text))) / F.size(q)).otherwise(F.lit(0.0))
