"""Metadata filters: nested mappings of ``$and $or $eq $lte $gte`` compiled to column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

OPEN_END = date.max


def compile_filter(spec: Mapping[str, object] | None, column=F.col) -> Column:
    """The filter as a column. Unknown operators and conditions that are no mappings are errors here, not at run time.

    Equality holds between nulls; comparisons with a null are false; an empty ``$and`` is true and an empty ``$or`` false.
    """
    if spec is None:
        return F.lit(True)
    if not isinstance(spec, Mapping):
        raise ValueError("a filter must be a mapping")
    return reduce(lambda a, b: a & b, (_part(k, v, column) for k, v in spec.items()), F.lit(True))


def _part(key: str, value: object, column) -> Column:
    if key in ("$and", "$or"):
        if not isinstance(value, (list, tuple)):
            return F.lit(False)
        parts = [compile_filter(v, column) for v in value]
        return reduce(lambda a, b: a & b, parts, F.lit(True)) if key == "$and" else reduce(lambda a, b: a | b, parts, F.lit(False))
    if not isinstance(value, Mapping):
        raise ValueError(f"the condition on {key} must map operators to values")
    c = column(key)
    out = F.lit(True)
    for op, wanted in value.items():
        if op == "$eq":
            out = out & c.eqNullSafe(F.lit(wanted))
        elif op == "$lte":
            out = out & F.coalesce(c <= F.lit(wanted), F.lit(False))
        elif op == "$gte":
            out = out & F.coalesce(c >= F.lit(wanted), F.lit(False))
        else:
            raise ValueError(f"unknown filter operator {op}")
    return out


def iso_date(text: str) -> date:
    """A date in the one accepted form, yyyy-mm-dd."""
    try:
        d = date.fromisoformat(text)
    except ValueError as e:
        raise ValueError(f"not a date in the form yyyy-mm-dd: {text}") from e
    if d.isoformat() != text:
        raise ValueError(f"not a date in the form yyyy-mm-dd: {text}")
    return d


def current_version(family: str) -> dict:
    return {"document_family": {"$eq": family}, "is_current_version": {"$eq": True}}


def exact_version(family: str, version: str) -> dict:
    return {"document_family": {"$eq": family}, "version": {"$eq": version}}


def as_of(family: str, day: str) -> dict:
    """Valid on the day, both ends included. Rows carry expiry_or_open, whose open end is the greatest date."""
    d = iso_date(day)
    return {"$and": [{"document_family": {"$eq": family}}, {"effective_date": {"$lte": d}}, {"expiry_or_open": {"$gte": d}}]}


def within_sources(paths: Iterable[str], also: Mapping[str, object] | None = None) -> dict:
    scope = {"$or": [{"source_path": {"$eq": p}} for p in paths]}
    return scope if also is None else {"$and": [dict(also), scope]}


def index_columns(documents: DataFrame) -> DataFrame:
    """Columns derived for filtering: ordinals of the dates, the family and whether the version is the current one."""
    ordinal = lambda c: F.datediff(c, F.lit("0001-01-01").cast("date")) + 1
    end = F.coalesce(F.col("expiry_date"), F.lit(OPEN_END))
    return (
        documents.withColumn("document_family", F.col("doc_id"))
        .withColumn("is_current_version", F.when(F.col("version").isNotNull(), F.coalesce(F.col("status") == "current", F.lit(False))))
        .withColumn("expiry_or_open", F.when(F.col("effective_date").isNotNull(), end))
        .withColumn("effective_date_ordinal", ordinal(F.col("effective_date")))
        .withColumn("expiry_date_ordinal", F.when(F.col("effective_date").isNotNull(), ordinal(end)))
    )


def as_of_join(probes: DataFrame, documents: DataFrame, family: str = "family", day: str = "day") -> DataFrame:
    """Each probe (family, day, …) with the document versions valid on its day: equi-join on the family, then the range."""
    d = index_columns(documents)
    on = (F.col(f"p.{family}") == d["document_family"]) & (d["effective_date"] <= F.col(f"p.{day}")) & (d["expiry_or_open"] >= F.col(f"p.{day}"))
    return probes.alias("p").join(d, on).select("p.*", d["source_path"], d["version"], d["effective_date"], d["expiry_date"])
