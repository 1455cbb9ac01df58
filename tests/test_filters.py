import datetime as dt

import pytest

from folioforge.operators import filters
from tests.conftest import rows

DOC = "source_path string, doc_id string, version string, status string, effective_date date, expiry_date date, document_family string"


def docs(spark):
    data = [
        ("old", "POL-1", "1", "superseded", dt.date(2024, 1, 1), dt.date(2024, 6, 30), "clash"), ("new", "POL-1", "2", "current", dt.date(2024, 7, 1), None, "clash"),
        ("none", "POL-1", None, "current", None, None, None), ("act", "POL-2", "1", "active", dt.date(2026, 3, 1), None, None), (None, None, None, None, None, None, None),
    ]
    return filters.index_columns(spark.createDataFrame(data, DOC))


def kept(spark, spec):
    return [r[0] for r in rows(docs(spark).filter(filters.compile_filter(spec)), "source_path")]


def test_versions(spark):
    assert kept(spark, filters.current_version("POL-1")) == ["new"]
    assert kept(spark, filters.exact_version("POL-1", "1")) == ["old"]
    assert kept(spark, filters.as_of("POL-1", "2024-06-30")) == ["old"] and kept(spark, filters.as_of("POL-1", "2024-07-01")) == ["new"]
    assert kept(spark, filters.current_version("POL-2")) == []  # active is not current
    row = docs(spark).filter("source_path = 'act'").head()
    assert (row.effective_date_ordinal, row.expiry_date_ordinal) == (739676, 3652059)


def test_composition(spark):
    assert kept(spark, {"$or": []}) == [] and len(kept(spark, {"$and": []})) == 5 and len(kept(spark, None)) == 5
    assert kept(spark, {"version": {"$eq": None}, "status": {"$eq": "current"}}) == ["none"]
    assert kept(spark, {"$and": "x"}) == [] and kept(spark, {"version": {"$gte": "1", "$lte": "1"}}) == ["act", "old"]
    assert kept(spark, filters.within_sources(["old", "new"], {"status": {"$eq": "current"}})) == ["new"]
    for bad in ({"status": "current"}, {"status": {"$gt": 1}}, "x"):
        with pytest.raises(ValueError):
            filters.compile_filter(bad)
    for bad in ("2024-6-1", "01.06.2024", "20240601"):
        with pytest.raises(ValueError):
            filters.iso_date(bad)


def test_as_of_join(spark):
    probes = spark.createDataFrame([("POL-1", dt.date(2024, 3, 1), 1), ("POL-1", dt.date(2023, 3, 1), 2), (None, None, 3)], "family string, day date, status int")
    base = docs(spark).select("source_path", "doc_id", "version", "status", "effective_date", "expiry_date")
    assert rows(filters.as_of_join(probes, base), "family", "status", "source_path") == [("POL-1", 1, "old")]
