"""Every query of the subpackage against its SQL, or at least run, on the smallest tables."""

import os

import pytest

from folioforge.llm import queries
from tests.compare import DATA, assert_same

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
COLUMNS = {
    "p2_found": ["item_kind", "item_id", "cut"], "p3_found": ["question_id", "chunk_id"], "p4_found": ["trace_id", "defect"], "p6_found": ["trace_id", "label"],
    "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "kind", "lang"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    if name in queries.SQL:
        assert_same(spark, queries.QUERIES[name], queries.SQL[name])
    else:
        df = queries.QUERIES[name](spark, DATA)
        assert df.count() > 0 and df.columns == COLUMNS.get(name, df.columns)
        if name.endswith("_found"):
            assert df.count() == df.distinct().count()
