from pyspark.sql import functions as F

from folioforge.operators.groups import hot_keys, row_numbers, small_or_plain, spread_row_numbers
from tests.conftest import rows


def test_hot_groups_get_the_same_numbers(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"), (F.col("id") % 97).alias("v"), "id")
    df = df.unionByName(spark.createDataFrame([(None, 1, -1), (None, 2, -2)], df.schema))
    order = [F.col("v").desc(), F.col("id")]
    assert [r.k for r in hot_keys(df, ["k"], 500).collect()] == ["hot"]
    plain = rows(row_numbers(df, ["k"], order, hot_rows=10**9))
    assert rows(row_numbers(df, ["k"], order, hot_rows=500)) == plain
    assert rows(spread_row_numbers(df, ["k"], order, "rn", 7), *row_numbers(df, ["k"], order).columns) == plain


def test_small_or_plain(spark):
    plan = lambda d: d._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(small_or_plain(spark.range(5), 10)) and "broadcast" not in plan(small_or_plain(spark.range(50), 10))
