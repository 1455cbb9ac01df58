"""Building blocks for grouped work when one group may hold a large part of all rows.

A plain window sorts each group inside one task. That is the best plan while groups are small. Beyond
``HOT_ROWS`` rows a group is ranked by a global range sort in which the group's rows spread over many tasks,
and each task adds the number of the group's rows in the tasks before it. Both ways give the same numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from folioforge.session import cut

#: Groups of more rows than this are not handed to one task.
HOT_ROWS = 500_000
#: A table is broadcast only below this many rows.
BROADCAST_ROWS = 200_000


def small_or_plain(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most ``limit`` rows; else df, for Spark to choose a shuffled join.

    The size is checked by counting at most limit + 1 rows.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """The keys of groups with more than ``hot_rows`` rows; at most rows / hot_rows of them."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows).select(*keys)


def split_hot(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary groups, rows of hot groups or None). Rows whose key holds a null stay with the ordinary ones."""
    hot = hot_keys(df, keys, hot_rows).na.drop().collect()  # few by construction: rows / hot_rows
    if not hot:
        return df, None
    table = F.broadcast(df.sparkSession.createDataFrame(hot, df.select(*keys).schema))
    return df.join(table, list(keys), "left_anti"), df.join(table, list(keys), "left_semi")


def spread_row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rn", partitions: int | None = None) -> DataFrame:
    """row_number() per key in the given order, without ever bringing one key's rows into one task.

    The ranged rows are checkpointed, since their numbers depend on the partition they are in.
    """
    spark = df.sparkSession
    n = partitions or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sort = [F.col(k) for k in keys] + list(order)
    spread = cut(
        df.repartitionByRange(n, *sort)
        .sortWithinPartitions(*sort)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    held = spread.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_held"), F.min("_pos").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = held.withColumn("_before", F.coalesce(F.sum("_held").over(before), F.lit(0))).drop("_held")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] + [F.col("a._part") == F.col("b._part")]
    joined = spread.alias("a").join(small_or_plain(offset).alias("b"), on)
    return joined.select("a.*", (F.col("b._before") + F.col("a._pos") - F.col("b._first") + 1).alias(name)).drop("_part", "_pos")


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rn", hot_rows: int = HOT_ROWS) -> DataFrame:
    """row_number() per key: a window for ordinary groups, a range sort for hot ones."""
    plain, hot = split_hot(df, keys, hot_rows)
    out = plain.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    return out if hot is None else out.unionByName(spread_row_numbers(hot, keys, order, name))
