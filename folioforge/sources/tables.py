"""Parquet tables of one data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """The table, lazily; columns and filters reach the scan."""
    return spark.read.parquet(f"{data_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df, redistributed if its files give fewer tasks than half of the cores, for work that is heavy per row.

    A table of many files, as on a cluster, is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df
