"""Parquet tables of one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table; columns and filters are pruned and pushed by the Parquet reader."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer partitions than cores (one small or unsplittable file) dealt over all cores; larger ones are left as they are.

    Worth its shuffle only before costly work on each row, such as tokenising.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame) -> DataFrame:
    """A table dealt evenly over four tasks a core, however its files are cut: splits of a file without a row group of their own are empty.

    For narrow rows before functions that take a millisecond each, where one row group would keep all work in one task.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)
