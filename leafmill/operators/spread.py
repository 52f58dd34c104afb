"""Rows dealt evenly over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over at least four tasks a core. A table of few bytes is read by
    one task or a few, however long the work on each of its rows takes."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


def by_key(rows: DataFrame, *key: str) -> DataFrame:
    """``rows`` dealt by a key for aggregates and joins of its own, over at least
    as many tasks. What a plan shuffles for itself is put together again to a
    share for each core, so that a task's tables in memory grow with the input;
    a number that is asked for stays."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *key)
