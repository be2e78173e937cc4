"""Rows dealt over all tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df in two parts for each core, by hash of the keys or evenly.

    A table of narrow rows is a file of few row groups, which as few tasks read; work that costs more than moving the rows is done behind this.
    The number is given, so that adaptive execution does not join parts that are small in bytes.
    """
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def dealt_by_size(df: DataFrame, *keys: str) -> DataFrame:
    """df in as many parts as the session shuffles into, by hash of the keys: for work whose memory grows with a part, as a session for larger inputs sets more."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
