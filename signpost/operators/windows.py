"""Window helpers shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_within(df: DataFrame, keys: str | list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """Rows 1..k per key, numbered in `rank`.

    The comparison with a constant right above row_number lets Spark keep k rows per key and task before the
    exchange (window group limit), so a key with a third of all rows sends only k of them per task.
    """
    window = Window.partitionBy(keys).orderBy(*order)
    best = df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)
    return best.withColumn(rank, F.col(rank).cast("long"))


def keep_last(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key: the last in `order` (given descending)."""
    return rank_within(df, key, order, 1, "_rank").drop("_rank")
