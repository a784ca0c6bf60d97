"""Heaps as ordered limits: the least or greatest rows, of all or of each group. Nulls come first ascending and last
descending, as the columns of ``by`` say; a null group is one of its own; fewer rows than k are all given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(df: DataFrame, by: list[Column], k: int) -> DataFrame:
    """The first k rows; end ``by`` with a unique column."""
    return df.orderBy(*by).limit(k)


def top_per_group(df: DataFrame, group: str, by: list[Column], k: int) -> DataFrame:
    """The first k rows of each group with their ``rank``; ranks are cut before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*by))
    return df.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)
