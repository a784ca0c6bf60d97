"""Multisets, majorities and folds. A null key or group is one of its own; null values of a majority count as a value;
empty tables give empty ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def multiset(df: DataFrame, key: str) -> DataFrame:
    """key, cnt."""
    return df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("cnt"))


def multiset_net(log: DataFrame, strict: bool = False) -> DataFrame:
    """key, cnt of what is left after a log (key, delta); keys at zero or below are gone, or an error if ``strict``."""
    net = log.groupBy("key").agg(F.sum("delta").cast("long").alias("cnt"))
    if strict:
        net = net.withColumn("cnt", F.when(F.col("cnt") < 0, F.raise_error(F.lit("removal of an absent key"))).otherwise(F.col("cnt")))
    return net.filter("cnt > 0")


def majority(df: DataFrame, group: str, value: str) -> DataFrame:
    """grp, candidate, n, is_majority: the most frequent value (ties: the least) and whether it has more than half."""
    counts = df.groupBy(F.col(group).alias("grp"), F.col(value).alias("v")).agg(F.count("*").alias("c"))
    best = counts.groupBy("grp").agg(F.sum("c").alias("n"), F.max("c").alias("top"), F.min_by("v", F.struct(-F.col("c"), F.col("v"))).alias("candidate"))
    return best.select("grp", "candidate", "n", (F.col("top") > F.floor(F.col("n") / 2)).alias("is_majority"))


def fold(array: Column, start: Column, step) -> Column:
    """A left fold of an array."""
    return F.aggregate(array, start, step)
