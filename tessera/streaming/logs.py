"""Streaming forms of the counting operators over event logs (ts, key): watermarked windows and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_multiset(stream: DataFrame, width: str, late: str) -> DataFrame:
    """start, key, cnt of each window; events later than ``late`` are dropped with their state."""
    rows = stream.select(F.col("ts").cast("timestamp").alias("ts"), "key").withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width).alias("w"), "key").agg(F.count("*").alias("cnt")).select(F.col("w.start").alias("start"), "key", "cnt")


def windowed_majority(stream: DataFrame, width: str, late: str) -> DataFrame:
    """start, candidate, top, n, is_majority: of each window the most frequent key (ties: the least), its count, all events,
    and whether it has more than half. Counts are kept by window and key, so no state holds all keys of a window."""
    rows = stream.select(F.col("ts").cast("timestamp").alias("ts"), "key").withWatermark("ts", late)
    counts = rows.groupBy(F.window("ts", width).alias("w"), "key").agg(F.count("*").alias("c"))
    whole = counts.groupBy(F.window(F.window_time("w"), width).alias("v")).agg(F.min_by("key", F.struct(-F.col("c"), F.col("key"))).alias("candidate"), F.max("c").alias("top"), F.sum("c").alias("n"))
    return whole.select(F.col("v.start").alias("start"), "candidate", "top", "n", (F.col("top") * 2 > F.col("n")).alias("is_majority"))


def sessions(stream: DataFrame, gap: str, late: str) -> DataFrame:
    """key, start, stop, cnt: a key's events coalesced while they are within ``gap``, as intervals are."""
    rows = stream.select(F.col("ts").cast("timestamp").alias("ts"), "key").withWatermark("ts", late)
    found = rows.groupBy(F.session_window("ts", gap).alias("w"), "key").agg(F.count("*").alias("cnt"))
    return found.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "cnt")
