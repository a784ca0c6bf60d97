"""Parquet tables and the standard shapes that operators take: spans, series, graphs, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(column: str):
    return F.datediff(F.col(column).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")


def cents(column: str):
    return F.round(F.col(column) * 100).cast("long")


def spans(spark: SparkSession, sf_dir: str, flag: str | None = None) -> DataFrame:
    """grp, s, e: each line item's days between order and shipping, by customer."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", day("o_orderdate").alias("a"))
    items = table(spark, sf_dir, "lineitem")
    items = items.filter(F.col("l_returnflag") == flag) if flag else items
    met = items.select("l_orderkey", day("l_shipdate").alias("b")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return met.select(F.col("o_custkey").alias("grp"), F.least("a", "b").alias("s"), F.greatest("a", "b").alias("e"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grp, pos (from 0), val: a customer's order totals in cents by day and key."""
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("grp"), pos.cast("long").alias("pos"), cents("o_totalprice").alias("val"))


def middle_halves(s: DataFrame) -> DataFrame:
    """grp, l, r: for each group the query from its first to its third quarter."""
    n = s.groupBy("grp").agg(F.count("*").alias("n"))
    return n.select("grp", F.floor(F.col("n") / 4).cast("long").alias("l"), F.least(F.floor(3 * F.col("n") / 4), F.col("n") - 1).cast("long").alias("r"))


def trade_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, w: from each customer nation to every supplier nation that ships to it, with the least price in cents."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", cents("l_extendedprice").alias("w"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    met = i.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return met.groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.min("w").alias("w"))


def supply_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst, w) from each customer (2 * key) to each of its suppliers (2 * key + 1) with the least price in
    cents, and all customers and suppliers as vertices (id)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", cents("l_extendedprice").alias("w"))
    met = i.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    edges = met.groupBy((F.col("o_custkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst")).agg(F.min("w").alias("w"))
    ids = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("id")).union(table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2 + 1).alias("id")))
    return edges, ids


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"))


def write(df: DataFrame, path: str, partitions: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Sink: Parquet, partitioned by the columns named."""
    df.write.mode(mode).partitionBy(*(partitions or [])).parquet(path)
