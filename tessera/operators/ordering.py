"""Total order without a single task: ranks by ranges, sortedness, histograms, sequence edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.lineage import cut

def ranged(df: DataFrame, *order: Column) -> DataFrame:
    """The rows, written, with ``_range``, a number of the range of ``order`` that they fall in: range partitions, as many as
    the session shuffles to, cut anywhere in the order, so that ties on a first key don't share one."""
    return cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))


def ranked(df: DataFrame, key: Column, ties: list[str], ascending: bool = True) -> DataFrame:
    """``rank`` (from 1) of every row by a key, nulls first (last if descending), then ``ties``: each range orders its own
    rows, and the counts of the ranges before it are added."""
    order = [key.asc() if ascending else key.desc(), *[F.col(t).asc() for t in ties]]
    rows = ranged(df, *order)
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # a row a partition
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return rows.withColumn("_inside", inside).join(F.broadcast(sizes), "_range").withColumn("rank", F.col("_before") + F.col("_inside")).drop("_range", "_inside", "_before")


def is_sorted(df: DataFrame, ascending: bool = True) -> DataFrame:
    """grp, sorted of a series (grp, pos, val): whether no value is below (above, if descending) the one before; a null
    breaks no order."""
    before = F.lag("val").over(Window.partitionBy("grp").orderBy("pos"))
    return df.withColumn("ok", F.coalesce(before <= F.col("val") if ascending else before >= F.col("val"), F.lit(True))).groupBy("grp").agg(F.bool_and("ok").alias("sorted"))


def digit_histogram(df: DataFrame, number: str) -> DataFrame:
    """digit, place (from the right, 0), n: the counts of a radix sort's passes over non-negative integers."""
    text = F.reverse(F.col(number).cast("string"))
    digits = df.select(F.posexplode(F.split(text, "")).alias("place", "digit"))
    return digits.filter("digit <> ''").groupBy(F.col("digit").cast("long").alias("digit"), F.col("place").cast("long").alias("place")).agg(F.count("*").alias("n"))


def reverse(df: DataFrame) -> DataFrame:
    """A series (grp, pos, val) backwards."""
    n = F.count("*").over(Window.partitionBy("grp"))
    return df.select("grp", (n - 1 - F.col("pos")).alias("pos"), "val")


def fill(df: DataFrame, value) -> DataFrame:
    """A series (grp, pos, val) with every value replaced by one."""
    return df.select("grp", "pos", F.lit(value).cast(dict(df.dtypes)["val"]).alias("val"))


def from_lists(df: DataFrame) -> DataFrame:
    """A series (grp, pos, val) of arrays (grp, vals); an empty or null array gives no rows."""
    return df.select("grp", F.posexplode("vals").alias("pos", "val")).select("grp", F.col("pos").cast("long").alias("pos"), "val")


def to_lists(df: DataFrame) -> DataFrame:
    """Arrays (grp, vals) of a series (grp, pos, val), by place; a group's list has to fit a row."""
    return df.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "val"))), lambda x: x["val"]).alias("vals"))
