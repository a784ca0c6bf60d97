"""Ordered lookups: bounds, as-of, ordered maps, membership, stacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import ranged


def value_bounds(elements: DataFrame, queries: DataFrame) -> DataFrame:
    """v, lower (elements below v), upper (elements at most v), found (least 0-based index of v, or -1) of each query
    value, among all ``elements`` (v); null elements count as below all, a null query has nulls' place.

    Distinct values are cut into ranges; a running count within a range is added to the counts of those before it, so
    no task sees all.
    """
    counts = elements.groupBy("v").agg(F.count("*").alias("n"))
    both = counts.select("v", "n", F.lit(0).alias("asked")).unionByName(queries.select("v", F.lit(0).cast("long").alias("n"), F.lit(1).alias("asked")))
    merged = ranged(both.groupBy("v").agg(F.sum("n").alias("n"), F.max("asked").alias("asked")), F.col("v"))
    before = Window.partitionBy("_range").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    sizes = merged.groupBy("_range").agg(F.sum("n").alias("size"))
    sizes = sizes.select("_range", F.coalesce(F.sum("size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    low = F.col("start") + F.coalesce(F.col("run"), F.lit(0))
    out = merged.withColumn("run", F.sum("n").over(before)).join(F.broadcast(sizes), "_range").filter("asked = 1")  # a row a partition
    return out.select("v", low.alias("lower"), (low + F.col("n")).alias("upper"), F.when(F.col("n") > 0, low).otherwise(F.lit(-1)).cast("long").alias("found"))


def partition_point(lists: DataFrame, before: Column) -> DataFrame:
    """grp, at: how many of a list's values (grp, val) lie before the place that a predicate marks, the callback form of
    bounds: where the list is ordered so that the predicate holds up to that place. A null counts as beyond it."""
    return lists.groupBy("grp").agg(F.count_if(before).alias("at"))


def asof_backward(left: DataFrame, right: DataFrame) -> DataFrame:
    """left (grp, t, id) with the ``val`` of the last right row (grp, t, val) at or before it, null values passed over.

    Ranges of (grp, t) are gone through by themselves; a group that crosses ranges gets the last value of those before.
    """
    both = left.select("grp", "t", "id", F.lit(None).cast(dict(right.dtypes)["val"]).alias("val"), F.lit(1).alias("side")).unionByName(
        right.select("grp", "t", F.lit(None).cast(dict(left.dtypes)["id"]).alias("id"), "val", F.lit(0).alias("side")))
    rows = ranged(both, F.col("grp"), F.col("t"), F.col("side"))
    up_to = Window.partitionBy("grp", "_range").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("grp").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    latest = F.max_by("val", F.when(F.col("val").isNotNull(), F.struct("t", "side")))
    before = rows.groupBy("grp", "_range").agg(latest.alias("latest")).withColumn("before", F.last("latest", ignorenulls=True).over(earlier))
    before = before.filter("before IS NOT NULL").select(F.col("grp").alias("g"), F.col("_range").alias("r"), "before")
    met = rows.withColumn("val", F.last("val", ignorenulls=True).over(up_to)).filter("side = 1")
    # Only a range's first group can have begun before it, so this is a row a range at most.
    met = met.join(F.broadcast(before), F.col("g").eqNullSafe(F.col("grp")) & (F.col("r") == F.col("_range")), "left")
    return met.select("grp", "t", "id", F.coalesce("val", "before").alias("val"))


def map_state(log: DataFrame) -> DataFrame:
    """key, val of an ordered map after a log (key, seq, op, val): the last operation of a key counts, deletes drop it."""
    last = log.groupBy("key").agg(F.max_by(F.struct("op", "val"), "seq").alias("x"))
    return last.filter("x.op <> 'delete'").select("key", F.col("x.val").alias("val"))


def map_get(state: DataFrame, keys: DataFrame) -> DataFrame:
    """key, val, ok of each key asked for."""
    found = state.withColumn("ok", F.lit(True))
    return keys.select("key").join(found, "key", "left").select("key", "val", F.coalesce("ok", F.lit(False)).alias("ok"))


def find_at_most(lists: DataFrame, targets: DataFrame) -> DataFrame:
    """grp, target, pos, val, contains: the first node of each descending list (grp, pos, val) whose value is at most the
    target; pos -1 if none. An as-of step: one pass over a group's nodes and targets by value."""
    nodes = lists.select("grp", F.col("val").alias("t"), F.lit(0).alias("side"), (-F.col("pos")).alias("last"), F.struct("pos", "val").alias("x"))
    asked = targets.distinct().select("grp", F.col("target").alias("t"), F.lit(1).alias("side"), F.lit(0).cast("long").alias("last"), F.lit(None).cast(nodes.schema["x"].dataType).alias("x"))
    found = F.last("x", ignorenulls=True).over(Window.partitionBy("grp").orderBy("t", "side", "last").rowsBetween(Window.unboundedPreceding, 0))
    out = nodes.unionByName(asked).withColumn("x", found).filter("side = 1")
    return out.select("grp", F.col("t").alias("target"), F.coalesce("x.pos", F.lit(-1)).cast("long").alias("pos"), F.coalesce(F.col("x.val") == F.col("t"), F.lit(False)).alias("contains"))


def stack_tops(log: DataFrame) -> DataFrame:
    """grp, seq, depth of a push/pop log (grp, seq, delta of 1 or -1), pops of an empty stack ignored.

    The depth is the running sum less its running minimum, where that is below zero.
    """
    w = Window.partitionBy("grp").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    summed = log.withColumn("run", F.sum("delta").over(w))
    floor = F.least(F.min("run").over(w), F.lit(0))
    return summed.select("grp", "seq", (F.col("run") - floor).cast("long").alias("depth"))


def stack_values(log: DataFrame) -> DataFrame:
    """grp, seq, popped, top: of a log (grp, seq, delta of 1 or -1, val) the value that each pop gives (null of an empty
    stack, and for pushes) and the value on top afterwards (null if none).

    A pop from depth d gives the last value that was pushed to depth d, and leaves the last that was pushed to d - 1.
    """
    w = Window.partitionBy("grp").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    summed = log.withColumn("run", F.sum("delta").over(w))
    summed = summed.withColumn("depth", F.col("run") - F.least(F.min("run").over(w), F.lit(0)))
    empty = (F.col("delta") < 0) & (F.coalesce(F.lag("depth").over(Window.partitionBy("grp").orderBy("seq")), F.lit(0)) == 0)
    summed = summed.withColumn("empty", empty)

    def last_pushed(level: Column) -> Column:
        at = Window.partitionBy("grp", level).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
        return F.last(F.when(F.col("delta") > 0, F.struct("val")), ignorenulls=True).over(at)["val"]

    taken = summed.withColumn("popped", F.when((F.col("delta") < 0) & ~F.col("empty"), last_pushed(F.col("depth") + F.when(F.col("delta") < 0, 1).otherwise(0))))
    top = F.when(F.col("delta") > 0, F.col("val")).when(F.col("depth") > 0, last_pushed(F.col("depth")))
    return taken.withColumn("top", top).select("grp", "seq", "popped", "top")


def insert_after(lists: DataFrame, new: DataFrame) -> DataFrame:
    """Lists (grp, pos, val) with each new value (grp, pos, val) behind the node at ``pos`` (-1: at the head); one a node."""
    at = Window.partitionBy("grp").orderBy("pos", "late")
    both = lists.select("grp", "pos", "val", F.lit(0).alias("late")).unionByName(new.select("grp", "pos", "val", F.lit(1).alias("late")))
    return both.select("grp", (F.row_number().over(at) - 1).cast("long").alias("pos"), "val")


def remove_after(lists: DataFrame, nodes: DataFrame) -> DataFrame:
    """Lists without the node behind each of ``nodes`` (grp, pos), renumbered."""
    gone = nodes.select("grp", (F.col("pos") + 1).alias("pos")).distinct()
    at = F.row_number().over(Window.partitionBy("grp").orderBy("pos")) - 1
    return lists.join(gone, ["grp", "pos"], "left_anti").select("grp", at.cast("long").alias("pos"), "val")
