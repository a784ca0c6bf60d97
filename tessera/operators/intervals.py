"""Closed intervals (grp, s, e): coalescing, insertion, and overlaps by cells of their lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import ranged


def merge(df: DataFrame) -> DataFrame:
    """grp, s, e of coalesced intervals; touching ones join, neighbours a unit apart don't. Intervals with a null end, or
    that end before they start, are left out; a null group is one of its own.

    An interval that starts beyond all ends before it begins an island, which ends at the furthest of them before the
    next begins. Ranges of (grp, s, e) are gone through by themselves; what a group's ranges before and after say is
    added, so a group may be as long as the table.
    """
    rows = ranged(df.select("grp", "s", "e").filter("s <= e"), F.col("grp"), F.col("s"), F.col("e"))
    inside = Window.partitionBy("grp", "_range").orderBy("s", "e")
    tops = rows.groupBy("grp", "_range").agg(F.max("e").alias("top"))
    earlier = Window.partitionBy("grp").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = tops.withColumn("before", F.max("top").over(earlier)).filter("before IS NOT NULL").select(F.col("grp").alias("g"), F.col("_range").alias("r"), "before")
    # Only a range's first group can have begun before it, so this is a row a range at most.
    met = rows.withColumn("run", F.max("e").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    met = met.join(F.broadcast(before), F.col("g").eqNullSafe(F.col("grp")) & (F.col("r") == F.col("_range")), "left").withColumn("run", F.greatest("run", "before"))
    islands = met.filter("run IS NULL OR s > run").select("grp", "_range", "s", "e", "run")
    marked = met.groupBy("grp", "_range").agg(F.max("e").alias("top"), F.min_by("run", F.when(F.col("run").isNull() | (F.col("s") > F.col("run")), F.struct("s", "e"))).alias("first"))
    later = Window.partitionBy("grp").orderBy("_range").rowsBetween(1, Window.unboundedFollowing)
    ends = marked.withColumn("end", F.coalesce(F.first("first", ignorenulls=True).over(later), F.max("top").over(Window.partitionBy("grp"))))
    ends = ends.select(F.col("grp").alias("g"), F.col("_range").alias("r"), "end")
    out = islands.withColumn("next", F.lead("run").over(inside)).join(ends, F.col("g").eqNullSafe(F.col("grp")) & (F.col("r") == F.col("_range")))
    return out.select("grp", "s", F.coalesce("next", "end").alias("e"))


def insert(df: DataFrame, new: DataFrame) -> DataFrame:
    """Disjoint intervals after ``new`` ones are inserted, absorbing what they overlap or touch."""
    return merge(df.select("grp", "s", "e").unionByName(new.select("grp", "s", "e")))


def _level(s: Column, e: Column) -> Column:
    """The least k of which 4**k is at least an interval's length; 31 at most, as a cell's number is a shift of a long."""
    return F.least(F.ceil(F.log2((e - s).cast("double") + 1) / 2 - 1e-9).cast("int"), F.lit(31))


def _cells(df: DataFrame, suffix: str, level: Column | None = None) -> DataFrame:
    """The columns, named with ``suffix``, in each of the at most two cells of a level that an interval touches."""
    k = _level(F.col("s"), F.col("e")) if level is None else level
    put = df.withColumn("level", k).withColumn("cell", F.explode(F.expr("sequence(shiftright(s, 2 * level), shiftright(e, 2 * level))")))
    return put.select("grp", "level", "cell", *[F.col(c).alias(c + suffix) for c in df.columns if c != "grp"])


def _probing(df: DataFrame, levels: list[int], suffix: str, own: bool) -> DataFrame:
    """Every interval in the cells of those of ``levels`` that are above its own length's (its own too if ``own``)."""
    known = F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")
    k = _level(F.col("s"), F.col("e"))
    wider = F.filter(known, (lambda x: x >= k) if own else (lambda x: x > k))
    probing = df.withColumn("at", F.explode(wider))
    return _cells(probing, suffix, F.col("at")).drop("at" + suffix)


def _overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs that overlap: an interval is kept in cells as wide as it is long, and the shorter of a pair looks for the
    longer in the cells of every longer length that there is. A pair counts in the cell where its overlap begins."""
    a, b = (df.filter("grp IS NOT NULL AND s <= e") for df in (a, b))
    lengths = [sorted(r[0] for r in df.select(_level(F.col("s"), F.col("e"))).distinct().collect()) for df in (a, b)]  # at most 32
    met = _cells(a, "_a").join(_probing(b, lengths[0], "_b", True), ["grp", "level", "cell"])
    met = met.unionByName(_probing(a, lengths[1], "_a", False).join(_cells(b, "_b"), ["grp", "level", "cell"]))
    begins = F.expr("shiftright(greatest(s_a, s_b), 2 * level) = cell")
    return met.filter((F.col("s_a") <= F.col("e_b")) & (F.col("s_b") <= F.col("e_a")) & begins)


def self_overlap(df: DataFrame) -> DataFrame:
    """grp, s, e of each pairwise overlap of intervals (i before j by start), not coalesced; ``id`` breaks ties. A null
    group or end overlaps nothing."""
    rows = df.select("grp", "s", "e", "id")
    met = _overlaps(rows, rows).filter(F.struct("s_a", "id_a") < F.struct("s_b", "id_b"))
    return met.select("grp", F.col("s_b").alias("s"), F.least("e_a", "e_b").alias("e"))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """grp, s, e of the overlaps of two lists, each coalesced first."""
    met = _overlaps(merge(a), merge(b))
    return met.select("grp", F.greatest("s_a", "s_b").alias("s"), F.least("e_a", "e_b").alias("e"))
