"""Range queries over series (grp, pos, val): prefix sums, inverses, segment trees, sparse tables, point updates.

Places count from 0 without gaps. Null values are skipped by folds, as SQL aggregates skip them; an empty series gives an
empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.lineage import cut

from .ordering import ranged


def prefix(series: DataFrame, fold=F.sum, both=lambda a, b: a + b) -> DataFrame:
    """grp, pos, acc: the fold of all values up to each place; ``both`` folds two folds.

    Ranges of (grp, pos) are folded by themselves; a group that crosses ranges gets the fold of its ranges before, so a
    group may be as long as the table.
    """
    rows = ranged(series.select("grp", "pos", "val"), F.col("grp"), F.col("pos"))
    up_to = Window.partitionBy("grp", "_range").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("grp").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("grp", "_range").agg(fold("val").alias("total")).withColumn("before", fold("total").over(earlier))
    before = before.filter("before IS NOT NULL").select(F.col("grp").alias("g"), F.col("_range").alias("r"), "before")
    # Only a range's first group can have begun before it, so this is a row a range at most.
    met = rows.withColumn("acc", fold("val").over(up_to)).join(F.broadcast(before), F.col("g").eqNullSafe(F.col("grp")) & (F.col("r") == F.col("_range")), "left")
    return met.select("grp", "pos", F.coalesce(both(F.col("before"), F.col("acc")), "before", "acc").alias("acc"))


def range_sum(series: DataFrame, queries: DataFrame) -> DataFrame:
    """grp, l, r, res of inclusive ranges: the difference of two prefix sums."""
    p = prefix(series)
    high = p.select("grp", F.col("pos").alias("r"), F.col("acc").alias("high"))
    right = queries.join(high, ["grp", "r"])
    low = p.select(F.col("grp").alias("g"), (F.col("pos") + 1).alias("after"), F.col("acc").alias("low"))
    met = right.join(low, (F.col("grp") == F.col("g")) & (F.col("l") == F.col("after")), "left")
    return met.select("grp", "l", "r", (F.col("high") - F.coalesce("low", F.lit(0))).alias("res"))


#: Levels of a segment tree that one step makes, each node of at most 2**STEP children's values.
STEP = 6


def segment_tree(series: DataFrame, fold) -> DataFrame:
    """grp, level, block, val: the fold of the 2**level places from block * 2**level, all levels and groups.

    ``fold`` is a commutative, associative aggregate (F.min, F.sum, ...). STEP levels are made at once from the nodes below
    them, so no group's values meet in one place, however long it is.
    """
    base, out, done = series.select("grp", F.col("pos").alias("block"), "val"), None, 0
    while True:
        steps = F.explode(F.sequence(F.lit(0), F.lit(STEP)))
        nodes = base.withColumn("up", steps).groupBy("grp", "up", F.expr("shiftright(block, up)").alias("block")).agg(fold("val").alias("val"))
        nodes = cut(nodes)
        named = nodes.filter(F.col("up") < STEP).select("grp", (F.col("up") + done).cast("int").alias("level"), "block", "val")
        out = named if out is None else out.unionByName(named)
        base, done = nodes.filter(F.col("up") == STEP).select("grp", "block", "val"), done + STEP
        if base.filter("block > 0").isEmpty():
            top = base.select("grp", F.lit(done).alias("level"), "block", "val")
            return out.unionByName(top)


def range_fold(series: DataFrame, queries: DataFrame, fold) -> DataFrame:
    """grp, l, r, res: a fold of inclusive ranges, of the at most two nodes a level of the segment tree that make them up.

    Ranges that hold no more places in all than a step of the tree would write are folded place by place. Ranges that hold
    no place, as those of a null bound, are missing.
    """
    asked = cut(queries.select("grp", "l", "r").distinct().filter("l <= r"))
    places = asked.agg(F.sum(F.col("r").cast("double") - F.col("l") + 1)).first()[0] or 0
    if places <= (STEP + 1) * series.count():
        return place_fold(series, asked, fold)
    return node_fold(segment_tree(series, fold), asked, fold)


#: A place's block of 2**BLOCK, within which a range is folded first.
BLOCK = 8


def place_fold(series: DataFrame, queries: DataFrame, fold) -> DataFrame:
    """As :func:`range_fold`, of the places themselves: rows meet by group and block, so a group may be as long as the table."""
    blocks = F.expr(f"sequence(shiftright(l, {BLOCK}), shiftright(r, {BLOCK}))")
    values = series.select("grp", F.expr(f"shiftright(pos, {BLOCK})").alias("block"), "pos", "val")
    met = queries.withColumn("block", F.explode(blocks)).join(values, ["grp", "block"]).filter("pos BETWEEN l AND r")
    return met.groupBy("grp", "l", "r", "block").agg(fold("val").alias("val")).groupBy("grp", "l", "r").agg(fold("val").alias("res"))


def node_fold(tree: DataFrame, queries: DataFrame, fold) -> DataFrame:
    levels = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2((F.col("r") - F.col("l") + 2).cast("double"))).cast("int"), F.lit(0)))
    at = queries.select("grp", "l", "r").distinct().filter("l <= r").withColumn("level", F.explode(levels))
    at = at.withColumns({"a": F.expr("shiftright(l + shiftleft(1L, level) - 1, level)"), "b": F.expr("shiftright(r + 1, level)")}).filter("a < b")
    left = F.when(F.col("a") % 2 == 1, F.array("a")).otherwise(F.array().cast("array<bigint>"))
    right = F.when(F.col("b") % 2 == 1, F.array(F.col("b") - 1)).otherwise(F.array().cast("array<bigint>"))
    wanted = at.withColumn("block", F.explode(F.array_union(left, right))).select("grp", "l", "r", "level", "block")
    return wanted.join(tree, ["grp", "level", "block"]).groupBy("grp", "l", "r").agg(fold("val").alias("res"))


def _euclid(a: Column, b: Column) -> Column:
    state = F.struct(F.abs(a).alias("a"), F.abs(b).alias("b"))
    step = lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, s["b"]).otherwise(s["a"] % F.when(s["b"] == 0, F.lit(1)).otherwise(s["b"])).alias("b"))
    steps = F.ceil(F.log2(F.greatest(F.least(F.abs(a), F.abs(b)), F.lit(1)).cast("double")) * 1.4405).cast("int") + 3  # by Lamé's theorem
    return F.aggregate(F.sequence(F.lit(1), steps), state, step, lambda s: s["a"])


def gcd(values: Column) -> Column:
    """Greatest common divisor of an array of longs, by Euclid's steps on absolute values."""
    return F.aggregate(values, F.lit(0).cast("long"), _euclid)


def lcm(values: Column) -> Column:
    """Least common multiple of an array of positive longs; null past the range of longs."""
    both = lambda a, b: F.greatest(gcd(F.array(a, b)), F.lit(1).cast("long"))
    return F.aggregate(values, F.lit(1).cast("long"), lambda a, b: F.try_multiply(a, F.call_function("div", b, both(a, b))))


#: What :func:`lcm_fold` gives past the range of longs; a null would be skipped by the next fold.
PAST = -1


def lcm_fold(values: Column) -> Column:
    """Least common multiple as an aggregate of positive longs, for :func:`range_fold`."""
    found, past = F.collect_list(values), F.lit(PAST).cast("long")
    return F.when(F.array_contains(found, past), past).otherwise(F.coalesce(lcm(found), past))


def point_assign(series: DataFrame, updates: DataFrame) -> DataFrame:
    """The series after the last update (grp, pos, seq, val) of each place."""
    last = updates.groupBy("grp", "pos").agg(F.max_by("val", "seq").alias("new"))
    return series.join(last, ["grp", "pos"], "left").select("grp", "pos", F.coalesce("new", "val").alias("val"))


def point_add(series: DataFrame, updates: DataFrame) -> DataFrame:
    """The series after all updates (grp, pos, delta) are added to their places; those of no place are ignored."""
    total = updates.groupBy("grp", "pos").agg(F.sum("delta").alias("delta"))
    return series.join(total, ["grp", "pos"], "left").select("grp", "pos", (F.col("val") + F.coalesce("delta", F.lit(0))).alias("val"))


def sparse_table(series: DataFrame, greatest: bool = True) -> DataFrame:
    """grp, k, pos, val: the largest (least) of 2**k values from each place, all levels.

    One window per level doubles the one below; levels stop at the longest series.
    """
    longest = series.agg(F.max("pos")).first()[0]
    best = F.greatest if greatest else F.least
    level, out, k = series.select("grp", "pos", "val"), None, 0
    while longest is not None and (1 << k) <= longest + 1:
        named = level.select("grp", F.lit(k).cast("long").alias("k"), "pos", "val")
        out = named if out is None else out.unionByName(named)
        after = F.lead("val", 1 << k).over(Window.partitionBy("grp").orderBy("pos"))
        level = level.withColumn("after", after).filter("after IS NOT NULL").select("grp", "pos", best("val", "after").alias("val"))
        k += 1
    return out if out is not None else series.select("grp", F.lit(0).cast("long").alias("k"), "pos", "val")


def sparse_query(levels: DataFrame, queries: DataFrame, greatest: bool = True) -> DataFrame:
    """grp, l, r, res: two equi-joins on the level whose blocks cover the range."""
    size = F.col("r") - F.col("l") + 1
    asked = queries.withColumn("k", F.floor(F.log2(size.cast("double")) + 1e-9).cast("long"))
    asked = asked.withColumn("second", F.col("r") - F.pow(F.lit(2.0), F.col("k").cast("double")).cast("long") + 1)
    a = levels.select("grp", "k", F.col("pos").alias("l"), F.col("val").alias("x"))
    b = levels.select("grp", "k", F.col("pos").alias("second"), F.col("val").alias("y"))
    best = F.greatest if greatest else F.least
    return asked.join(a, ["grp", "k", "l"]).join(b, ["grp", "k", "second"]).select("grp", "l", "r", best("x", "y").alias("res"))
