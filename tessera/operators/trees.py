"""Trees (id, parent): ancestors, lowest common ancestors, search-tree lookups. Roots have a null parent; a query of a
vertex or key that is null or not there finds null, or nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.lineage import cut

from .lookup import value_bounds
from .ordering import ranked
from .ranges import range_fold


def from_level_order(df: DataFrame, position: str, key: str) -> DataFrame:
    """id, parent, key of a binary tree listed level by level: the children of place i are 2i + 1 and 2i + 2."""
    return df.select(F.col(position).alias("id"), F.when(F.col(position) > 0, F.floor((F.col(position) - 1) / 2)).alias("parent"), F.col(key).alias("key"))


def ancestors(tree: DataFrame) -> DataFrame:
    """id, anc, steps: every vertex's ancestors, itself included; paths double each round."""
    up = cut(tree.select("id", F.col("parent").alias("anc")).filter("anc IS NOT NULL"))
    out, jump, size = tree.select("id", F.col("id").alias("anc"), F.lit(0).cast("long").alias("steps")), up, 1
    out = cut(out)
    while not jump.isEmpty():
        # Ancestors up to size - 1 steps away are known; those of the vertex 2**k steps up make them twice as many.
        far = jump.select("id", F.col("anc").alias("via")).join(out.select(F.col("id").alias("via"), "anc", "steps"), "via")
        out = cut(out.union(far.select("id", "anc", (F.col("steps") + size).alias("steps"))))
        jump = cut(jump.select("id", F.col("anc").alias("via")).join(jump.select(F.col("id").alias("via"), "anc"), "via").select("id", "anc"))
        size *= 2
    return out


def lca(tree: DataFrame, queries: DataFrame) -> DataFrame:
    """u, v, lca of each query pair (u, v); null if they share no ancestor."""
    anc = ancestors(tree)
    a = queries.join(anc.toDF("u", "anc", "su"), "u")
    met = a.join(anc.toDF("v", "anc", "sv"), ["v", "anc"])
    low = met.groupBy("u", "v").agg(F.min_by("anc", F.col("su") + F.col("sv")).alias("lca"))
    return queries.join(low, ["u", "v"], "left").select("u", "v", "lca")


def search_tree_lca(tree: DataFrame, queries: DataFrame) -> DataFrame:
    """u, v, lca of keys in a binary search tree (key, depth): the shallowest key between them, whichever is larger; none
    where no key lies between. Keys are unique.

    Keys are numbered in their order and the least depth of a run of numbers is that of a few nodes of a segment tree.
    """
    keys = cut(ranked(tree.select("key", "depth"), F.col("key"), []))
    series = keys.select(F.lit(0).alias("grp"), (F.col("rank") - 1).alias("pos"), F.struct("depth", "key").alias("val"))
    asked = queries.select("u", "v").distinct()
    ends = asked.select(F.col("u").alias("v")).union(asked.select("v")).distinct()
    places = cut(value_bounds(keys.select(F.col("key").alias("v")), ends).select("v", "lower", "upper"))
    met = asked.join(places.toDF("u", "ul", "uu"), "u").join(places.toDF("v", "vl", "vu"), "v")
    met = cut(met.select("u", "v", F.lit(0).alias("grp"), F.least("ul", "vl").alias("l"), (F.greatest("uu", "vu") - 1).alias("r")))
    low = range_fold(series, met.select("grp", "l", "r"), F.min)
    return met.join(low, ["grp", "l", "r"]).select("u", "v", F.col("res.key").alias("lca"))


def search(tree: DataFrame, keys: DataFrame) -> DataFrame:
    """key, found of each key asked for."""
    there = tree.select("key").distinct().withColumn("found", F.lit(True))
    return keys.select("key").join(there, "key", "left").select("key", F.coalesce("found", F.lit(False)).alias("found"))
