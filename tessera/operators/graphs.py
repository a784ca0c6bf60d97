"""Graphs of edges (src, dst[, w]) and vertices (id), by rounds of joins; each round's state is a written table.

Edges with a null end lead nowhere, repeated edges count once (the lightest, where weights matter), an empty graph gives
every vertex by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.lineage import cut


def reverse(edges: DataFrame) -> DataFrame:
    return edges.withColumnsRenamed({"src": "dst", "dst": "src"}).select(*edges.columns)


def in_lists(edges: DataFrame) -> DataFrame:
    """dst, sources: the sorted, comma-joined vertices with an edge to it."""
    return edges.groupBy("dst").agg(F.array_join(F.transform(F.array_sort(F.collect_list("src")), lambda x: x.cast("string")), ",").alias("sources"))


def _spread(labels: DataFrame, edges: DataFrame, same: str | None = None) -> DataFrame:
    """Least label along edges to a fixed point; (id, label); ``same`` keeps to edges within one value of a column."""
    labels = cut(labels)
    frontier = labels
    while True:
        sent = frontier.join(edges, F.col("id") == F.col("src")).groupBy("dst").agg(F.min("label").alias("sent"))
        # Only vertices whose label fell go on to the next round.
        new = cut(labels.join(sent, F.col("id") == F.col("dst"), "left").select("id", F.least("label", "sent").alias("label"), (F.col("sent") < F.col("label")).alias("fell")))
        labels, frontier = new.select("id", "label"), new.filter("fell").select("id", "label")
        if frontier.isEmpty():
            return labels


def roots(links: DataFrame) -> DataFrame:
    """node, root of every node of undirected ``links`` (a, b): the least node that it is connected with.

    Each round a node takes its neighbours' least root, its root passes its own better one to all that point at it, and
    then the root's root is taken, so that rounds grow with the logarithm of a chain's length.
    """
    edges = cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = cut(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        near = edges.join(labels.toDF("b", "r"), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("r"))
        lower = labels.join(near, "node").select("node", F.least("root", "r").alias("root"), F.col("root").alias("was"))
        hop = lower.groupBy(F.col("was").alias("k")).agg(F.min("root").alias("best"))
        hop2 = lower.select(F.col("node").alias("k2"), F.col("root").alias("next"))
        new = lower.join(hop, lower["was"] == hop["k"]).withColumn("root", F.least("root", "best")).drop("k", "best")
        new = new.join(hop2, new["root"] == hop2["k2"], "left").select("node", F.least("root", F.coalesce("next", "root")).alias("root"), "was")
        new = cut(new)
        if new.filter("root <> was").isEmpty():
            return new.select("node", "root")
        labels = new.select("node", "root")


def components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """id, comp (least id) of undirected components; isolated vertices are their own, null ends link nothing."""
    found = roots(edges.filter("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return vertices.select("id").join(found.toDF("id", "root"), "id", "left").select("id", F.coalesce("root", "id").alias("comp"))


def _peeled(edges: DataFrame) -> DataFrame:
    """What is left of the edges when vertices without an edge into them, or out of them, go again and again."""
    left = cut(edges.select("src", "dst").distinct())
    n = left.count()
    while n:
        kept = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        kept = cut(kept.join(kept.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        m = kept.count()
        if m == n:
            break
        left, n = kept, m
    return left


def has_cycle(edges: DataFrame) -> DataFrame:
    """has_cycle: one row; a self-loop is a cycle, an empty graph has none."""
    left = _peeled(edges)
    return left.agg((F.count("*") > 0).alias("has_cycle"))


def scc(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """id, comp (least id) of strongly connected components.

    Each round spreads least ids forward, and from every vertex that keeps its own goes back within its colour: what
    that reaches is its component. At least one component is found for each colour, so rounds are few.
    """
    left_v, left_e, done = cut(vertices.select("id")), cut(edges.select("src", "dst").distinct()), None
    while not left_v.isEmpty():
        colour = _spread(left_v.select("id", F.col("id").alias("label")), left_e)
        tagged = left_e.join(colour.toDF("src", "a"), "src").join(colour.toDF("dst", "b"), "dst").filter("a = b").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        tagged = cut(tagged)
        found = cut(colour.filter("id = label").withColumnRenamed("label", "comp"))
        fresh = found
        while not fresh.isEmpty():
            step = fresh.join(tagged, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), "comp").distinct()
            fresh = cut(step.join(found, "id", "left_anti"))
            found = cut(found.union(fresh))
        done = found if done is None else done.union(found)
        left_v = cut(left_v.join(found, "id", "left_anti"))
        ids = left_v.select("id")
        left_e = cut(left_e.join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi").select("src", "dst"))
    return done if done is not None else vertices.select("id", F.col("id").alias("comp"))


def cycle_vertices(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """id of vertices on a cycle: in a component of several, or with a self-loop."""
    comp = scc(edges, vertices)
    big = comp.groupBy("comp").count().filter("count > 1").join(comp, "comp").select("id")
    return big.union(edges.filter("src = dst").select(F.col("src").alias("id"))).distinct()


def topological_levels(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """id, level: the longest path that leads to it, in an acyclic graph; vertices on or after a cycle are missing."""
    left, e, out, level = cut(vertices.select("id")), cut(edges.select("src", "dst").distinct()), None, 0
    while not left.isEmpty():
        free = cut(left.join(e.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").withColumn("level", F.lit(level).cast("long")))
        if free.isEmpty():
            break
        out = free if out is None else out.union(free)
        left = cut(left.join(free, "id", "left_anti"))
        e = cut(e.join(free.select(F.col("id").alias("src")), "src", "left_anti"))
        level += 1
    return out if out is not None else vertices.select("id", F.lit(0).cast("long").alias("level"))


def shortest_paths(edges: DataFrame, vertices: DataFrame, source: int) -> DataFrame:
    """id, dist, parent from one source over non-negative weights; unreachable ones null, ties to the least parent."""
    e = cut(edges.filter("src <> dst").groupBy("src", "dst").agg(F.min("w").alias("w")))
    dist = cut(vertices.select("id", F.when(F.col("id") == source, 0).cast("long").alias("dist")))
    frontier = dist.filter("dist IS NOT NULL")
    while not frontier.isEmpty():
        sent = frontier.join(e, F.col("id") == F.col("src")).groupBy("dst").agg(F.min(F.col("dist") + F.col("w")).alias("sent")).withColumnRenamed("dst", "v")
        new = cut(dist.join(sent, F.col("id") == F.col("v"), "left").select("id", F.least("dist", "sent").alias("dist"), (F.col("sent") < F.coalesce("dist", F.lit((1 << 63) - 1))).alias("fell")))
        dist, frontier = new.select("id", "dist"), new.filter("fell").select("id", "dist")
    a = dist.select(F.col("id").alias("src"), F.col("dist").alias("d"))
    via = e.join(a, "src").join(dist.select(F.col("id").alias("dst"), "dist"), "dst").filter("d + w = dist").groupBy("dst").agg(F.min("src").alias("parent"))
    return dist.join(via.withColumnRenamed("dst", "id"), "id", "left").select("id", "dist", F.when(F.col("id") != source, F.col("parent")).alias("parent"))


def paths_to(paths: DataFrame, targets: DataFrame) -> DataFrame:
    """target, pos, vertex of the path to each of ``targets`` (id), the source left out; pos counts from 1.

    ``paths`` is what :func:`shortest_paths` gives. Parents are followed by doubling: a round finds the vertices twice as
    far back, so rounds grow with the logarithm of the longest path. An unreachable target, and the source, have none.
    """
    jump = cut(paths.filter("parent IS NOT NULL").select("id", F.col("parent").alias("anc")))
    some = targets.select(F.col("id").alias("target")).distinct().join(paths.filter("dist IS NOT NULL").select(F.col("id").alias("target")), "target")
    out, size = cut(some.select("target", F.col("target").alias("vertex"), F.lit(0).cast("long").alias("back"))), 1
    while not jump.isEmpty():
        far = out.join(jump, F.col("vertex") == F.col("id")).select("target", F.col("anc").alias("vertex"), (F.col("back") + size).alias("back"))
        out = cut(out.union(far))
        jump = cut(jump.select(F.col("id").alias("at"), F.col("anc").alias("via")).join(jump, F.col("via") == F.col("id")).select(F.col("at").alias("id"), "anc"))
        size *= 2
    hops = out.groupBy("target").agg(F.max("back").alias("hops"))
    return out.join(hops, "target").filter("back < hops").select("target", (F.col("hops") - F.col("back")).alias("pos"), "vertex")


def spanning_forest(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """src, dst, w of the minimum spanning forest of an undirected graph, ties by (w, src, dst): Borůvka's rounds.

    Each round every component takes its least edge outward and components that met are contracted. Rounds halve them.
    """
    left = cut(edges.filter("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.struct("w", "src", "dst").alias("x")))
    chosen = None
    while True:
        ends = left.select("a", "x").union(left.select("b", "x"))
        picked = cut(ends.groupBy("a").agg(F.min("x").alias("x")).select("x").distinct())
        if picked.isEmpty():
            return chosen if chosen is not None else edges.limit(0).select("src", "dst", "w")
        new = picked.select("x.src", "x.dst", "x.w")
        chosen = new if chosen is None else chosen.union(new)
        # Components that met become one vertex, named by the least; edges within it go.
        met = roots(left.join(picked, "x", "left_semi").select("a", "b"))
        left = left.join(met.toDF("a", "ra"), "a", "left").join(met.toDF("b", "rb"), "b", "left")
        left = cut(left.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"), "x").filter("a <> b"))


def rooted(forest: DataFrame, vertices: DataFrame, root: int) -> DataFrame:
    """id, parent: a forest's edges turned away from a root (parent -1); vertices it doesn't reach have a null."""
    both = cut(forest.select("src", "dst").union(forest.select("dst", "src")))
    found = cut(vertices.filter(F.col("id") == root).select("id", F.lit(-1).cast("long").alias("parent")))
    fresh = found
    while not fresh.isEmpty():
        step = fresh.join(both, F.col("id") == F.col("src")).groupBy("dst").agg(F.min("src").alias("parent")).select(F.col("dst").alias("id"), "parent")
        fresh = cut(step.join(found, "id", "left_anti"))
        found = cut(found.union(fresh))
    return vertices.select("id").join(found, "id", "left")
