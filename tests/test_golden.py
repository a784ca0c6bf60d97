"""Known cases of the operators, and properties against plain Python."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import hashing
from tessera.functions.arrays import count_below, occurrences, running_sums
from tessera.operators import bloom, caches, counting, graphs, intervals, lookup, ordering, placement, ranges, sequences, text, trees


def edges(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, w long" if rows and len(rows[0]) == 3 else "src long, dst long")


def ids(spark, n):
    return spark.range(n).select("id")


def spans(spark, rows):
    return spark.createDataFrame([("g", *r) for r in rows], "grp string, s long, e long")


def listed(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_interval_merge(spark):
    cases = {
        ((1, 3), (4, 6), (7, 9)): [(1, 3), (4, 6), (7, 9)], ((1, 3), (2, 6), (8, 10)): [(1, 6), (8, 10)],
        ((1, 10), (2, 6), (4, 8)): [(1, 10)], (): [], ((1, 5),): [(1, 5)], ((-5, -2), (-4, 0), (-3, -1)): [(-5, 0)],
    }
    for given_, want in cases.items():
        assert listed(intervals.merge(spans(spark, list(given_))), "s", "e") == want


def test_interval_merge_of_one_long_group(spark):
    rng = random.Random(23)
    rows = [("g", s, s + rng.choice([0, 1, 5, 40, 2000])) for s in (rng.randrange(300_000) for _ in range(4000))] + [("h", 5, 6), (None, 1, 2), (None, 2, 3), ("h", None, 3), ("h", 9, 8)]
    want = [(None, 1, 3), ("h", 5, 6)]
    for g, s, e in sorted(r for r in rows if r[0] == "g"):
        if want[-1][0] == "g" and s <= want[-1][2]:
            want[-1] = ("g", want[-1][1], max(e, want[-1][2]))
        else:
            want.append(("g", s, e))
    got = intervals.merge(spark.createDataFrame(rows, "grp string, s long, e long"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_interval_insert(spark):
    old = [(1, 3), (5, 7), (9, 11)]
    for new, want in {(4, 8): [(1, 3), (4, 8), (9, 11)], (4, 10): [(1, 3), (4, 11)], (6, 7): old, (4, 12): [(1, 3), (4, 12)], (4, 5): [(1, 3), (4, 7), (9, 11)]}.items():
        assert listed(intervals.insert(spans(spark, old), spans(spark, [new])), "s", "e") == want


def test_interval_intersect(spark):
    got = intervals.intersect(spans(spark, [(1, 3), (5, 9)]), spans(spark, [(2, 6), (8, 10)]))
    assert listed(got, "s", "e") == [(2, 3), (5, 6), (8, 9)]


def test_multiset(spark):
    log = spark.createDataFrame([(k, 1) for k in (1, 2, 3, 1)] + [(1, -1), (1, -1)], "key long, delta int")
    assert listed(counting.multiset_net(log), "key", "cnt") == [(2, 1), (3, 1)]


def test_removal_of_an_absent_key(spark):
    log = spark.createDataFrame([(1, 1), (2, -1), (None, 1)], "key long, delta int")
    assert sorted(map(tuple, counting.multiset_net(log).collect()), key=repr) == sorted([(1, 1), (None, 1)], key=repr)
    with pytest.raises(Exception, match="absent key"):
        counting.multiset_net(log, strict=True).collect()


def test_majority(spark):
    df = spark.createDataFrame([("g", x) for x in (1, 1, 1, 2, 2, 3, 3, 2, 2, 2, 3, 2, 2)], "g string, v long")
    assert listed(counting.majority(df, "g", "v"), "candidate", "n", "is_majority") == [(2, 13, True)]


def test_graph_cases(spark):
    ring, line = edges(spark, [(0, 1), (1, 2), (2, 0)]), edges(spark, [(0, 1), (1, 2)])
    assert listed(graphs.has_cycle(ring), "has_cycle") == [(True,)]
    assert listed(graphs.has_cycle(line), "has_cycle") == [(False,)]
    assert listed(graphs.cycle_vertices(ring, ids(spark, 3)), "id") == [(0,), (1,), (2,)]
    e = edges(spark, [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1), (3, 4), (4, 5), (5, 3), (6, 6), (6, 7), (7, 6)])
    assert listed(graphs.scc(e, ids(spark, 9)), "id", "comp") == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 3), (6, 6), (7, 6), (8, 8)]
    assert listed(graphs.topological_levels(line, ids(spark, 4)), "id", "level") == [(0, 0), (1, 1), (2, 2), (3, 0)]


def test_shortest_path(spark):
    e = edges(spark, [(0, 1, 7), (0, 2, 1), (1, 2, 5), (1, 3, 2), (2, 3, 7), (4, 0, 8), (4, 2, 2)])
    paths = graphs.shortest_paths(e, ids(spark, 5), 0).cache()
    assert listed(paths.filter("id < 4"), "id", "dist") == [(0, 0), (1, 7), (2, 1), (3, 8)]
    assert paths.filter("id = 4").first()["dist"] is None
    assert listed(graphs.paths_to(paths, ids(spark, 5)), "target", "pos", "vertex") == [(1, 1, 1), (2, 1, 2), (3, 1, 2), (3, 2, 3)]


def test_long_paths_and_forests(spark):
    """A path of 300 vertices: rounds are few, the path is whole; random graphs against plain loops."""
    rng = random.Random(9)
    line = [(k, k + 1, 1) for k in range(300)]
    paths = graphs.shortest_paths(edges(spark, line[:40]), ids(spark, 41), 0).cache()
    assert listed(graphs.paths_to(paths, ids(spark, 41).filter("id = 40")), "pos", "vertex") == [(k, k) for k in range(1, 41)]
    assert {r["comp"] for r in graphs.components(edges(spark, line), ids(spark, 301)).collect()} == {0}
    rows = [(rng.randrange(60), rng.randrange(60), rng.randrange(9)) for _ in range(90)]
    parent, want = list(range(60)), []

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, w in sorted(set(rows), key=lambda r: (r[2], r[0], r[1])):
        if top(a) != top(b):
            parent[max(top(a), top(b))] = min(top(a), top(b))
            want.append((a, b, w))
    assert listed(graphs.spanning_forest(edges(spark, rows), ids(spark, 60)), "src", "dst", "w") == sorted(want)
    assert listed(graphs.components(edges(spark, rows), ids(spark, 60)), "id", "comp") == [(k, top(k)) for k in range(60)]


def test_spanning_forest(spark):
    for rows, n, want in (
        ([(0, 1, 5), (1, 2, 3), (2, 0, 1)], 3, [(1, 2, 3), (2, 0, 1)]), ([(0, 1, 5)], 2, [(0, 1, 5)]),
        ([(0, 1, 5), (2, 3, 2)], 4, [(0, 1, 5), (2, 3, 2)]), ([(0, 1, 5), (0, 2, 6), (1, 2, 3)], 3, [(0, 1, 5), (1, 2, 3)]),
    ):
        forest = graphs.spanning_forest(edges(spark, rows), ids(spark, n))
        assert listed(forest, "src", "dst", "w") == sorted(want)
    tree = graphs.rooted(edges(spark, [(0, 1, 2), (0, 2, 3)]), ids(spark, 3), 0)
    assert listed(tree, "id", "parent") == [(0, -1), (1, 0), (2, 0)]
    assert spark.createDataFrame([], "src long, dst long, w long").transform(lambda e: graphs.spanning_forest(e, ids(spark, 2))).count() == 0


def test_placement_values(spark):
    keys = spark.createDataFrame([("first",), ("second",), ("third",), ("1",)], "key string")
    got = keys.select("key", placement.hrw(F.col("key"), ["A", "B", "C"], "xxh64").alias("n")).collect()
    assert [r["n"] for r in got[:3]] == [1, 1, 0]
    got = keys.select("key", placement.wrh(F.col("key"), {"A": 10.0, "B": 30.0, "C": 0.0}, "xxh64").alias("n")).collect()
    assert [r["n"] for r in got] == ["B", "B", "B", "A"]
    ring = placement.Ring(["node1", "node2", "node3"], 3, "xxh64")
    assert {r["n"] for r in keys.select(ring.node(F.col("key")).alias("n")).collect()} <= {"node1", "node2", "node3"}


def test_placement_shares(spark):
    keys = spark.range(100_000).select(F.col("id").cast("string").alias("key"))
    shares = lambda c: {r[0]: r[1] / 100_000 for r in keys.groupBy(c.alias("n")).count().collect()}
    assert all(abs(x - 1 / 3) < 0.01 for x in shares(placement.hrw(F.col("key"), ["A", "B", "C"])).values())
    got = shares(placement.wrh(F.col("key"), {"A": 10.0, "B": 30.0, "C": 0.0}))
    assert abs(got["A"] - 0.25) < 0.01 and abs(got["B"] - 0.75) < 0.01 and "C" not in got
    assert all(abs(x - 1 / 3) < 0.1 for x in shares(placement.Ring(["A", "B", "C"]).node(F.col("key"))).values())


def test_multiply64(spark):
    rng = random.Random(5)
    xs = [rng.getrandbits(64) for _ in range(200)]
    df = spark.createDataFrame([(hashing.signed(x),) for x in xs], "x long").select(hashing.xorshift_multiply(F.col("x")).alias("y"))

    def mixed(x):
        x ^= x >> 12
        x ^= x << 25 & hashing.MASK
        x ^= x >> 27
        return hashing.signed(x * 2685821657736338717 & hashing.MASK)

    assert [r["y"] for r in df.collect()] == [mixed(x) for x in xs]


def test_caches():
    lru = caches.LRU(2)
    for k in (1, 2, 3):
        lru.put(k, k)
    assert lru.get(1) == (None, False) and lru.get(2) == (2, True) and lru.get(3) == (3, True)
    lfu = caches.LFU(2, -1)
    lfu.put(1, 1)
    lfu.get(1)
    lfu.put(2, 2)
    lfu.get(1), lfu.get(2)
    lfu.put(3, 3)
    assert (lfu.get(3), lfu.get(2), lfu.get(1)) == (3, -1, 1)


def test_bounds_and_ranges(spark):
    e = spark.createDataFrame([(x,) for x in (1, 7, 23, 56, 67)], "v long")
    q = spark.createDataFrame([(23,), (17,), (99,)], "v long")
    assert listed(lookup.value_bounds(e, q), "v", "lower", "upper", "found") == [(17, 2, 2, -1), (23, 2, 3, 2), (99, 5, 5, -1)]
    s = spark.createDataFrame([("g", i, x) for i, x in enumerate((0, 1, 3, 4, 5, 6, 7))], "grp string, pos long, val long")
    asked = spark.createDataFrame([("g", 0, 1), ("g", 0, 3), ("g", 2, 3), ("g", 3, 5), ("g", 2, 2)], "grp string, l long, r long")
    want = [(0, 1, 1), (0, 3, 4), (2, 2, 3), (2, 3, 4), (3, 5, 6)]
    assert listed(ranges.sparse_query(ranges.sparse_table(s), asked), "l", "r", "res") == want
    assert listed(ranges.range_fold(s, asked, F.max), "l", "r", "res") == want
    assert listed(ranges.range_fold(s, asked, F.min), "l", "r", "res") == [(0, 1, 0), (0, 3, 0), (2, 2, 3), (2, 3, 3), (3, 5, 4)]
    assert listed(ordering.is_sorted(s), "sorted") == [(True,)]


def test_text_cases(spark):
    pairs = [("", "", 0), ("a", "", 1), ("a", "b", 1), ("abc", "abd", 1), ("abc", "abc", 0), ("kitten", "sitting", 3), ("héllo", "hello", 2)]
    df = spark.createDataFrame(pairs, "a string, b string, want int")
    rows = df.select("want", text.edit_distance(F.col("a"), F.col("b")).alias("d"), text.weighted_edit_distance(F.col("a"), F.col("b")).alias("w"), text.edit_distance(F.col("a"), F.col("b"), "char").alias("c")).collect()
    assert all(r["d"] == r["want"] and r["w"] == r["c"] for r in rows)
    one = spark.createDataFrame([("abcd",), ("abc",), ("",), ("hello world",)], "t string")
    assert listed(text.find_patterns(one, "t", ["a", "ab", "abc", "abcd"]).filter("t = 'abcd'"), "pos", "pid") == [(0, 0), (0, 1), (0, 2), (0, 3)]
    assert listed(text.find_patterns(one, "t", ["ello", "worl", "world", "hekko"]), "pos", "pid") == [(1, 0), (6, 1), (6, 2)]
    rep = spark.createDataFrame([("ab" * 10,), ("ab" * 10 + "a",), ("",)], "t string")
    assert [r[0] for r in rep.select(text.repeated_pattern(F.col("t"))).collect()] == ["ab", "", ""]
    assert [r["pos"] for r in text.find_all(rep.limit(1), "t", "ababab").collect()] == [5, 7, 9, 11, 13, 15, 17, 19]
    assert text.prefix_function("ababab") == [0, 0, 1, 2, 3, 4]
    found = spark.createDataFrame([("こんにちは、世界",)], "t string").select(text.find_first(F.col("t"), "こんにちは").alias("a"), text.find_first(F.col("t"), "").alias("b"), text.find_first(F.col("t"), "xyz").alias("c")).first()
    assert tuple(found) == (0, -1, -1)


def test_sequences(spark):
    assert sequences.lcs([1, 3, 2, 7, 0], [0, 1, 3, 4, 5, 6, 7]) == [1, 3, 7]
    assert len(sequences.lis([1, 3, 2, 7, 0])) == 3 and sequences.lis([]) == []
    df = spark.createDataFrame([([1, 2, 1, 2], [1, 2]), ([1, 3, 2, 7, 0], [0, 1, 3, 4, 5, 6, 7]), ([], [1])], "a array<long>, b array<long>")
    assert [r[0] for r in df.select(sequences.lcs_length(F.col("a"), F.col("b"))).collect()] == [2, 3, 0]
    assert [r[0] for r in df.select(sequences.lis_length(F.col("a"), "long")).collect()] == [2, 3, 0]


def test_trees(spark):
    keys = [6, 2, 8, 0, 4, 7, 9, -1, -1, 3, 5]
    nodes = spark.createDataFrame([(i, k) for i, k in enumerate(keys) if k >= 0], "at long, key long")
    tree = trees.from_level_order(nodes, "at", "key")
    got = trees.lca(tree, spark.createDataFrame([(9, 10), (4, 1), (3, 6)], "u long, v long"))
    assert listed(got, "u", "v", "lca") == [(3, 6, 0), (4, 1, 1), (9, 10, 4)]


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(500).withColumnRenamed("id", "k")
    built = bloom.build(keys, "k", 4096, 4)
    assert bloom.might_contain(keys, "k", built, 4096, 4).count() == 500


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(-50, 50), max_size=40))
def test_lis_is_longest(values):
    best = []
    for i, x in enumerate(values):
        best.append(1 + max((b for b, y in zip(best, values[:i]) if y < x), default=0))
    got = sequences.lis(values)
    assert len(got) == max(best, default=0) and all(a < b for a, b in zip(got, got[1:]))


def test_array_helpers(spark):
    rng = random.Random(2)
    lists = [[rng.randrange(9) for _ in range(n)] for n in (0, 1, 5, 255, 256, 257, 1000)]
    df = spark.createDataFrame([(x,) for x in lists], "x array<int>")
    sums = [r[0] for r in df.select(running_sums(F.col("x"))).collect()]
    assert sums == [[sum(x[: k + 1]) for k in range(len(x))] for x in lists]
    ordered = sorted(rng.sample(range(1000), 77))
    vals = spark.createDataFrame([(v,) for v in range(-5, 1005, 7)], "v int")
    assert all(r["c"] == sum(o < r["v"] for o in ordered) for r in vals.select("v", count_below(F.col("v"), ordered).alias("c")).collect())
    texts = ["", "aaa", "xaaaay", "a.b.a.b", "\\Eaa"]
    for p in ("aa", ".b", "\\E"):
        got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(occurrences(F.col("t"), p)).collect()]
        assert got == [[k for k in range(len(t)) if t.startswith(p, k)] for t in texts]


def test_replay_and_lists(spark):
    ops = [("c", k, *x) for k, x in enumerate([("put", 1, 10), ("get", 1, None), ("put", 2, 20), ("get", 1, None), ("get", 2, None), ("put", 3, 30), ("get", 3, None), ("get", 2, None), ("get", 1, None)])]
    log = spark.createDataFrame(ops, "cache_id string, seq long, op string, key long, val long")
    assert listed(caches.replay(log, caches.LFU, 2).filter("seq > 5"), "seq", "val") == [(6, 30), (7, None), (8, 10)]
    assert listed(caches.replay(log, caches.LRU, 2).filter("seq > 5"), "seq", "hit") == [(6, True), (7, True), (8, False)]
    s = spark.createDataFrame([("g", k, v) for k, v in enumerate((5, 6, 7))], "grp string, pos long, val long")
    more = lookup.insert_after(s, spark.createDataFrame([("g", -1, 4), ("g", 1, 9)], "grp string, pos long, val long"))
    assert [r[1] for r in listed(more, "pos", "val")] == [4, 5, 6, 9, 7]
    assert [r[1] for r in listed(lookup.remove_after(more, spark.createDataFrame([("g", 2)], "grp string, pos long")), "pos", "val")] == [4, 5, 6, 7]
    assert lookup.partition_point(s, F.col("val") < 7).first()["at"] == 2
    nums = spark.createDataFrame([([4, 6, 10],), ([7],), ([2**62, 3],)], "x array<long>")
    assert [tuple(r) for r in nums.select(ranges.gcd(F.col("x")), ranges.lcm(F.col("x"))).collect()] == [(2, 60), (7, 7), (1, None)]


def test_dictionary(spark):
    log = spark.createDataFrame([("hello", 1, "add"), ("help", 2, "add"), ("hello", 3, "delete")], "word string, seq long, op string")
    words = text.dictionary(log)
    got = text.prefix_search(words, spark.createDataFrame([("hel",), ("help",), ("hello",)], "prefix string"))
    assert listed(got, "prefix", "n_words", "has_word") == [("hel", 1, False), ("hello", 0, False), ("help", 1, True)]


def test_placement_of_the_classic_family_against_plain_numbers(spark):
    mask = (1 << 64) - 1

    def mix(x):
        x ^= x >> 12
        x ^= (x << 25) & mask
        x ^= x >> 27
        return x * 2685821657736338717 & mask

    nodes = [f"node{k}" for k in range(13)]
    words = ["", "a", "é😀", "x" * 31, "y" * 32, "z" * 100] + [str(k) for k in range(300)]
    keys = spark.createDataFrame([(w,) for w in words] + [(None,)], "key string")
    of = {n: hashing.xxh64(n.encode()) for n in nodes}
    weights = {n: float(k % 5) for k, n in enumerate(nodes)}
    ring = placement.Ring(nodes, 20, "xxh64")
    got = {r["key"]: r for r in keys.select("key", placement.hrw(F.col("key"), nodes, "xxh64").alias("a"), placement.wrh(F.col("key"), weights, "xxh64").alias("b"), ring.node(F.col("key")).alias("c")).collect()}
    assert (got[None]["a"], got[None]["b"], got[None]["c"]) == (None, None, None)
    points = sorted((mix(of[n] ^ (i * placement.RING_STEP)), n) for n in nodes for i in range(20))
    for w in words:
        h = hashing.xxh64(w.encode())
        assert got[w]["a"] == max(range(13), key=lambda k: (mix(h ^ of[nodes[k]]), -k))
        assert got[w]["b"] == min((n for n in nodes if weights[n]), key=lambda n: (-math.log(mix(h ^ of[n]) / float(mask)) / weights[n], n))
        assert got[w]["c"] == next((n for p, n in points if p >= h), points[0][1])


def test_shares_of_a_million_keys(spark):
    keys = spark.range(1_000_000).select(F.col("id").cast("string").alias("key"))
    share = lambda c: {r[0]: r["count"] / 1e6 for r in keys.groupBy(c.alias("n")).count().collect()}
    assert all(abs(x - 1 / 3) < 0.002 for x in share(placement.hrw(F.col("key"), ["A", "B", "C"], "xxh64")).values())
    got = share(placement.wrh(F.col("key"), {"A": 10.0, "B": 30.0, "C": 0.0}, "xxh64"))
    assert abs(got["A"] - 0.25) < 0.002 and "C" not in got
    got = share(placement.Ring([f"n{k}" for k in range(100)], 1000, "xxh64").node(F.col("key")))
    assert len(got) == 100 and all(abs(x - 0.01) < 0.003 for x in got.values())


def plain_cache(kind, capacity, ops):
    """A cache as a list searched whole each time: (when used last, how often used, key, value)."""
    held, out = [], []
    for t, (op, key, val) in enumerate(ops):
        at = next((x for x in held if x[2] == key), None)
        if op == "put" and at is None:
            if len(held) == capacity:
                held.remove(min(held, key=lambda x: (x[1], x[0]) if kind == "lfu" else x[0]))
            held.append([t, 1, key, val])
        elif at is not None:
            at[0], at[1], at[3] = t, at[1] + 1, val if op == "put" else at[3]
        if op == "get":
            out.append((t, at[3] if at else None, at is not None, len(held)))
    return out


def test_caches_against_plain_lists(spark):
    rng = random.Random(12)
    for kind, policy in (("lru", caches.LRU), ("lfu", caches.LFU)):
        logs = {c: [("put" if rng.random() < 0.4 else "get", rng.randrange(12), rng.randrange(1000)) for _ in range(600)] for c in "ab"}
        rows = [(c, t, *x) for c, ops in logs.items() for t, x in enumerate(ops)]
        got = caches.replay(spark.createDataFrame(rows, "cache_id string, seq long, op string, key long, val long"), policy, 5)
        for c, ops in logs.items():
            assert listed(got.filter(F.col("cache_id") == c), "seq", "val", "hit", "size") == plain_cache(kind, 5, ops)
        asked = [(c, t, x[1]) for c, ops in logs.items() for t, x in enumerate(ops)]
        hits = {"lru": caches.lru_hits, "lfu": caches.lfu_hits}[kind](spark.createDataFrame(asked, "cache_id string, seq long, key long").repartition(3), 5)
        for c, ops in logs.items():
            plain = {t: hit for t, _, hit, _ in plain_cache(kind, 5, [y for _, k, _ in ops for y in (("get", k, None), ("put", k, 1))][: 2 * len(ops)])} if kind == "lfu" else None
            if plain is None:
                held, want = [], []
                for t, (_, k, _) in enumerate(ops):
                    want.append((t, k, k in held))
                    held = [x for x in held if x != k][-4:] + [k]
                assert listed(hits.filter(F.col("cache_id") == c), "seq", "key", "hit") == want
    assert caches.lru_hits(spark.createDataFrame([], "cache_id string, seq long, key long"), 5).count() == 0


def test_overlaps_of_any_length(spark):
    rng = random.Random(13)
    rows = []
    for k in range(300):
        s = rng.randrange(-10**9, 10**9) if k % 3 else rng.randrange(-50, 50)
        rows.append((rng.choice("gh"), s, s + rng.choice([0, 1, 3, 15, 63, 10**5, 3 * 10**8]), k))
    rows.append(("g", -(1 << 61), 1 << 61, 1000))
    df = spark.createDataFrame([*rows, (None, 1, 2, 2000), ("g", None, 2, 2001)], "grp string, s long, e long, id long")
    want = sorted((g, t, min(e, f)) for g, s, e, i in rows for h, t, f, j in rows if g == h and t <= e and s <= f and (s, i) < (t, j))
    assert listed(intervals.self_overlap(df), "grp", "s", "e") == want
    assert all(len(r["c"]) <= 2 for r in intervals._cells(df.filter("e < 1L << 60"), "_a").groupBy("id_a").agg(F.collect_list("cell").alias("c")).collect())


def test_ranges_of_long_series(spark):
    """Thousands of places in one group, several steps of the segment tree; folds with and without an inverse."""
    rng = random.Random(14)
    values = [rng.randrange(1, 10**6) for _ in range(5000)]
    s = spark.createDataFrame([("g", k, v) for k, v in enumerate(values)] + [("h", 0, 7)], "grp string, pos long, val long")
    asked = [("g", *sorted(rng.sample(range(5000), 2))) for _ in range(60)] + [("g", 0, 4999), ("g", 17, 17), ("h", 0, 0), ("h", 1, 0)]
    q = spark.createDataFrame(asked, "grp string, l long, r long")
    of = lambda g, l, r: values[l : r + 1] if g == "g" else [7][l : r + 1]
    for fold, plain in ((F.min, min), (F.sum, sum), (F.bit_xor, lambda xs: __import__("functools").reduce(lambda a, b: a ^ b, xs)), (lambda c: ranges.gcd(F.collect_list(c)), lambda xs: math.gcd(*xs))):
        assert listed(ranges.range_fold(s, q, fold), "grp", "l", "r", "res") == sorted((g, l, r, plain(of(g, l, r))) for g, l, r in set(asked) if l <= r)


def test_few_places_make_no_tree(spark, monkeypatch):
    monkeypatch.setattr(ranges, "segment_tree", lambda *_: pytest.fail("a tree for ranges that are short in all"))
    rng = random.Random(23)
    values = [rng.randint(1, 50) for _ in range(1500)]
    rows = [("g", k, v) for k, v in enumerate(values)] + [("big", k, v) for k, v in enumerate([2**62, 3, 5])] + [("h", 0, 2**55 + 1), ("h", 1, 1)]
    s = spark.createDataFrame(rows, "grp string, pos long, val long")
    asked = [("g", 3, 9), ("g", 250, 262), ("g", 0, 1499), ("g", 255, 256), ("g", 5, 4), ("big", 0, 2), ("h", 0, 1), ("none", 0, 3)]
    q = spark.createDataFrame(asked, "grp string, l long, r long")
    sums = {("g", l, r): sum(values[l : r + 1]) for g, l, r in asked if g == "g" and l <= r} | {("big", 0, 2): 2**62 + 8, ("h", 0, 1): 2**55 + 2}
    assert {(x["grp"], x["l"], x["r"]): x["res"] for x in ranges.range_fold(s, q, F.sum).collect()} == sums
    within = lambda n: n if n < 2**63 else ranges.PAST
    lcms = {k: within(math.lcm(*values[k[1] : k[2] + 1])) for k in sums if k[0] == "g"} | {("big", 0, 2): ranges.PAST, ("h", 0, 1): 2**55 + 1}
    assert {(x["grp"], x["l"], x["r"]): x["res"] for x in ranges.range_fold(s, q, ranges.lcm_fold).collect()} == lcms


def test_one_group_in_many_ranges(spark):
    rng = random.Random(22)
    values = [rng.choice([None, *range(-50, 50)]) for _ in range(3000)]
    rows = [("g", k, v) for k, v in enumerate(values)] + [("a", 0, 1), ("z", 0, None), (None, 0, 4), (None, 1, 5)]
    s = spark.createDataFrame(rows, "grp string, pos long, val long")
    got = {(r["grp"], r["pos"]): r["acc"] for r in ranges.prefix(s).collect()}
    least = {(r["grp"], r["pos"]): r["acc"] for r in ranges.prefix(s, F.min, F.least).collect()}
    for k in range(3000):
        seen = [v for v in values[: k + 1] if v is not None]
        assert got["g", k] == (sum(seen) if seen else None) and least["g", k] == (min(seen) if seen else None)
    assert got[None, 1] == 9 and got["z", 0] is None
    asked = [("g", rng.randrange(-10, 3100), k) for k in range(300)] + [("b", 1, 1000)]
    right = s.select("grp", F.col("pos").alias("t"), "val")
    found = {r["id"]: r["val"] for r in lookup.asof_backward(spark.createDataFrame(asked, "grp string, t long, id long"), right).collect()}
    for g, t, k in asked:
        seen = [v for v in values[: max(0, t + 1)] if v is not None] if g == "g" else []
        assert found[k] == (seen[-1] if seen else None)


def test_search_tree_lca_without_pairs(spark):
    rng = random.Random(15)
    keys = rng.sample(range(1000), 200)
    root = None

    def insert(node, key, depth):
        if node is None:
            return [key, depth, None, None]
        side = 2 if key < node[0] else 3
        node[side] = insert(node[side], key, depth + 1)
        return node

    for k in keys:
        root = insert(root, k, 0)
    flat, todo = [], [root]
    while todo:
        node = todo.pop()
        if node:
            flat.append((node[0], node[1]))
            todo += node[2:]
    asked = [(rng.choice(keys), rng.choice(keys)) for _ in range(100)]

    def lca(u, v):
        node = root
        while not min(u, v) <= node[0] <= max(u, v):
            node = node[2] if max(u, v) < node[0] else node[3]
        return node[0]

    got = trees.search_tree_lca(spark.createDataFrame(flat, "key long, depth long"), spark.createDataFrame(asked, "u long, v long"))
    assert listed(got, "u", "v", "lca") == sorted({(u, v, lca(u, v)) for u, v in asked})
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


def test_stack_against_a_list(spark):
    rng = random.Random(16)
    log = [(g, t, rng.choice([1, 1, -1]), rng.randrange(99)) for g in "ab" for t in range(200)] + [("c", 0, -1, 5)]
    want = []
    for g in "abc":
        held = []
        for _, t, delta, val in [r for r in log if r[0] == g]:
            popped = held.pop() if delta < 0 and held else None
            if delta > 0:
                held.append(val)
            want.append((g, t, popped, held[-1] if held else None))
    got = lookup.stack_values(spark.createDataFrame(log, "grp string, seq long, delta int, val long"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_prefixes_longer_than_words_and_empty_ones(spark):
    words = spark.createDataFrame([("hello",), ("help",), ("",), (None,)], "word string")
    got = text.prefix_search(words, spark.createDataFrame([("",), ("hell",), ("hello!",), (None,)], "prefix string"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([("", 2, False), ("hell", 1, False), ("hello!", 0, False), (None, 0, False)], key=repr)


def test_subsequences_as_columns(spark):
    df = spark.createDataFrame([([1, 3, 2, 7, 0], [0, 1, 3, 4, 5, 6, 7]), ([1, 2, 1, 2], [1, 2]), ([], [1]), (None, [1])], "a array<long>, b array<long>")
    got = df.select(sequences.lcs_column(F.col("a"), F.col("b"), "bigint").alias("x"), sequences.lis_column(F.col("a"), "bigint").alias("y")).collect()
    assert [r["x"] for r in got] == [[1, 3, 7], [1, 2], [], None] and [len(r["y"]) for r in got[:3]] == [3, 2, 0] and got[3]["y"] is None


def test_nulls_in_any_column(spark):
    """Null keys are a key, null values are skipped as SQL aggregates skip them, and nothing fails."""
    s = spark.createDataFrame([("g", 0, None), ("g", 1, 5), (None, 0, 1), (None, 1, None)], "grp string, pos long, val long")
    assert sorted(map(tuple, ordering.is_sorted(s).collect()), key=repr) == sorted([("g", True), (None, True)], key=repr)
    assert [r["acc"] for r in ranges.prefix(s.filter("grp = 'g'")).orderBy("pos").collect()] == [None, 5]
    assert sorted(map(tuple, counting.multiset(s, "val").collect()), key=repr) == sorted([(None, 2), (5, 1), (1, 1)], key=repr)
    ranked = ordering.ranked(s, F.col("val"), ["pos", "grp"]).select("rank", "val").collect()
    assert [r["val"] for r in sorted(ranked, key=lambda r: r["rank"])] == [None, None, 1, 5]
    e = edges(spark, [(0, 1), (None, 1), (2, None)])
    assert listed(graphs.components(e, ids(spark, 3)), "id", "comp") == [(0, 0), (1, 0), (2, 2)]
    assert lookup.asof_backward(s.select("grp", F.col("pos").alias("t"), F.lit(1).alias("id")), s.select("grp", F.col("pos").alias("t"), "val")).count() == 4
    t = spark.createDataFrame([(None,), ("abab",)], "s string")
    assert [tuple(r) for r in t.select(text.find_count(F.col("s"), "ab"), text.find_first(F.col("s"), "ab")).collect()] == [(0, None), (2, 0)]


def test_automaton_against_every_place():
    rng = random.Random(21)
    from tessera.functions import automaton

    for native in (None, automaton.native):
        automaton.native = native
        for _ in range(30):
            patterns = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 5))): k for k in range(12)}
            body = "".join(rng.choice("abé😀") for _ in range(200))
            want = sorted((i + len(p) - 1, -len(p), k) for p, k in patterns.items() for i in range(len(body)) if body.startswith(p, i))
            assert [(e, -n, k) for e, k, n in automaton.Automaton(patterns).matches(body)] == want
        assert list(automaton.Automaton({}).matches("abc")) == list(automaton.Automaton({"": 1}).matches("abc")) == []


def test_thousands_of_patterns(spark):
    patterns = [f"w{k}" for k in range(5000)]
    df = spark.createDataFrame([(1, "w12 w4999"), (2, None), (3, "")], "id long, t string")
    assert listed(text.find_patterns(df, "t", patterns), "id", "pos", "pid") == [(1, 0, 1), (1, 0, 12), (1, 4, 4), (1, 4, 49), (1, 4, 499), (1, 4, 4999)]


def test_tables_of_a_step_go_when_it_ends(spark):
    import os

    from tessera.functions import lineage

    folder = lineage.shared_dir(spark).removeprefix("file:")
    names = lambda: {n.split("-")[0] for n in os.listdir(folder) if n.split("-")[0] in ("inner", "outer", "left")}
    with lineage.scratch(spark):
        outer = lineage.written(spark.range(5), "outer")
        with lineage.scratch(spark):
            inner = lineage.written(outer.filter("id > 1"), "inner")
            left = lineage.kept(inner.filter("id > 2"), "left")
        assert names() == {"outer", "left"} and left.count() == 2
        whole = lineage.kept(left.union(outer), "left")
    assert names() == {"left"} and whole.count() == 7
    with pytest.raises(ZeroDivisionError):
        with lineage.scratch(spark):
            lineage.written(spark.range(1), "inner")
            raise ZeroDivisionError
    assert names() == {"left"} and not lineage._scratches()
