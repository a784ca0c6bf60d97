"""Placement of keys on nodes: rendezvous, weighted rendezvous, consistent ring.

The nodes are a configuration, a list on the driver (at most a few thousand); keys are data and never shuffle. The
``md5`` family can be checked by any SQL engine and hashes a key once for every node; the ``xxh64`` family gives the
classic seed-0 values: a key is hashed once and mixed with each node's hash, by numpy over Arrow batches. A null key has
no node (null) in the latter; in the former its scores are null and the first node is taken.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.arrays import bind, count_below
from tessera.functions.hashing import hash60, mixed, signed, xxh64, xxh64_many

UNSIGNED = -(1 << 63)
RING_STEP = 16777619
#: Keys that numpy scores at once.
BATCH = 1 << 16


def _by_batch(key: Column, best, returns: str, names: list[str] | None = None) -> Column:
    """A column of what ``best`` makes of the hashes of the keys (numbers of nodes), by Arrow batches; with ``names``
    those of the nodes. Null keys give nulls."""

    def assign(keys: pd.Series) -> pd.Series:
        out = []
        for k in range(0, len(keys), BATCH):
            part = keys.iloc[k : k + BATCH]
            at = best(xxh64_many(part.fillna("").tolist()))
            values = pd.Series(np.array(names, object)[at]) if names is not None else pd.Series(at.astype(np.int64)).astype("Int64")
            out.append(values.mask(part.isna().to_numpy()))
        return pd.concat(out) if out else pd.Series([], dtype=object if names is not None else "Int64")

    return F.pandas_udf(assign, returns)(key)


def hrw(key: Column, nodes: list[str], family: str = "md5") -> Column:
    """0-based index of the node with the highest score, the lowest of equals; -1 without nodes."""
    if not nodes:
        return F.lit(-1)
    if family == "md5":
        named = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(-k).alias("i")) for k, n in enumerate(nodes)])
        scores = F.transform(named, lambda x: F.struct(hash60(F.concat(key, F.lit("|"), x["n"])).alias("score"), x["i"].alias("i")))
        return -F.array_max(scores)["i"]
    hashes = [np.uint64(xxh64(n.encode())) for n in nodes]

    def best(h: np.ndarray) -> np.ndarray:
        top, at = mixed(h ^ hashes[0]), np.zeros(len(h), np.int64)
        for k, node in enumerate(hashes[1:], 1):
            score = mixed(h ^ node)
            more = score > top
            at[more] = k
            np.maximum(top, score, out=top)
        return at

    return _by_batch(key, best, "long")


def wrh(key: Column, weights: dict[str, float], family: str = "md5") -> Column:
    """The node of least -ln(u)/weight, the least name of equals; nodes without positive weight take no part, and
    without any the result is an empty string."""
    nodes = {n: float(w) for n, w in weights.items() if w and w > 0}
    if not nodes:
        return F.lit("")
    if family == "md5":
        named = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(w).alias("w")) for n, w in nodes.items()])
        u = lambda x: (hash60(F.concat(key, F.lit("|"), x["n"])) + 1).cast("double") / F.lit(float(1 << 60))
        scores = F.transform(named, lambda x: F.struct((-F.ln(u(x)) / x["w"]).alias("score"), x["n"].alias("n")))
        return F.array_min(scores)["n"]
    names = sorted(nodes)
    hashes = [np.uint64(xxh64(n.encode())) for n in names]

    def best(h: np.ndarray) -> np.ndarray:
        least, at = np.full(len(h), np.inf), np.zeros(len(h), np.int64)
        with np.errstate(divide="ignore"):
            for k, node in enumerate(hashes):
                score = -np.log(mixed(h ^ node) / float((1 << 64) - 1)) / nodes[names[k]]
                at[score < least] = k
                np.minimum(least, score, out=least)
        return at

    return _by_batch(key, best, "string", names)


class Ring:
    """A consistent-hash ring of ``replicas`` points a node; adding twice is adding once."""

    def __init__(self, nodes: list[str], replicas: int = 100, family: str = "md5"):
        self.family, self.replicas = family, replicas
        points: dict[int, str] = {}
        for n in sorted(set(nodes)):
            for i in range(replicas):
                points.setdefault(self._point(n, i), n)
        self.points = sorted(points.items())

    def _point(self, node: str, i: int) -> int:
        if self.family == "md5":
            import hashlib

            return int(hashlib.md5(f"{node}#{i}".encode()).hexdigest()[:15], 16)
        x = xxh64(node.encode()) ^ (i * RING_STEP)
        x ^= x >> 12
        x ^= x << 25 & ((1 << 64) - 1)
        x ^= x >> 27
        return signed(x * 2685821657736338717 & ((1 << 64) - 1)) ^ UNSIGNED

    def node(self, key: Column) -> Column:
        """The node of the first point at or after the key's hash, past the last the first's; an empty string if none."""
        if not self.points:
            return F.lit("")
        if self.family == "md5":
            at = bind(hash60(key), lambda v: count_below(v, [p for p, _ in self.points]))
            owners = F.array(*[F.lit(n) for _, n in self.points])
            return F.get(owners, at % len(self.points))
        points = np.array([p ^ UNSIGNED for p, _ in self.points], np.int64).view(np.uint64)
        return _by_batch(key, lambda h: np.searchsorted(points, h) % len(points), "string", [n for _, n in self.points])


def variance(counts) -> Column:
    """Mean squared deviation of nodes' shares from 1/n over nodes with keys; ``counts`` has a row (n) a node.

    An aggregate over exact integers with one division.
    """
    n, total, squares = F.count("*"), F.sum(counts), F.sum(counts * counts)
    return (n * squares - total * total).cast("double") / (n * n * total * total).cast("double")
