"""Cache simulation over logs (cache_id, seq, key[, op, val]); logs of different caches run in parallel.

A read-through LRU cache holds the keys that were asked for last, so its log is split: what it holds where a part begins
follows from the last keys of the parts before. An LFU cache, and one with puts that gets don't store, depend on the whole
past, so there a log is replayed in order in one task and has to fit its memory. Rows of a null cache are one more cache; a
null key is a key.
"""

from __future__ import annotations

from collections import OrderedDict, defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import ranged


class LRU:
    def __init__(self, capacity: int):
        self.capacity, self.held = capacity, OrderedDict()

    def __len__(self) -> int:
        return len(self.held)

    def get(self, key):
        if key not in self.held:
            return None, False
        self.held.move_to_end(key)
        return self.held[key], True

    def put(self, key, value) -> None:
        self.held[key] = value
        self.held.move_to_end(key)
        if len(self.held) > self.capacity:
            self.held.popitem(last=False)


class LFU:
    """The least frequent key goes, of those the least recent; a new key has frequency 1."""

    def __init__(self, capacity: int, default=None):
        self.capacity, self.default = capacity, default
        self.value, self.freq, self.by_freq, self.least = {}, {}, defaultdict(OrderedDict), 0

    def __len__(self) -> int:
        return len(self.value)

    def _touch(self, key) -> None:
        f = self.freq[key]
        del self.by_freq[f][key]
        if not self.by_freq[f] and self.least == f:
            self.least += 1
        self.freq[key] = f + 1
        self.by_freq[f + 1][key] = None

    def get(self, key):
        if key not in self.value:
            return self.default
        self._touch(key)
        return self.value[key]

    def put(self, key, value) -> None:
        if self.capacity <= 0:
            return
        if key in self.value:
            self.value[key] = value
            self._touch(key)
            return
        if len(self.value) >= self.capacity:
            old, _ = self.by_freq[self.least].popitem(last=False)
            del self.value[old], self.freq[old]
        self.value[key], self.freq[key], self.least = value, 1, 1
        self.by_freq[1][key] = None


def _replay(log: DataFrame, policy, capacity: int) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        cache, hits = policy(capacity), []
        for key in pdf["key"].tolist():
            found = cache.get(key)
            hit = found[1] if isinstance(found, tuple) else found is not None
            hits.append(hit)
            if not hit:
                cache.put(key, True)
        return pdf.assign(hit=hits)[["cache_id", "seq", "key", "hit"]]

    kinds = dict(log.dtypes)
    return log.groupBy("cache_id").applyInPandas(run, f"cache_id {kinds['cache_id']}, seq {kinds['seq']}, key {kinds['key']}, hit boolean")


def _held(last: DataFrame, capacity: int) -> DataFrame:
    """cache_id, _range, key, seq: what a cache holds where each part of its log begins, from the last keys of each part;
    no more than ``capacity`` rows a part."""

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        held: OrderedDict = OrderedDict()
        out = []
        for part, rows in pdf.sort_values(["_range", "seq"]).groupby("_range", sort=True):
            out += [(pdf["cache_id"].iloc[0], part, k, s) for k, s in held.items()]
            for k, s in zip(rows["key"].tolist(), rows["seq"].tolist()):
                held.pop(k, None)
                held[k] = s
                if len(held) > capacity:
                    held.popitem(last=False)
        return pd.DataFrame(out, columns=["cache_id", "_range", "key", "seq"])

    kinds = dict(last.dtypes)
    return last.groupBy("cache_id").applyInPandas(scan, f"cache_id {kinds['cache_id']}, _range int, key {kinds['key']}, seq {kinds['seq']}")


def lru_hits(log: DataFrame, capacity: int) -> DataFrame:
    """cache_id, seq, key, hit of read-through requests."""
    rows = ranged(log.select("cache_id", "seq", "key"), F.col("cache_id"), F.col("seq"))
    last = rows.groupBy("cache_id", "_range", "key").agg(F.max("seq").alias("seq"))
    late = F.row_number().over(Window.partitionBy("cache_id", "_range").orderBy(F.desc("seq")))
    last = last.withColumn("late", late).filter(F.col("late") <= capacity).drop("late")
    held = _held(last, capacity)

    def run(asked: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        cache, hits = LRU(capacity), []
        for key in before.sort_values("seq")["key"].tolist():
            cache.put(key, True)
        asked = asked.sort_values("seq")
        for key in asked["key"].tolist():
            hit = cache.get(key)[1]
            hits.append(hit)
            if not hit:
                cache.put(key, True)
        return asked.assign(hit=pd.Series(hits, index=asked.index, dtype=bool))[["cache_id", "seq", "key", "hit"]]

    kinds = dict(log.dtypes)
    schema = f"cache_id {kinds['cache_id']}, seq {kinds['seq']}, key {kinds['key']}, hit boolean"
    return rows.groupBy("cache_id", "_range").cogroup(held.groupBy("cache_id", "_range")).applyInPandas(run, schema)


def lfu_hits(log: DataFrame, capacity: int) -> DataFrame:
    """cache_id, seq, key, hit of read-through requests."""
    return _replay(log.select("cache_id", "seq", "key"), LFU, capacity)


def replay(log: DataFrame, policy, capacity: int) -> DataFrame:
    """cache_id, seq, val, hit, size of the gets in a log (cache_id, seq, op, key, val) of gets and puts; a get that misses
    stores nothing and gives a null; ``size`` is how many keys the cache holds then."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cache, rows = policy(capacity), []
        for r in pdf.sort_values("seq").itertuples(index=False):
            if r.op == "put":
                cache.put(r.key, r.val)
            else:
                found = cache.get(r.key)
                val, hit = found if isinstance(found, tuple) else (found, found is not None)
                rows.append((r.cache_id, r.seq, val, hit, len(cache)))
        return pd.DataFrame(rows, columns=["cache_id", "seq", "val", "hit", "size"]).astype({"val": "Int64", "hit": bool})

    kinds = dict(log.dtypes)
    return log.groupBy("cache_id").applyInPandas(run, f"cache_id {kinds['cache_id']}, seq {kinds['seq']}, val long, hit boolean, size long")
