"""Bloom filters as tables of set bits. Null keys set none and are never found; a filter of no keys holds nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.hashing import hash60


def bits_for(keys: int, each: int = 16) -> int:
    """The bits of a filter: the least power of two with ``each`` or more a key."""
    return 1 << max(each * max(keys, 1) - 1, 1).bit_length()


def positions(key: Column, bits: int, hashes: int) -> Column:
    """The places of a key, one of each hash."""
    text = key.cast("string")
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(hash60(F.concat(i.cast("string"), F.lit(":"), text)), F.lit(bits)))


def build(keys: DataFrame, key: str, bits: int, hashes: int) -> DataFrame:
    """bit: the places that are set."""
    return keys.select(F.explode(positions(F.col(key), bits, hashes)).alias("bit")).distinct()


def might_contain(keys: DataFrame, key: str, filter_: DataFrame, bits: int, hashes: int) -> DataFrame:
    """The distinct keys all of whose places are set: no false negatives."""
    asked = keys.select(key).distinct().withColumn("bit", F.explode(positions(F.col(key), bits, hashes)))
    met = asked.join(filter_, "bit", "left_semi").groupBy(key).agg(F.count("*").alias("hits"))
    return met.filter(F.col("hits") == hashes).select(key)
