"""Hash functions as column expressions: a portable family, and seed-0 XXH64 with its mixer."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

try:
    import xxhash as native
except ImportError:  # the form below is slower
    native = None


def hash60(text: Column) -> Column:
    """The first 60 bits of the MD5 digest as a non-negative long; any SQL engine has it."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def multiply64(x: Column, by: int) -> Column:
    """Product modulo 2**64 of bit patterns in longs, in 16-bit limbs so that nothing overflows."""
    limb = lambda k: F.shiftrightunsigned(x, 16 * k).bitwiseAND(F.lit(0xFFFF))
    b = [(by >> 16 * k) & 0xFFFF for k in range(4)]
    total, carry = F.lit(0).cast("long"), F.lit(0).cast("long")
    for k in range(4):
        column = carry
        for i in range(k + 1):
            column = column + limb(i) * F.lit(b[k - i]).cast("long")
        total = total.bitwiseOR(F.shiftleft(column.bitwiseAND(F.lit(0xFFFF)), 16 * k))
        carry = F.shiftrightunsigned(column, 16)
    return total


def xorshift_multiply(x: Column) -> Column:
    """The placement mixer: three xor-shifts and a multiplication modulo 2**64."""
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 12))
    x = x.bitwiseXOR(F.shiftleft(x, 25))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 27))
    return multiply64(x, 2685821657736338717)


MASK = (1 << 64) - 1
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261


def _rotl(x: int, r: int) -> int:
    return ((x << r) | (x >> (64 - r))) & MASK


def xxh64(data: bytes, seed: int = 0) -> int:
    """XXH64 of bytes; for the few node names that the driver hashes, and for keys where the library is missing."""
    n, at = len(data), 0
    word = lambda k, size: int.from_bytes(data[k : k + size], "little")
    step = lambda acc, lane: _rotl((acc + lane * P2) & MASK, 31) * P1 & MASK
    if n >= 32:
        lanes = [(seed + P1 + P2) & MASK, (seed + P2) & MASK, seed & MASK, (seed - P1) & MASK]
        while at <= n - 32:
            lanes = [step(v, word(at + 8 * k, 8)) for k, v in enumerate(lanes)]
            at += 32
        h = sum(_rotl(v, r) for v, r in zip(lanes, (1, 7, 12, 18))) & MASK
        for v in lanes:
            h = ((h ^ step(0, v)) * P1 + P4) & MASK
    else:
        h = (seed + P5) & MASK
    h = (h + n) & MASK
    while at + 8 <= n:
        h = (_rotl(h ^ step(0, word(at, 8)), 27) * P1 + P4) & MASK
        at += 8
    if at + 4 <= n:
        h = (_rotl(h ^ (word(at, 4) * P1 & MASK), 23) * P2 + P3) & MASK
        at += 4
    while at < n:
        h = _rotl(h ^ (data[at] * P5 & MASK), 11) * P1 & MASK
        at += 1
    for shift, by in ((33, P2), (29, P3), (32, 1)):
        h = (h ^ (h >> shift)) * by & MASK
    return h


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def xxh64_many(keys) -> np.ndarray:
    """Seed-0 XXH64 of many strings as unsigned numbers."""
    if native is not None:
        return np.fromiter(map(native.xxh64_intdigest, keys), np.uint64, len(keys))
    return np.fromiter((xxh64(k.encode("utf-8")) for k in keys), np.uint64, len(keys))


def mixed(x: np.ndarray) -> np.ndarray:
    """The placement mixer over unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(12))
    x ^= x << np.uint64(25)
    x ^= x >> np.uint64(27)
    return x * np.uint64(2685821657736338717)


def xxh64_column(key: Column) -> Column:
    """Seed-0 XXH64 of a string column, as a signed long, null of null; SQL's own function has another seed."""

    def hashes(keys: pd.Series) -> pd.Series:
        out = pd.Series(xxh64_many(keys.fillna("")).view(np.int64), dtype="Int64")
        return out.mask(keys.isna().to_numpy())

    return F.pandas_udf(hashes, LongType())(key)
