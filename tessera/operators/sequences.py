"""Subsequences of arrays; of a null array null, of an empty one length 0. Null elements equal nothing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.arrays import bind


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays: one row of the table at a time."""

    def table(ys: Column) -> Column:
        first = F.transform(F.sequence(F.lit(0), F.size(ys)), lambda j: F.lit(0))
        places = F.when(F.size(ys) > 0, F.sequence(F.lit(0), F.size(ys) - 1)).otherwise(F.array().cast("array<int>"))

        def row(prev: Column, x: Column) -> Column:
            cell = lambda cur, j: F.concat(cur, F.array(F.when(F.get(ys, j) == x, F.get(prev, j) + 1).otherwise(F.greatest(F.get(prev, j + 1), F.element_at(cur, -1)))))
            return F.aggregate(places, F.array(F.lit(0)), cell)

        return F.aggregate(a, first, row, lambda last: F.element_at(last, -1))

    return bind(b, table).cast("long")


def lis_length(values: Column, element: str = "double") -> Column:
    """Length of the longest strictly increasing subsequence: the least last values of each length, kept in order."""

    def step(tails: Column, x: Column) -> Column:
        k = F.size(F.filter(tails, lambda t: t < x))
        return F.when(k == F.size(tails), F.concat(tails, F.array(x))).otherwise(F.transform(tails, lambda t, i: F.when(i == k, x).otherwise(t)))

    return F.aggregate(values, F.array().cast(f"array<{element}>"), step, lambda t: F.size(t)).cast("long")


def lcs_column(a: Column, b: Column, element: str) -> Column:
    """One longest common subsequence of two arrays, in Arrow batches; null of a null."""
    return F.pandas_udf(lambda xs, ys: pd.Series([None if x is None or y is None else lcs(list(x), list(y)) for x, y in zip(xs, ys)], dtype=object), f"array<{element}>")(a, b)


def lis_column(values: Column, element: str) -> Column:
    """One longest strictly increasing subsequence of an array, in Arrow batches; null of a null."""
    return F.pandas_udf(lambda xs: pd.Series([None if x is None else lis(list(x)) for x in xs], dtype=object), f"array<{element}>")(values)


def lcs(a: list, b: list) -> list:
    """One longest common subsequence; on ties the last of ``a`` is dropped first. For short lists, or in a UDF."""
    size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            size[i + 1][j + 1] = size[i][j] + 1 if x == y else max(size[i][j + 1], size[i + 1][j])
    out, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append(a[i - 1])
            i, j = i - 1, j - 1
        elif size[i - 1][j] >= size[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def lis(values: list) -> list:
    """One longest strictly increasing subsequence; none of nothing."""
    from bisect import bisect_left

    tails, at, before = [], [], [-1] * len(values)
    for i, x in enumerate(values):
        k = bisect_left(tails, x)
        before[i] = at[k - 1] if k else -1
        tails[k:k + 1], at[k:k + 1] = [x], [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(values[i])
        i = before[i]
    return out[::-1]
