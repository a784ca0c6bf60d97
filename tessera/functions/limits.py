"""Least and greatest values of the number types, and typed folds."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Signed types by their bits.
BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


def limits(kind: str) -> tuple:
    """The least and the greatest value of a type; floating types have their greatest finite ones."""
    if kind in BITS:
        return -(1 << (BITS[kind] - 1)), (1 << (BITS[kind] - 1)) - 1
    if kind == "double":
        return -sys.float_info.max, sys.float_info.max
    raise ValueError(f"no limits of {kind}")


def table_of_limits(spark: SparkSession) -> DataFrame:
    """type, least, greatest of the integer types."""
    return spark.createDataFrame([(k, *limits(k)) for k in BITS], "type string, least long, greatest long")


def least(column: Column, kind: str) -> Column:
    """The aggregate minimum, the type's greatest value where there is none."""
    return F.coalesce(F.min(column), F.lit(limits(kind)[1]).cast(kind))


def greatest(column: Column, kind: str) -> Column:
    """The aggregate maximum, the type's least value where there is none."""
    return F.coalesce(F.max(column), F.lit(limits(kind)[0]).cast(kind))
