"""Joins by the keys of a series that treat NULL as a key like any other."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal ``keys``, NULL matching NULL; the result has the columns of both sides, keys once.

    A plain equi-join would drop the rows of a series whose key is NULL, and rows
    without a time.
    """
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    equal = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(renamed, reduce(lambda a, b: a & b, equal), how).drop(*[f"_right_{k}" for k in keys])
