"""Least squares per key from one pass over the rows.

The pass sums the outer products of the rows per key: each task adds up its own
rows, Spark adds up the tasks. What is left per key is one small matrix, from
which every regression on any subset of the columns follows without another
look at the rows.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ship the helpers below with the tasks, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEYS_HELD = 512


def gram(df: DataFrame, keys: list[str], columns: list[Column | str]) -> DataFrame:
    """Per key: rows ``n`` and the sums of products of all column pairs, upper triangle row by row.

    Rows with a NULL in a column are left out.
    """
    numbers = F.array(*[(F.col(c) if isinstance(c, str) else c).cast("double") for c in columns])
    return gram_of(df, keys, numbers, len(columns))


def gram_of(df: DataFrame, keys: list[str], vector: Column, size: int) -> DataFrame:
    """As :func:`gram` for the elements of an array column of ``size`` numbers."""
    rows = df.select(*keys, vector.alias("_x"))
    schema = T.StructType(
        [rows.schema[k] for k in keys]
        + [T.StructField("n", T.LongType()), T.StructField("cells", T.ArrayType(T.DoubleType()))]
    )
    upper = np.triu_indices(size)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            if batch.empty:
                continue
            matrix = np.concatenate(batch["_x"].to_numpy()).astype(float).reshape(len(batch), size)
            whole = ~np.isnan(matrix).any(axis=1)
            matrix, batch = matrix[whole], batch[whole]
            for key, at in batch.groupby(keys, sort=False, dropna=False).indices.items():
                part = matrix[at]
                add = (part.T @ part)[upper]
                n, cells = held.get(key, (0, 0.0))
                held[key] = (n + len(at), cells + add)
            if len(held) > KEYS_HELD:
                yield packed(held, keys)
                held = {}
        if held:
            yield packed(held, keys)

    return summed(rows.mapInPandas(partial, schema), keys)


def plain(value):
    """A key as pandas hands it on: a missing one as None, a whole number as such."""
    if value is None or value != value:
        return None
    return int(value) if isinstance(value, float) and value.is_integer() else value


def frame_of(rows: list[dict], columns: list[str], keys: list[str]) -> pd.DataFrame:
    """Rows as a frame whose keys keep their own type, NULL included."""
    out = pd.DataFrame(rows, columns=columns)
    for k in keys:
        out[k] = pd.Series([plain(r[k]) for r in rows], dtype=object)
    return out


def packed(held: dict, keys: list[str]) -> pd.DataFrame:
    names = [k if isinstance(k, tuple) else (k,) for k in held]
    rows = [{**dict(zip(keys, k)), "n": n, "cells": cells.tolist()} for k, (n, cells) in zip(names, held.values())]
    return frame_of(rows, [*keys, "n", "cells"], keys)


def summed(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Add up the partial matrices of a key cell by cell."""
    cells = parts.select(*keys, "n", F.posexplode("cells").alias("_i", "_g"))
    added = cells.groupBy(*keys, "_i").agg(F.sum("n").alias("n"), F.sum("_g").alias("_g"))
    matrix = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_g"))), lambda c: c["_g"])
    return added.groupBy(*keys).agg(F.max("n").alias("n"), matrix.alias("cells"))


def running_gram(blocks: DataFrame, keys: list[str], block: str) -> DataFrame:
    """For each block the sum of the matrices of the blocks before it; none for the first."""
    cells = blocks.select(*keys, block, "n", F.posexplode("cells").alias("_i", "_g"))
    earlier = Window.partitionBy(*keys, "_i").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    before = cells.select(*keys, block, "_i", F.sum("n").over(earlier).alias("n"), F.sum("_g").over(earlier).alias("_g"))
    matrix = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_g"))), lambda c: c["_g"])
    return before.groupBy(*keys, block).agg(F.max("n").alias("n"), matrix.alias("cells")).where(F.col("n").isNotNull())


def square(cells, size: int) -> np.ndarray:
    full = np.zeros((size, size))
    full[np.triu_indices(size)] = cells
    return full + np.triu(full, 1).T


def solved(matrix: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Solution of a symmetric system; the shortest one where columns are collinear."""
    try:
        np.linalg.cholesky(matrix)
        return np.linalg.solve(matrix, rhs)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(matrix, rcond=1e-10, hermitian=True) @ rhs


def sparse_solved(matrix: np.ndarray, rhs: np.ndarray, l1: np.ndarray, l2: np.ndarray | float = 0.0, sweeps: int = 20_000) -> np.ndarray:
    """The b with the least ``b'Mb / 2 - b'r + sum(l1 |b|) + sum(l2 b^2) / 2``, by coordinate descent.

    Each step solves for one coefficient and pulls it towards 0 by its ``l1``. Now
    and then the system of the coefficients that are not 0 is solved as a whole;
    where that keeps their signs and asks for no other coefficient, it is the answer.
    """
    m = matrix + np.diag(np.broadcast_to(np.asarray(l2, float), rhs.shape))
    scale = np.diag(m).copy()
    b = np.zeros(len(rhs))
    rest = np.asarray(rhs, float).copy()  # rhs - m @ b
    for sweep in range(sweeps + 1):
        for j in np.flatnonzero(scale > 0) if sweep else ():
            pull = rest[j] + scale[j] * b[j]
            new = np.sign(pull) * max(abs(pull) - l1[j], 0.0) / scale[j]
            if new != b[j]:
                rest -= m[:, j] * (new - b[j])
                b[j] = new
        if sweep in (0, 5, 20) or sweep % 50 == 0:
            on = (b != 0) | (l1 == 0)
            whole = np.zeros(len(rhs))
            whole[on] = solved(m[np.ix_(on, on)], rhs[on] - l1[on] * np.sign(b[on]))
            left = rhs - m @ whole
            slack = 1e-9 * (1.0 + np.abs(rhs).max())
            if (np.sign(whole) == np.sign(b))[on & (l1 > 0)].all() and (np.abs(left[~on]) <= l1[~on] + slack).all():
                return whole
    return b


def per_key(grams: DataFrame, keys: list[str], fields: str, solve: Callable[..., list[dict]], extra: list[str] | None = None) -> DataFrame:
    """Apply ``solve(cells, n, row)`` to each key's matrix; it returns rows with the ``fields`` (a DDL string).

    ``row`` holds the ``extra`` columns of that key.
    """
    extra = extra or []
    columns = T.StructType([grams.schema[k] for k in keys] + list(T.StructType.fromDDL(fields).fields))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                for answer in solve(np.asarray(row["cells"], dtype=float), int(row["n"]), row):
                    out.append({**{k: row[k] for k in keys}, **answer})
            yield frame_of(out, columns.names, keys)

    return grams.select(*keys, "n", "cells", *extra).mapInPandas(run, columns)


def regress(grams: DataFrame, keys: list[str], columns: list[str], xs: list[str], y: str, penalty: dict[str, float] | float = 0.0) -> DataFrame:
    """Coefficients ``betas`` of ``xs`` for ``y`` per key, with the residual sum of squares.

    ``penalty`` is a ridge weight for all of ``xs`` or per name.
    """
    at = [columns.index(c) for c in xs]
    target, size = columns.index(y), len(columns)
    ridge = np.array([penalty.get(c, 0.0) if isinstance(penalty, dict) else penalty for c in xs])

    def solve(cells, n, row):
        g = square(cells, size)
        betas = solved(g[np.ix_(at, at)] + np.diag(ridge), g[at, target])
        rss = g[target, target] - 2 * betas @ g[at, target] + betas @ g[np.ix_(at, at)] @ betas
        return [{"n": n, "betas": betas.tolist(), "rss": max(float(rss), 0.0)}]

    return per_key(grams, keys, "n bigint, betas array<double>, rss double", solve)
