"""Sums of products over all windows of a series, from lag products instead of window rows.

A window of ``width`` rows has ``width`` columns per channel, and the matrix of
all their products has ``width²`` cells per pair of channels. Moving both columns
one row further changes their sum of products only by the rows at the ends of a
stretch of windows. So tasks add up the products of a window's first row with each
later one (``width`` cells per pair of channels), and the rest of the matrix
follows per series from these sums and the ends.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.operators.gram import gram_of, per_key, square, summed
from seriesloom.operators.keys import join_on
from seriesloom.operators.position import block_of
from seriesloom.session import cut_lineage
from seriesloom.spec import SeriesSpec

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LAG_BLOCK = 16_384


def block_parts(pos: np.ndarray, values: np.ndarray, first: int, block: int, width: int) -> tuple[int, np.ndarray, list[tuple[str, np.ndarray]]]:
    """Windows, lag products and ends of the windows that start in ``[first, first + block)``.

    ``values`` has one row per position from one before the block to ``width`` after
    it, as far as there are any. A window counts if all its rows are there and whole.
    An end is marked by its side (``start``, ``stop``) and, where the series goes on
    behind a row that is not whole, by ``inner_``.
    """
    channels = values.shape[1]
    rows = np.zeros((block + width + 1, channels))
    there, whole = np.zeros(len(rows), bool), np.zeros(len(rows), bool)
    at = pos - (first - 1)
    there[at] = True
    whole[at] = np.isfinite(values).all(axis=1)
    rows[at] = np.where(whole[at][:, None], values, 0.0)
    seen = np.concatenate([[0], np.cumsum(whole)])
    valid = seen[width:] - seen[:-width] == width  # by start, from one before the block to one after it
    mine = valid[1 : block + 1]
    firsts = rows[1 : block + 1] * mine[:, None]
    later = rows[1 : block + width]
    sums = np.stack([[np.correlate(later[:, b], firsts[:, a], "valid") for b in range(channels)] for a in range(channels)])
    ends = []
    for i in np.flatnonzero(mine & ~valid[:block]):
        ends.append(("inner_start" if there[i] else "start", rows[i + 1 : i + width].T.ravel()))
    for i in np.flatnonzero(mine & ~valid[2 : block + 2]):
        ends.append(("inner_stop" if there[i + 1 + width] else "stop", rows[i + 2 : i + 1 + width].T.ravel()))
    return int(mine.sum()), sums, ends


def window_matrix(sums: np.ndarray, moved: np.ndarray) -> np.ndarray:
    """Products of all window columns, channel by channel, from the lag products.

    ``moved`` holds what a move by one row adds: products at the stops less those at the starts.
    """
    channels, _, width = sums.shape
    moved = moved.reshape(channels, width - 1, channels, width - 1)
    out = np.zeros((channels, width, channels, width))
    for a in range(channels):
        for b in range(channels):
            out[a, 0, b], out[a, :, b, 0] = sums[a, b], sums[b, a]
            for o in range(width - 1):
                out[a, o + 1, b, 1:] = out[a, o, b, :-1] + moved[a, o, b]
    return out.reshape(channels * width, channels * width)


def per_window_matrix(
    df: DataFrame, spec: SeriesSpec, columns: list[str], width: int, fields: str, solve: Callable[[np.ndarray, int], list[dict]],
    block: int = LAG_BLOCK,
) -> DataFrame:
    """Apply ``solve(matrix, windows)`` per series; it returns rows with the ``fields`` (a DDL string).

    The matrix has ``width`` rows and columns for a channel of ones, then for each
    of ``columns``, oldest row of the window first. Windows with a NULL are left
    out; a series without a whole window has no row. Needs ``pos``.
    """
    keys, channels = list(spec.keys), len(columns) + 1
    numbers = [F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)]
    copies = df.select(*keys, "pos", *numbers).withColumn(
        "_block", F.explode(F.sequence(block_of(block, -width), block_of(block, 1)))
    )
    schema = T.StructType(
        [copies.schema[k] for k in keys]
        + [T.StructField("kind", T.StringType()), T.StructField("n", T.LongType()), T.StructField("cells", T.ArrayType(T.DoubleType()))]
    )
    names = schema.names

    def parts(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        values = np.column_stack([np.ones(len(frame)), *[frame[f"_v{i}"].to_numpy(float) for i in range(channels - 1)]])
        first = int(frame["_block"].iloc[0]) * block
        n, sums, ends = block_parts(frame["pos"].to_numpy(np.int64), values, first, block, width)
        found = [("sums", n, sums.ravel().tolist())] + [(kind, 1, cells.tolist()) for kind, cells in ends] if n else []
        out = pd.DataFrame(found, columns=names[len(keys) :])
        for i, k in enumerate(keys):
            key = frame[k].iloc[0]
            out.insert(i, k, pd.Series([None if pd.isna(key) else key] * len(out), dtype=object))
        return out

    made = cut_lineage(copies.groupBy(*keys, "_block").applyInPandas(parts, schema))
    totals = summed(made.where("kind = 'sums'").select(*keys, "n", "cells"), keys)
    # A series has one outer start and one outer stop; the ends around NULLs inside it are summed by Spark.
    outer = made.where("kind IN ('start', 'stop')").groupBy(*keys).agg(
        F.collect_list(F.when(F.col("kind") == "start", F.col("cells"))).alias("_start"),
        F.collect_list(F.when(F.col("kind") == "stop", F.col("cells"))).alias("_stop"),
    )
    size = channels * (width - 1)
    gaps = None
    for kind, sign in (("inner_stop", 1.0), ("inner_start", -1.0)):
        side = gram_of(made.where(F.col("kind") == kind), keys, F.col("cells"), size)
        side = side.withColumn("cells", _signed(sign))
        gaps = side if gaps is None else gaps.unionByName(side)
    gaps = summed(gaps, keys).select(*keys, F.col("cells").alias("_gaps"))
    rows = join_on(join_on(totals, outer, keys, "left"), gaps, keys, "left")

    def run(cells, n, row):
        moved = np.zeros((size, size)) if row["_gaps"] is None else square(np.asarray(row["_gaps"], float), size)
        for name, sign in (("_stop", 1.0), ("_start", -1.0)):
            for end in () if row[name] is None else row[name]:
                moved = moved + sign * np.outer(end, end)
        return solve(window_matrix(cells.reshape(channels, channels, width), moved), n)

    return per_key(rows, keys, fields, run, ["_start", "_stop", "_gaps"])


def _signed(sign: float):
    return F.transform("cells", lambda cell: cell * sign)
