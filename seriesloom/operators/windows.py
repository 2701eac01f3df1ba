"""Sliding windows as arrays, one row per window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.position import BLOCK_ROWS, over_blocks
from seriesloom.spec import SeriesSpec


def _cells(columns: list[str]) -> Column:
    # An array is never NULL itself, so rows with missing numbers stay in the window.
    return F.array(*[F.col(c).cast("double") for c in columns])


def supervised_windows(
    df: DataFrame, spec: SeriesSpec, input_steps: int, output_steps: int = 1, stride: int = 1, block: int = BLOCK_ROWS
) -> DataFrame:
    """Inputs ``x`` of rows ``[origin, origin + input_steps)`` and the next ``output_steps`` rows as ``y``.

    Origins are multiples of ``stride``; with a larger stride fewer windows are built.
    """
    if stride > 1:
        return _strided(df, spec, input_steps, output_steps, stride, block)
    cells = _cells(spec.columns)

    def frames(w):
        return {
            "x": F.collect_list(cells).over(w.rowsBetween(1 - input_steps, 0)),
            "y": F.collect_list(cells).over(w.rowsBetween(1, output_steps)),
        }

    full = over_blocks(df, spec, frames, before=input_steps - 1, after=output_steps, block=block)
    whole = (F.size("x") == input_steps) & (F.size("y") == output_steps)
    return full.where(whole).select(
        *spec.keys, (F.col("pos") - (input_steps - 1)).alias("origin"), spec.time, "n", "x", "y"
    )


def _strided(df: DataFrame, spec: SeriesSpec, input_steps: int, output_steps: int, stride: int, block: int) -> DataFrame:
    """One window per group of ``stride`` rows: the group that starts at the origin and those after it."""
    keys, width = list(spec.keys), input_steps + output_steps
    row = F.struct("pos", F.col(spec.time).alias("_at"), "n", _cells(spec.columns).alias("_cell"))
    groups = df.groupBy(*keys, F.expr(f"pos div {stride}").alias("_group")).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    more = (width - 1) // stride

    def frames(w):
        return {"_all": F.flatten(F.collect_list("_rows").over(w.rowsBetween(0, more)))}

    full = over_blocks(groups.withColumnRenamed("_group", "pos"), spec, frames, after=more, block=max(block // stride, 1))
    first, last = F.element_at("_all", 1), F.element_at("_all", input_steps)
    wide = full.where((F.size("_all") >= width) & (first["pos"] == F.col("pos") * stride))
    number = F.transform("_all", lambda r: r["_cell"])
    return wide.select(
        *keys, first["pos"].alias("origin"), last["_at"].alias(spec.time), last["n"].alias("n"),
        F.slice(number, 1, input_steps).alias("x"), F.slice(number, input_steps + 1, output_steps).alias("y"),
    )


def encoder_decoder_windows(
    df: DataFrame, spec: SeriesSpec, seq_len: int = 96, label_len: int = 48, pred_len: int = 24, block: int = BLOCK_ROWS
) -> DataFrame:
    """Encoder input, decoder input with a masked future, and the label over label and future part."""
    width = len(spec.columns)
    base = supervised_windows(df, spec, seq_len, pred_len, block=block)
    known = F.slice("x", seq_len - label_len + 1, label_len)
    masked = F.array_repeat(F.array(*[F.lit(None).cast("double")] * width), pred_len)
    return base.select(
        *spec.keys, "origin", spec.time, "n",
        F.col("x").alias("x_enc"),
        F.concat(known, masked).alias("x_dec"),
        F.concat(known, F.col("y")).alias("y_label"),
    )


def disjoint_windows(
    df: DataFrame, spec: SeriesSpec, seq_len: int = 48, label_len: int = 24, pred_len: int = 24,
    covariates: list[str] | None = None, block: int = BLOCK_ROWS,
) -> DataFrame:
    """Encoder rows, then ``label_len + pred_len`` decoder rows that do not overlap them; ``y`` is the last part."""
    cells = _cells(spec.columns)
    after = label_len + pred_len

    def frames(w):
        out = {
            "x_enc": F.collect_list(cells).over(w.rowsBetween(1 - seq_len, 0)),
            "x_dec": F.collect_list(cells).over(w.rowsBetween(1, after)),
        }
        if covariates:
            out["x_feature"] = F.collect_list(_cells(covariates)).over(w.rowsBetween(1 - seq_len, 0))
        return out

    full = over_blocks(df, spec, frames, before=seq_len - 1, after=after, block=block)
    whole = full.where((F.size("x_enc") == seq_len) & (F.size("x_dec") == after))
    return whole.select(
        *spec.keys, (F.col("pos") - (seq_len - 1)).alias("origin"), spec.time, "n", "x_enc", "x_dec",
        F.slice("x_dec", label_len + 1, pred_len).alias("y"), *(["x_feature"] if covariates else []),
    )


def flattened(window: str) -> Column:
    """All rows of a window in one array, row after row."""
    return F.flatten(window)


def per_step(df: DataFrame, steps: int, name: str = "step") -> DataFrame:
    """Repeat each window once per horizon step 1..``steps``."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(steps))))


def last_difference(window: str, channel: int = 1) -> Column:
    """Last value of the window minus the one before."""
    return F.element_at(F.element_at(window, -1), channel) - F.element_at(F.element_at(window, -2), channel)


def unrolled(df: DataFrame, keys: list[str], window: str, channels: list[str]) -> DataFrame:
    """A window column as one row per window row, numbered by ``step`` from 0."""
    rows = df.select(*keys, F.posexplode(window).alias("step", "_cells"))
    return rows.select(*keys, "step", *[F.element_at("_cells", i).alias(c) for i, c in enumerate(channels, 1)])


def target_phase(windows: DataFrame, input_steps: int, phase: Column) -> DataFrame:
    """Label one-step windows with the phase of the row they predict; the history may reach back.

    ``phase`` is an expression over ``pos`` and ``n``.
    """
    return windows.withColumn("pos", F.col("origin") + input_steps).withColumn("phase", phase)
