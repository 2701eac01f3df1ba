"""Forecasts of several steps ahead from a window of history."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.operators import scale
from seriesloom.operators.gram import solved
from seriesloom.operators.keys import join_on
from seriesloom.operators.lagsums import per_window_matrix
from seriesloom.operators.merge import merge_overlaps
from seriesloom.operators.post import apply_residual, linear
from seriesloom.operators.windows import supervised_windows, unrolled
from seriesloom.session import cut_lineage
from seriesloom.sources.resample import step_after
from seriesloom.spec import SeriesSpec

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def horizon_windows(df: DataFrame, spec: SeriesSpec, seq_len: int, pred_len: int, step: int = 1) -> DataFrame:
    """Rolling windows with the history ``x`` of target and covariates, the target's next values ``y`` and their times."""
    timed = df.withColumn("_when", F.unix_micros(F.col(spec.time).cast("timestamp")).cast("double"))
    channels = len(spec.columns)
    wide = supervised_windows(timed, spec.using(features=(*spec.columns[1:], "_when")), seq_len, pred_len, step)
    return wide.select(*spec.keys, "origin", "n", "x", F.transform("y", lambda cell: F.array(cell[0], cell[channels])).alias("y"))


def _channel(x: str, i: int) -> Column:
    return F.transform(x, lambda cell: cell[i])


def _flat(x: str, channels: int) -> Column:
    """The cells of a window channel by channel, as the coefficients are ordered."""
    return F.concat(*[_channel(x, i) for i in range(channels)])


def _steps(windows: DataFrame, spec: SeriesSpec, seq_len: int, keep: list[str], cells: list[str] | None = None) -> DataFrame:
    """One row per window and horizon step, stamped with the time it forecasts; ``cells`` are further numbers in ``y``."""
    cells = cells or []
    steps = unrolled(windows, [*spec.keys, "origin", *keep], "y", ["y_true", "_when", *cells])
    moment = F.timestamp_micros(F.col("_when").cast("bigint")).cast("timestamp_ntz")
    return steps.select(
        *spec.keys, "origin", (F.col("step") + 1).alias("step"), moment.alias(spec.time),
        (F.col("origin") + seq_len + F.col("step")).alias("pos"), "y_true", *keep, *cells,
    )


def flat_forecast(df: DataFrame, spec: SeriesSpec, seq_len: int, pred_len: int, step: int | None = None) -> DataFrame:
    """The last value of each rolling window for all steps of its horizon."""
    windows = horizon_windows(df, spec, seq_len, pred_len, step or pred_len)
    last = F.element_at(F.element_at("x", -1), 1)
    return _steps(windows.withColumn("yhat", last), spec, seq_len, ["yhat"])


def fit_horizon(df: DataFrame, spec: SeriesSpec, seq_len: int = 96, pred_len: int = 24, penalty: float = 1.0) -> DataFrame:
    """Scaler and one coefficient array per horizon step per series.

    An array holds the intercept, then the target and each covariate in
    ``spec.features``, oldest to newest row of the window. Needs ``pos`` and
    ``phase``; only windows whose whole horizon is training are used.
    """
    keys, names, width = list(spec.keys), spec.columns, seq_len + pred_len
    scaler = scale.fit_scaler(df, spec, names)
    train = scale.scale(df.where(F.col("phase") == "train"), scaler, spec, names)
    inputs = [0] + [width * (c + 1) + i for c in range(len(names)) for i in range(seq_len)]
    targets = [width + seq_len + h for h in range(pred_len)]

    def solve(matrix, n):
        betas = solved(matrix[np.ix_(inputs, inputs)] + penalty * np.eye(len(inputs)), matrix[np.ix_(inputs, targets)])
        return [{"betas": betas.T.tolist()}]

    fitted = per_window_matrix(train, spec, names, width, "betas array<array<double>>", solve)
    return cut_lineage(join_on(fitted, scaler, keys))


def unscaled_betas(names: list[str], seq_len: int) -> Column:
    """The coefficients for windows in their own units, the target first in ``names``; scalers go into slopes and intercept."""
    mean, spread = F.col(f"{names[0]}_mean"), F.col(f"{names[0]}_std")

    def fold(b: Column) -> Column:
        start, slopes = F.element_at(b, 1) * spread + mean, []
        for c, name in enumerate(names):
            ratio = spread / F.col(f"{name}_std") if c else F.lit(1.0)
            own = _times(F.slice(b, 2 + c * seq_len, seq_len), ratio)
            start = start - F.aggregate(own, F.lit(0.0), lambda a, s: a + s) * F.col(f"{name}_mean")
            slopes.append(own)
        return F.concat(F.array(start), *slopes)

    return F.transform("betas", fold)


def _times(numbers: Column, factor: Column) -> Column:
    return F.transform(numbers, lambda x: x * factor)


def _products(betas: pa.Array, x: pa.Array) -> pa.Array:
    """One forecast per coefficient array of a row; NULL where the window has a NULL."""
    rows, flat = len(x), x.flatten().to_numpy(zero_copy_only=False)
    if not rows:
        return pa.array([], pa.list_(pa.float64()))
    width = len(flat) // rows
    matrices = betas.flatten().flatten().to_numpy(zero_copy_only=False).reshape(rows, -1, width + 1)
    made = np.einsum("rpw,rw->rp", matrices[:, :, 1:], flat.reshape(rows, width)) + matrices[:, :, 0]
    cells = made.reshape(-1)
    offsets = np.arange(rows + 1, dtype=np.int32) * made.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(cells, mask=np.isnan(cells)))


def _forecasts(betas: str, x: str) -> Column:
    """One forecast per coefficient array, from the flat window in the units of the target."""
    return F.arrow_udf(_products, "array<double>")(betas, x)


def predict_rolling(df: DataFrame, params: DataFrame, spec: SeriesSpec, seq_len: int, pred_len: int, step: int = 1) -> DataFrame:
    """Forecasts of all rolling windows, one row per window and horizon step."""
    raw = cut_lineage(params.select(*spec.keys, unscaled_betas(spec.columns, seq_len).alias("_b")))
    windows = join_on(horizon_windows(df, spec, seq_len, pred_len, step), raw, spec.keys)
    windows = windows.withColumn("_f", _forecasts("_b", _flat("x", len(spec.columns)))).drop("_b", "x")
    # The forecast of a step travels in its own cell, not in a copy of the whole array.
    windows = windows.withColumn("y", F.zip_with("y", "_f", lambda cell, f: F.concat(cell, F.array(f)))).drop("_f")
    return _steps(windows, spec, seq_len, [], ["yhat"])


def rolling_forecast(
    df: DataFrame, params: DataFrame, spec: SeriesSpec, seq_len: int, pred_len: int, step: int | None = None, mode: str = "overwrite"
) -> DataFrame:
    """One forecast per time from windows every ``step`` rows (default: the horizon)."""
    return merge_overlaps(predict_rolling(df, params, spec, seq_len, pred_len, step or pred_len), spec, mode)


def segment_forecast(
    df: DataFrame, params: DataFrame, spec: SeriesSpec, seq_len: int, pred_len: int,
    calibration: tuple[float, float] | None = None, residual: DataFrame | None = None,
) -> DataFrame:
    """Strict mean over the windows from every row, optionally scaled and corrected per window before."""
    rows = predict_rolling(df, params, spec, seq_len, pred_len)
    if calibration:
        rows = rows.withColumn("yhat", linear("yhat", *calibration))
    if residual is not None:
        rows = apply_residual(rows, residual, spec, "yhat")
    return merge_overlaps(rows, spec, "strict_mean")


def dense_last(df: DataFrame, params: DataFrame, spec: SeriesSpec, seq_len: int, k: int) -> DataFrame:
    """One-step forecasts of the last ``k`` rows of each series; ``params`` have one horizon step."""
    needed = df.where(F.col("pos") >= F.col("n") - k - seq_len)
    rows = predict_rolling(needed, params, spec, seq_len, 1)
    sizes = df.groupBy(*spec.keys).agg(F.max("n").alias("n"))
    return join_on(rows, cut_lineage(sizes), spec.keys).where(F.col("pos") >= F.col("n") - k).drop("n", "origin", "step")


def predict_next(df: DataFrame, params: DataFrame, spec: SeriesSpec, seq_len: int, grid: str) -> DataFrame:
    """The horizon after the last row of each series, from its last ``seq_len`` values; needs ``pos`` and ``n``."""
    last = df.where(F.col("pos") >= F.col("n") - seq_len)
    cells = F.array(*[F.col(c).cast("double") for c in spec.columns])
    windows = last.groupBy(*spec.keys).agg(
        F.max(spec.time).alias("_end"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", cells.alias("_c")))), lambda row: row["_c"]).alias("_x"),
    )
    raw = cut_lineage(params.select(*spec.keys, unscaled_betas(spec.columns, seq_len).alias("_b")))
    whole = join_on(windows.where(F.size("_x") == seq_len), raw, spec.keys)
    whole = whole.withColumn("_f", _forecasts("_b", _flat("_x", len(spec.columns))))
    steps = whole.select(*spec.keys, "_end", F.posexplode("_f").alias("_i", "yhat"))
    steps = steps.withColumn("step", F.col("_i") + 1)
    return steps.select(*spec.keys, "step", step_after("_end", "step", grid).alias(spec.time), "yhat")
