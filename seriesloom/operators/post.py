"""Forecast post-processing: clamps, calibration, residual models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.columns import clipped
from seriesloom.operators.features import with_trailing_mean
from seriesloom.operators.gram import gram_of, per_key, solved, square
from seriesloom.operators.keys import join_on
from seriesloom.operators.metrics import mape_eps
from seriesloom.session import cut_lineage
from seriesloom.spec import SeriesSpec


def clamp_positive(c: str = "yhat") -> Column:
    return F.when(F.col(c).isNotNull(), F.greatest(F.col(c), F.lit(0.0)))


def smooth(df: DataFrame, spec: SeriesSpec, column: str = "yhat", name: str = "yhat", width: int = 3) -> DataFrame:
    """Trailing mean of the forecast along the series; needs ``pos``."""
    return with_trailing_mean(df, spec, column, name, width)


def linear(c: str, a: float, b: float) -> Column:
    return F.col(c) * a + b


def _with_phase_ends(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Validation length and end and test start per series, joined to its rows."""
    val, test = F.col("phase") == "val", F.col("phase") == "test"
    ends = df.groupBy(*spec.keys).agg(
        F.count_if(val).alias("_n_val"),
        F.max(F.when(val, F.col("pos"))).alias("_val_end"),
        F.min(F.when(test, F.col("pos"))).alias("_test_start"),
    )
    return join_on(df, cut_lineage(ends), spec.keys)


def _tail_length(rows: int) -> Column:
    return F.greatest(F.lit(7), F.least(F.lit(rows), F.col("_n_val")))


def _in_val_tail(rows: int) -> Column:
    return (F.col("phase") == "val") & (F.col("pos") > F.col("_val_end") - _tail_length(rows))


def calibrate_bias(df: DataFrame, spec: SeriesSpec, season: int = 7) -> DataFrame:
    """Shift validation and test forecasts by the mean error of the last two seasons of validation."""
    rows = 2 * max(1, season)
    ended = _with_phase_ends(df, spec)
    bias = ended.groupBy(*spec.keys).agg(
        F.avg(F.when(_in_val_tail(rows), F.col("y_true") - F.col("yhat"))).alias("bias")
    )
    shifted = F.col("yhat") + F.coalesce("bias", F.lit(0.0))
    evaluated = F.col("phase").isin("val", "test")
    return join_on(df, cut_lineage(bias), spec.keys).withColumn("yhat", F.when(evaluated, shifted).otherwise(F.col("yhat")))


def calibrate_spread(
    df: DataFrame, spec: SeriesSpec, season: int = 7, multiple: float = 2.0, low: float = 0.7, high: float = 1.5
) -> DataFrame:
    """Stretch forecasts around their mean by the ratio of true to forecast deviation.

    The ratio comes from the validation tail and is limited to ``[low, high]``;
    validation stretches about its tail mean, test about the mean of its head.
    """
    rows = int(max(1.0, multiple) * max(1, season))
    ended = _with_phase_ends(df, spec)
    tail = _in_val_tail(rows)
    in_head = (F.col("phase") == "test") & (F.col("pos") < F.col("_test_start") + _tail_length(rows))
    stats = ended.groupBy(*spec.keys).agg(
        F.stddev_samp(F.when(tail, F.col("y_true"))).alias("_true"),
        F.stddev_samp(F.when(tail, F.col("yhat"))).alias("_pred"),
        F.avg(F.when(tail, F.col("yhat"))).alias("_val_mean"),
        F.avg(F.when(in_head, F.col("yhat"))).alias("_test_mean"),
        F.first(_tail_length(rows)).alias("_rows"),
        F.first("_n_val").alias("_n_val"),
    )
    usable = (F.col("_rows") > 5) & (F.col("_n_val") >= F.col("_rows")) & (F.col("_pred") > 0)
    ratio = F.when(usable, clipped(F.col("_true") / F.nullif(F.col("_pred"), F.lit(0.0)), min(low, high), max(low, high)))
    stats = stats.select(*spec.keys, ratio.alias("ratio"), "_val_mean", "_test_mean")
    centre = F.when(F.col("phase") == "val", F.col("_val_mean")).when(F.col("phase") == "test", F.col("_test_mean"))
    stretched = centre + (F.col("yhat") - centre) * F.col("ratio")
    return join_on(df, cut_lineage(stats), spec.keys).withColumn("yhat", F.coalesce(stretched, F.col("yhat"))).drop("_val_mean", "_test_mean")


def fit_residual(df: DataFrame, spec: SeriesSpec, kind: str = "linear", alpha: float = 1.0, phase: str | None = "val") -> DataFrame:
    """Slope and intercept of the residual as a function of the forecast, one row per series.

    ``bias`` is the mean residual; ``ridge`` and ``lasso`` penalise the slope only.
    """
    rows = df if phase is None else df.where(F.col("phase") == phase)
    known = rows.where(F.col("y_true").isNotNull() & F.col("yhat").isNotNull())
    residual = known.withColumn("_r", F.col("y_true") - F.col("yhat"))
    sums = residual.groupBy(*spec.keys).agg(
        F.count(F.lit(1)).alias("n_fit"),
        F.avg("_r").alias("_mr"),
        F.avg("yhat").alias("_mx"),
        F.var_pop("yhat").alias("_vx"),
        F.covar_pop("_r", "yhat").alias("_cov"),
    )
    cov, var, n = F.col("_cov"), F.col("_vx"), F.col("n_fit")
    slope = {
        "bias": F.lit(0.0),
        "linear": F.coalesce(F.try_divide(cov, var), F.lit(0.0)),
        "ridge": F.coalesce(F.try_divide(n * cov, n * var + alpha), F.lit(0.0)),
        "lasso": F.coalesce(F.try_divide(F.signum(cov) * F.greatest(F.abs(cov) - alpha, F.lit(0.0)), var), F.lit(0.0)),
    }[kind]
    fitted = sums.withColumn("slope", slope)
    return cut_lineage(fitted.select(*spec.keys, "slope", (F.col("_mr") - F.col("slope") * F.col("_mx")).alias("intercept")))


def apply_residual(df: DataFrame, params: DataFrame, spec: SeriesSpec, name: str = "corrected") -> DataFrame:
    """Add the expected residual to the forecast; series without parameters stay as they are."""
    change = F.coalesce(F.col("slope") * F.col("yhat") + F.col("intercept"), F.lit(0.0))
    joined = join_on(df, params.select(*spec.keys, "slope", "intercept"), spec.keys, "left")
    return joined.withColumn(name, F.col("yhat") + change).drop("slope", "intercept")


def fit_step_residual(
    windows: DataFrame, spec: SeriesSpec, inputs: list[str], steps: int, alpha: float = 0.0, phase: str | None = "val"
) -> DataFrame:
    """Residuals of all ``steps`` of a forecast from the ``inputs`` of its window: ``betas`` per step, intercept first.

    One row per window with the arrays ``y_true`` and ``yhat``. All steps share one
    matrix of inputs, so it is summed and factorised once per series. ``alpha``
    penalises the slopes. Windows with a NULL are left out.
    """
    rows = windows if phase is None else windows.where(F.col("phase") == phase)
    miss = F.zip_with("y_true", "yhat", lambda y, f: y - f)
    size = 1 + len(inputs)
    vector = F.concat(F.array(F.lit(1.0), *[F.col(c).cast("double") for c in inputs]), miss)
    ridge = np.diag([0.0] + [alpha] * len(inputs))

    def solve(cells, n, row):
        g = square(cells, size + steps)
        return [{"betas": solved(g[:size, :size] + ridge, g[:size, size:]).T.tolist()}]

    grams = gram_of(rows.where(F.size("y_true") == steps), list(spec.keys), vector, size + steps)
    return cut_lineage(per_key(grams, list(spec.keys), "betas array<array<double>>", solve))


def apply_step_residual(windows: DataFrame, params: DataFrame, spec: SeriesSpec, inputs: list[str], name: str = "corrected") -> DataFrame:
    """Add the expected residual to each step's forecast; series without parameters stay as they are."""
    joined = join_on(windows, params.select(*spec.keys, F.col("betas").alias("_betas")), spec.keys, "left")
    row = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in inputs])
    expected = F.transform("_betas", lambda b: F.aggregate(F.zip_with(b, row, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))
    changed = F.zip_with("yhat", expected, lambda f, e: f + e)
    return joined.withColumn(name, F.when(F.col("_betas").isNull(), F.col("yhat")).otherwise(changed)).drop("_betas")


def keep_if_better(df: DataFrame, spec: SeriesSpec, by: list[str] | None = None) -> DataFrame:
    """Use ``corrected`` only where it lowers the relative error of its group, else keep the raw forecast."""
    by = by or list(spec.keys)
    scores = df.groupBy(*by).agg(mape_eps().alias("raw_mape"), mape_eps(yhat="corrected").alias("corrected_mape"))
    used = F.coalesce(F.col("corrected_mape") < F.col("raw_mape"), F.lit(True))
    return join_on(df, cut_lineage(scores), by).withColumn("used", used).withColumn("final", F.when(F.col("used"), F.col("corrected")).otherwise(F.col("yhat")))


def add_correction(df: DataFrame, correction: DataFrame, spec: SeriesSpec, name: str = "corrected") -> DataFrame:
    """Add a correction given per series and time; rows without one get 0, surplus corrections are ignored."""
    given = correction.select(*spec.keys, spec.time, "correction")
    return join_on(df, given, [*spec.keys, spec.time], "left").withColumn(
        name, F.col("yhat") + F.coalesce("correction", F.lit(0.0))
    ).drop("correction")
