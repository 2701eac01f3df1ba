"""One-step change forecast from the flattened window before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.columns import dot
from seriesloom.operators import scale
from seriesloom.operators.gram import gram, regress
from seriesloom.operators.keys import join_on
from seriesloom.operators.position import over_blocks
from seriesloom.session import cut_lineage
from seriesloom.spec import SeriesSpec


def window_columns(spec: SeriesSpec, seq_len: int) -> list[str]:
    return [f"{c}_{i}" for i in range(seq_len, 0, -1) for c in spec.columns]


def with_window(df: DataFrame, spec: SeriesSpec, seq_len: int) -> DataFrame:
    """The ``seq_len`` rows before each row as columns, oldest first; rows without them are dropped."""
    lagged = over_blocks(
        df, spec,
        lambda w: {f"{c}_{i}": F.lag(c, i).over(w) for i in range(seq_len, 0, -1) for c in spec.columns},
        before=seq_len,
    )
    return lagged.na.drop(subset=window_columns(spec, seq_len)).withColumn("one", F.lit(1.0))


def fit_delta(df: DataFrame, spec: SeriesSpec, seq_len: int = 10, penalty: float = 1.0) -> DataFrame:
    """Scaler and coefficients of the scaled change per series; needs ``pos`` and ``phase``.

    A window belongs to the phase of the row it predicts.
    """
    keys = list(spec.keys)
    scaler = scale.fit_scaler(df, spec)
    rows = with_window(scale.scale(df, scaler, spec), spec, seq_len).where(F.col("phase") == "train")
    rows = rows.withColumn("_change", F.col(spec.value) - F.col(f"{spec.value}_1"))
    xs = ["one", *window_columns(spec, seq_len)]
    grams = gram(rows, keys, [*xs, "_change"])
    fitted = regress(grams, keys, [*xs, "_change"], xs, "_change", {c: penalty for c in xs[1:]})
    return cut_lineage(join_on(fitted.select(*keys, "betas"), scaler, keys))


def predict_delta(df: DataFrame, params: DataFrame, spec: SeriesSpec, seq_len: int = 10) -> DataFrame:
    """Previous true value plus the expected change, in the units of the target."""
    keys = list(spec.keys)
    scaler = params.drop("betas")
    rows = join_on(with_window(scale.scale(df, scaler, spec, keep=True), spec, seq_len), params.select(*keys, "betas"), keys)
    change = dot("betas", ["one", *window_columns(spec, seq_len)])
    known = F.col(f"{spec.value}_1")
    rows = rows.withColumns({"_change": change, "_known": known, "_truth": F.col(spec.value)})
    return rows.select(
        *keys, spec.time, "pos", "n", "phase",
        scale.unscaled("_truth", spec.value).alias("y_true"),
        (scale.unscaled("_known", spec.value) + scale.unscaled_difference("_change", spec.value)).alias("yhat"),
    )


def fit_window_residual(
    df: DataFrame, forecast: DataFrame, spec: SeriesSpec, seq_len: int = 10, alpha: float = 0.0
) -> DataFrame:
    """Coefficients of the validation residual on the window and its last change, without intercept.

    The change repeats two window columns, so with ``alpha`` 0 the shortest of
    the equally good solutions is taken.
    """
    keys = list(spec.keys)
    rows, xs = _residual_design(df, spec, seq_len)
    missed = forecast.where(F.col("phase") == "val").select(*keys, spec.time, (F.col("y_true") - F.col("yhat")).alias("_miss"))
    grams = gram(join_on(rows, missed, [*keys, spec.time]), keys, [*xs, "_miss"])
    return cut_lineage(regress(grams, keys, [*xs, "_miss"], xs, "_miss", alpha).select(*keys, "betas"))


def apply_window_residual(
    df: DataFrame, forecast: DataFrame, params: DataFrame, spec: SeriesSpec, seq_len: int = 10
) -> DataFrame:
    """Add the expected residual to every forecast that has a window; others stay."""
    keys = list(spec.keys)
    rows, xs = _residual_design(df, spec, seq_len)
    expected = join_on(rows, params, keys).select(*keys, spec.time, dot("betas", xs).alias("_expected"))
    joined = join_on(forecast, expected, [*keys, spec.time], "left")
    return joined.withColumn("corrected", F.col("yhat") + F.coalesce("_expected", F.lit(0.0))).drop("_expected")


def _residual_design(df: DataFrame, spec: SeriesSpec, seq_len: int) -> tuple[DataFrame, list[str]]:
    rows = with_window(df, spec, seq_len).drop("one")
    changes = {f"{c}_change": F.col(f"{c}_1") - F.col(f"{c}_2") for c in spec.columns}
    return rows.withColumns(changes), [*window_columns(spec, seq_len), *changes]
