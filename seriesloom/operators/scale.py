"""Standard scaling with parameters fitted on training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.keys import join_on
from seriesloom.session import cut_lineage
from seriesloom.spec import SeriesSpec


def fit_scaler(df: DataFrame, spec: SeriesSpec, columns: list[str] | None = None, phase: str | None = "train") -> DataFrame:
    """Mean and population deviation (0 becomes 1) per series; columns ``<c>_mean`` and ``<c>_std``."""
    rows = df if phase is None else df.where(F.col("phase") == phase)
    stats = []
    for c in columns or spec.columns:
        spread = F.stddev_pop(c)
        stats += [F.avg(c).alias(f"{c}_mean"), F.when(spread == 0, 1.0).otherwise(spread).alias(f"{c}_std")]
    return cut_lineage(rows.groupBy(*spec.keys).agg(*stats))


def scaled(c: str) -> Column:
    return (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std")


def unscaled(c: str, of: str) -> Column:
    """Column ``c`` in the units of ``of``."""
    return F.col(c) * F.col(f"{of}_std") + F.col(f"{of}_mean")


def unscaled_difference(c: str, of: str) -> Column:
    """A scaled difference in the units of ``of``: the mean cancels."""
    return F.col(c) * F.col(f"{of}_std")


def parameter_columns(columns: list[str]) -> list[str]:
    return [f"{c}_{part}" for c in columns for part in ("mean", "std")]


def scale(df: DataFrame, params: DataFrame, spec: SeriesSpec, columns: list[str] | None = None, keep: bool = False) -> DataFrame:
    """Replace the columns by their scaled values; ``keep`` leaves the parameters in the frame."""
    columns = columns or spec.columns
    out = join_on(df, params, spec.keys).withColumns({c: scaled(c) for c in columns})
    return out if keep else out.drop(*parameter_columns(columns))


def inverse_scale(df: DataFrame, params: DataFrame, spec: SeriesSpec, columns: list[str] | None = None) -> DataFrame:
    columns = columns or spec.columns
    out = join_on(df, params, spec.keys).withColumns({c: unscaled(c, c) for c in columns})
    return out.drop(*parameter_columns(columns))


def inverse_target(df: DataFrame, params: DataFrame, spec: SeriesSpec, columns: list[str]) -> DataFrame:
    """Bring forecasts of the target back to its units; other channels are not needed."""
    target = params.select(*spec.keys, *parameter_columns([spec.value]))
    out = join_on(df, target, spec.keys).withColumns({c: unscaled(c, spec.value) for c in columns})
    return out.drop(*parameter_columns([spec.value]))


def impute_mean(df: DataFrame, spec: SeriesSpec, columns: list[str]) -> DataFrame:
    """Fill NULLs with the mean of the training rows of the same series; needs ``phase``."""
    train = df.where(F.col("phase") == "train")
    means = cut_lineage(train.groupBy(*spec.keys).agg(*[F.avg(c).alias(f"{c}_mean") for c in columns]))
    filled = join_on(df, means, spec.keys, "left").withColumns(
        {c: F.coalesce(F.col(c), F.col(f"{c}_mean")) for c in columns}
    )
    return filled.drop(*[f"{c}_mean" for c in columns])
