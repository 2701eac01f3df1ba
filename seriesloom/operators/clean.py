"""Filtering, filling, clipping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.operators.keys import join_on
from seriesloom.functions.calendar import date_parts
from seriesloom.functions.columns import clipped, finite, number
from seriesloom.operators.position import fill_backward, fill_forward, with_pos
from seriesloom.session import cut_lineage
from seriesloom.spec import SeriesSpec


def clean_values(df: DataFrame, value: str) -> DataFrame:
    """Read the target as a number and keep the rows where it is finite."""
    return df.withColumn(value, number(value)).where(F.col(value).isNotNull())


def drop_incomplete(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drop rows with a NULL in any of the columns (all by default)."""
    return df.na.drop(subset=columns)


def drop_repeats(df: DataFrame) -> DataFrame:
    """Drop rows equal in every column."""
    return df.dropDuplicates()


def keep_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """The present ones of ``columns``, each once, in the given order."""
    return df.select(*[c for c in dict.fromkeys(columns) if c in df.columns])


def series_mean(df: DataFrame, spec: SeriesSpec, column: str, name: str = "_mean") -> DataFrame:
    """Add the mean of the column over the series."""
    return join_on(df, cut_lineage(df.groupBy(*spec.keys).agg(F.avg(column).alias(name))), spec.keys)


def fill_missing(df: DataFrame, spec: SeriesSpec, method: str | float | None, columns: list[str] | None = None) -> DataFrame:
    """Replace NULLs.

    ``ffill``, ``bfill`` and ``both`` (forward, then backward) follow the series
    order and need ``pos``; ``mean`` fills the target only; ``zero`` and a number
    are constants; ``None`` leaves the frame as it is.
    """
    columns = columns or spec.columns
    match method:
        case None:
            return df
        case "ffill":
            return fill_forward(df, spec, columns)
        case "bfill":
            return fill_backward(df, spec, columns)
        case "both":
            return fill_backward(fill_forward(df, spec, columns), spec, columns)
        case "mean":
            filled = F.coalesce(F.col(spec.value), F.col("_mean"))
            return series_mean(df, spec, spec.value).withColumn(spec.value, filled).drop("_mean")
        case "zero":
            return df.na.fill(0.0, columns)
        case int() | float():
            return df.na.fill(float(method), columns)
    raise ValueError(f"unknown fill method {method!r}")


def clip_values(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    return df.withColumn(value, clipped(value, low, high))


def clip_sigma(df: DataFrame, spec: SeriesSpec, width: float = 3.0) -> DataFrame:
    """Limit the target to its series mean plus or minus ``width`` population deviations."""
    moments = cut_lineage(
        df.groupBy(*spec.keys).agg(F.avg(spec.value).alias("_mean"), F.stddev_pop(spec.value).alias("_std"))
    )
    low, high = F.col("_mean") - width * F.col("_std"), F.col("_mean") + width * F.col("_std")
    limited = clipped(spec.value, low, high)
    return join_on(df, moments, spec.keys).withColumn(spec.value, limited).drop("_mean", "_std")


def read_numbers(df: DataFrame, exclude: list[str]) -> DataFrame:
    """Read every text or numeric column but the excluded ones as a finite number."""
    readable = [
        f.name for f in df.schema.fields
        if f.name not in exclude and isinstance(f.dataType, (T.StringType, T.NumericType))
    ]
    return df.withColumns({c: number(c) for c in readable})


def preprocess(
    df: DataFrame,
    spec: SeriesSpec,
    fill: str | float | None = "ffill",
    clip_range: tuple[float, float] | None = None,
    sigma: float | None = None,
    drop_duplicates: bool = True,
    calendar: bool = True,
    grid: str | None = None,
) -> DataFrame:
    """Column subset, duplicates, fill, clip, calendar parts, numbers: one chain.

    Positions make rows differ, so rows are compared without them and numbered
    anew; ``grid`` is that of :func:`with_pos`.
    """
    extra = [c for c in ("pos", "n") if c in df.columns]
    out = keep_columns(df, [*spec.keys, spec.time, *spec.columns, *spec.ties])
    if drop_duplicates:
        out = drop_repeats(out)
        out = with_pos(out, spec, grid) if extra else out
    else:
        out = keep_columns(df, [*out.columns, *extra])
    out = out.withColumns({c: finite(c) for c in spec.columns})
    out = fill_missing(out, spec, fill)
    out = clip_values(out, spec.value, *clip_range) if clip_range else out
    out = clip_sigma(out, spec, sigma) if sigma else out
    out = out.withColumns(date_parts(spec.time)) if calendar else out
    return read_numbers(out, [*spec.keys, spec.time, *spec.ties, *extra])
