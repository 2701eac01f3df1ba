"""Irregular events to a regular grid of one row per step and series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.spec import SeriesSpec

GRID_CHUNK = 100_000


def truncated(time: Column | str, grid: str) -> Column:
    """Start of the grid step, without a time zone."""
    if grid == "day":
        return F.to_date(time).cast("timestamp_ntz")
    return F.date_trunc(grid, time).cast("timestamp_ntz")


def aggregate_to_grid(df: DataFrame, spec: SeriesSpec, grid: str, **measures: Column) -> DataFrame:
    """One row per series and filled grid step; ``measures`` are aggregates named by keyword."""
    step = df.withColumn(spec.time, truncated(spec.time, grid))
    return step.groupBy(*spec.keys, spec.time).agg(*[c.alias(name) for name, c in measures.items()])


def steps_between(start: str, end: str, grid: str) -> Column:
    if grid == "day":
        return F.date_diff(F.col(end), F.col(start)).cast("bigint")
    return F.expr(f"timestampdiff({grid}, {start}, {end})")


def step_after(start: str, steps: str, grid: str) -> Column:
    return F.expr(f"timestampadd({grid}, {steps}, {start})").cast("timestamp_ntz")


def regular_grid(df: DataFrame, spec: SeriesSpec, grid: str) -> DataFrame:
    """All steps from the first to the last time of each series, with ``pos`` and ``n``.

    Positions are generated in bounded chunks, so a long series is spread over
    many tasks instead of being built as one array.
    """
    keys = list(spec.keys)
    ends = df.groupBy(*keys).agg(F.min(spec.time).alias("_lo"), F.max(spec.time).alias("_hi"))
    sized = ends.withColumn("n", steps_between("_lo", "_hi", grid) + 1)
    chunks = sized.withColumn("_from", F.explode(F.expr(f"sequence(0L, n - 1, {GRID_CHUNK}L)")))
    spread = chunks.repartition(*keys, "_from")
    last = F.least(F.col("n") - 1, F.col("_from") + (GRID_CHUNK - 1))
    return spread.withColumn("pos", F.explode(F.sequence(F.col("_from"), last))).select(
        *keys, step_after("_lo", "pos", grid).alias(spec.time), "pos", "n"
    )


def fill_grid(df: DataFrame, spec: SeriesSpec, grid: str, fill: float | None = None) -> DataFrame:
    """Insert the missing steps; their numbers are NULL, or ``fill`` where it is given."""
    full = regular_grid(df, spec, grid).join(df, [*spec.keys, spec.time], "left")
    return full if fill is None else full.na.fill(fill, [c for c in df.columns if c not in (*spec.keys, spec.time)])
