"""Overlap merges, pairings, unions and continuous series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.columns import number, timestamp
from seriesloom.operators.position import block_of, with_pos
from seriesloom.session import cut_lineage
from seriesloom.spec import SeriesSpec

# Time column names accepted in a forecast table.
FORECAST_TIME_NAMES = ("timestamp", "ts", "date", "time", "ds")


def merge_overlaps(df: DataFrame, spec: SeriesSpec, mode: str = "overwrite") -> DataFrame:
    """One forecast per series and time from overlapping windows with distinct ``origin``.

    ``overwrite`` keeps the latest origin, ``mean`` halves the way towards each
    later origin in turn, ``strict_mean`` is the arithmetic mean. A time is
    covered by at most horizon / step windows, so the lists here stay short.
    """
    match mode:
        case "overwrite":
            merged = F.max_by("yhat", F.when(F.col("yhat").isNotNull(), F.col("origin")))
        case "mean":
            ordered = F.array_sort(F.collect_list(F.when(F.col("yhat").isNotNull(), F.struct("origin", "yhat"))))
            halfway = lambda so_far, window: F.coalesce((so_far + window["yhat"]) / 2, window["yhat"])
            merged = F.aggregate(ordered, F.lit(None).cast("double"), halfway)
        case "strict_mean":
            merged = F.avg("yhat")
        case _:
            raise ValueError(f"unknown merge mode {mode!r}")
    return df.groupBy(*spec.keys, spec.time).agg(F.avg("y_true").alias("y_true"), merged.alias("yhat"))


def pair_from_head(truth: DataFrame, forecast: DataFrame, spec: SeriesSpec, grid: str) -> DataFrame:
    """Pair the i-th finite truth with the i-th finite forecast, up to the shorter side."""
    return _paired(truth, forecast, spec, grid, F.col("pos"), finite_only=True)


def pair_from_tail(truth: DataFrame, forecast: DataFrame, spec: SeriesSpec, grid: str) -> DataFrame:
    """Pair the last truth with the last forecast and so on backwards; missing values keep their place."""
    return _paired(truth, forecast, spec, grid, F.col("n") - 1 - F.col("pos"), finite_only=False)


def _paired(truth: DataFrame, forecast: DataFrame, spec: SeriesSpec, grid: str, rank: Column, finite_only: bool) -> DataFrame:
    def side(df: DataFrame, column: str) -> DataFrame:
        usable = df.select(*spec.keys, spec.time, number(column).alias(column))
        usable = usable.where(F.col(column).isNotNull()) if finite_only else usable
        return with_pos(usable, spec, grid).select(*spec.keys, rank.alias("rank"), column)

    return side(truth, "y_true").join(side(forecast, "yhat"), [*spec.keys, "rank"])


def join_truth(truth: DataFrame, forecast: DataFrame, spec: SeriesSpec, prefix: str | None = None) -> DataFrame:
    """Truth and forecast of the same series and time, optionally with prefixed names."""
    both = truth.select(*spec.keys, spec.time, "y_true").join(
        forecast.select(*spec.keys, spec.time, "yhat"), [*spec.keys, spec.time]
    )
    return both.withColumnsRenamed({c: f"{prefix}_{c}" for c in ("y_true", "yhat")}) if prefix else both


def standard_forecast(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Any forecast table as keys, time, ``y_true`` and ``yhat``; absent numbers are NULL."""
    time = next((c for c in (spec.time, *FORECAST_TIME_NAMES) if c in df.columns), None)
    if time is None:
        raise ValueError(f"no time column in {df.columns}")
    numbers = [
        (number(c) if c in df.columns else F.lit(None).cast("double")).alias(c) for c in ("y_true", "yhat")
    ]
    return df.select(*spec.keys, timestamp(time).alias(spec.time), *numbers)


def display(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Only keys, time, truth and forecast."""
    return df.select(*[c for c in (*spec.keys, spec.time, "y_true", "yhat") if c in df.columns])


def with_phases(val: DataFrame, test: DataFrame) -> DataFrame:
    """Both results under each other with a ``phase`` label."""
    return val.withColumn("phase", F.lit("val")).unionByName(test.withColumn("phase", F.lit("test")))


def _segments(spec: SeriesSpec, column: str, *parts: DataFrame) -> DataFrame:
    union = None
    for rank, part in enumerate(parts):
        one = part.select(*spec.keys, spec.time, F.col(column).alias("y"), F.lit(rank).alias("_rank"))
        one = one.where(F.col("y").isNotNull())
        union = one if union is None else union.unionByName(one)
    return union


def _latest_segment(parts: DataFrame, spec: SeriesSpec, name: str) -> DataFrame:
    return parts.groupBy(*spec.keys, spec.time).agg(F.max_by("y", "_rank").alias(name))


def continuous_truth(train: DataFrame, val: DataFrame, test: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Truth of all phases; where they share a time the later phase counts."""
    return _latest_segment(_segments(spec, "y_true", train, val, test), spec, "y_true")


def continuous_forecast(train: DataFrame, val: DataFrame, test: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Forecasts of both phases, starting from the last training value."""
    known = train.where(F.col("y_true").isNotNull())
    splice = known.groupBy(*spec.keys).agg(
        F.max_by("y_true", spec.time).alias("yhat"), F.max(spec.time).alias(spec.time)
    )
    return _latest_segment(_segments(spec, "yhat", splice, val, test), spec, "yhat")


def timeline(train: DataFrame, val: DataFrame, test: DataFrame, spec: SeriesSpec) -> DataFrame:
    """All times of truth and forecast with three phase flags cut at the last train and validation times."""
    keys = list(spec.keys)
    truth = continuous_truth(train, val, test, spec).select(*keys, spec.time)
    forecast = continuous_forecast(train, val, test, spec).select(*keys, spec.time)
    last = lambda part, name: part.where(F.col("y_true").isNotNull()).groupBy(*keys).agg(F.max(spec.time).alias(name))
    ends = cut_lineage(last(train, "_train_end").join(last(val, "_val_end"), keys, "full"))
    moment, train_end = F.col(spec.time), F.col("_train_end")
    val_end = F.coalesce("_val_end", "_train_end")
    no = F.lit(False)
    return (
        truth.union(forecast).distinct().join(ends, keys, "left")
        .withColumns(
            {
                "is_train": F.coalesce(moment <= train_end, no),
                "is_val": F.coalesce((moment > train_end) & (moment <= val_end), no),
                "is_test": F.coalesce(moment > val_end, no),
            }
        )
        .drop("_train_end", "_val_end")
    )


def rows_from_payload(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Rows from three parallel arrays, cut to the shortest; unreadable numbers become NULL."""
    size = F.least(F.size("timestamps"), F.size("y_true"), F.size("yhat"))
    zipped = F.arrays_zip(*[F.slice(c, F.lit(1), size).alias(c) for c in ("timestamps", "y_true", "yhat")])
    rows = df.where(size > 0).select(*spec.keys, F.inline(zipped))
    return rows.select(*spec.keys, timestamp("timestamps").alias(spec.time), number("y_true").alias("y_true"), number("yhat").alias("yhat"))


def payload_from_rows(df: DataFrame, spec: SeriesSpec, chunk: int = 4096) -> DataFrame:
    """Three parallel arrays per series and ``chunk`` consecutive positions, in time order; needs ``pos``."""
    return _payload(df.withColumn("chunk", block_of(chunk)), spec, ["chunk"])


def tail_payload(df: DataFrame, spec: SeriesSpec, k: int) -> DataFrame:
    """Three parallel arrays with the last ``k`` rows of each series; needs ``pos`` and ``n``."""
    return _payload(df.where(F.col("pos") >= F.col("n") - k), spec, [])


def _payload(df: DataFrame, spec: SeriesSpec, extra: list[str]) -> DataFrame:
    row = F.struct("pos", F.date_format(spec.time, "yyyy-MM-dd HH:mm:ss").alias("t"), "y_true", "yhat")
    rows = F.array_sort(F.collect_list(row))
    grouped = df.groupBy(*spec.keys, *extra).agg(rows.alias("_rows"))
    return grouped.select(
        *spec.keys, *extra, F.col("_rows.t").alias("timestamps"), F.col("_rows.y_true").alias("y_true"), F.col("_rows.yhat").alias("yhat")
    )


def flags_by_count(n_train: Column | int, n_val: Column | int) -> dict[str, Column]:
    """Phase flags from row counts; rows beyond them are test."""
    pos = F.col("pos")
    train, val = (F.greatest(x if isinstance(x, Column) else F.lit(x), F.lit(0)) for x in (n_train, n_val))
    return {"is_train": pos < train, "is_val": (pos >= train) & (pos < train + val), "is_test": pos >= train + val}


def flags_by_time(time: str, val_start: Column, test_start: Column) -> dict[str, Column]:
    """Phase flags from the start times of the later phases; a missing start means no such phase."""
    t, no = F.col(time), F.lit(False)
    later = F.coalesce(val_start, test_start)
    return {
        "is_train": F.coalesce(t < val_start, F.lit(True)),
        "is_val": F.coalesce((t >= val_start) & F.coalesce(t < test_start, F.lit(True)), no) & later.isNotNull(),
        "is_test": F.coalesce(t >= test_start, no),
    }


def thinned(df: DataFrame, max_points: int = 4000) -> DataFrame:
    """Every k-th row, so that about ``max_points`` remain per series; needs ``pos`` and ``n``."""
    every = F.greatest(F.expr(f"n div {max_points}"), F.lit(1))
    return df.where(F.col("pos") % every == 0)


def extent(spec: SeriesSpec, *parts: DataFrame) -> DataFrame:
    """First and last time over all parts, per series."""
    spans = None
    for part in parts:
        span = part.groupBy(*spec.keys).agg(F.min(spec.time).alias("first_ts"), F.max(spec.time).alias("last_ts"))
        spans = span if spans is None else spans.unionByName(span)
    return spans.groupBy(*spec.keys).agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
