"""Scoring events as they arrive with stored one-step coefficients."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from seriesloom.operators.models.ar import one_step
from seriesloom.spec import SeriesSpec


def grid_counts(stream: DataFrame, spec: SeriesSpec, step: str, lateness: str) -> DataFrame:
    """Sum of the values per series and grid step; events later than ``lateness`` are dropped.

    The event time column is a timestamp with zone, as watermarks ask for.
    """
    return (
        stream.withWatermark(spec.time, lateness)
        .groupBy(*spec.keys, F.window(spec.time, step).alias("_window"))
        .agg(F.sum(spec.value).alias(spec.value))
        .select(*spec.keys, F.col("_window.start").alias(spec.time), spec.value)
    )


def score_batch(batch: DataFrame, history: DataFrame, params: DataFrame, spec: SeriesSpec, step_seconds: int, lags: int) -> DataFrame:
    """One-step forecasts for the new grid rows.

    The history that matters are the last ``lags`` steps before the batch; the
    scan skips what is older. Absent steps count as 0.
    """
    keys = list(spec.keys)
    first = batch.agg(F.min(spec.time)).first()[0]
    if first is None:
        return batch.select(*keys, spec.time, F.col(spec.value).alias("y_true"), F.lit(None).cast("double").alias("yhat"))
    history = history.where(F.col(spec.time) >= F.lit(first - timedelta(seconds=step_seconds * lags)))
    new = batch.select(*keys, spec.time, spec.value).withColumn("_new", F.lit(True))
    span = new.groupBy(*keys).agg(F.min(spec.time).alias("_lo"), F.max(spec.time).alias("_hi"))
    start = F.col("_lo") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(step_seconds * lags).cast("decimal(18,6)"))
    width = F.expr(f"INTERVAL '{step_seconds}' SECOND")
    grid = span.select(*keys, F.explode(F.sequence(start, F.col("_hi"), width)).alias(spec.time))
    known = history.select(*keys, spec.time, spec.value).join(new, [*keys, spec.time], "left_anti")
    rows = new.unionByName(known.withColumn("_new", F.lit(False)))
    filled = grid.join(rows, [*keys, spec.time], "left").na.fill(0.0, [spec.value])
    offset = (F.unix_seconds(spec.time) / step_seconds).cast("bigint")
    placed = filled.withColumn("pos", offset)
    scored = one_step(placed, params, spec, lags).where(F.col("_new"))
    return scored.select(*keys, spec.time, F.col(spec.value).alias("y_true"), "yhat")


def score_stream(
    grid: DataFrame, params: DataFrame, spec: SeriesSpec, history_path: str, forecast_path: str, checkpoint: str,
    step_seconds: int, lags: int,
) -> DataStreamWriter:
    """Writer that forecasts each finished grid step and appends it to the history table.

    Both tables get one folder per batch, so a batch that is run again after a
    failure replaces its own rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        earlier = spark.read.parquet(history_path).where(F.col("batch") < batch_id)
        scored = score_batch(batch, earlier, params, spec, step_seconds, lags)
        scored.write.mode("overwrite").parquet(f"{forecast_path}/batch={batch_id}")
        batch.write.mode("overwrite").parquet(f"{history_path}/batch={batch_id}")
        batch.unpersist()

    return grid.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
