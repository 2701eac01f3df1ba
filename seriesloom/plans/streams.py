"""Scoring a stream of events with stored coefficients."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.operators.gram import gram, regress
from seriesloom.operators.models import ar
from seriesloom.plans.linear_sql import inner, least_squares
from seriesloom.plans.registry import query, rounded
from seriesloom.sources.resample import aggregate_to_grid, fill_grid
from seriesloom.sources.series import EVENTS, table
from seriesloom.session import run_folder
from seriesloom.sources.sink import write_params
from seriesloom.streaming.keyed import score_keyed, use_keyed_state
from seriesloom.streaming.score import grid_counts, score_stream

CUT = "2024-01-16"


FORECAST = f"""
    WITH filled AS (SELECT g.series_id, g.ts, coalesce(value, 0) AS value FROM (
        SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM event_days GROUP BY 1) g
      LEFT JOIN event_days d ON g.series_id = d.series_id AND g.ts = d.ts),
    design AS (SELECT * FROM (SELECT series_id, ts, value, [1, lag(value) OVER w, lag(value, 2) OVER w, value] AS x, lag(value, 2) OVER w AS old
      FROM filled WINDOW w AS (PARTITION BY series_id ORDER BY ts)) WHERE old IS NOT NULL),
    train AS (SELECT * FROM design WHERE ts < TIMESTAMP '{CUT}'),
    """ + least_squares("train", "series_id", "f", "1") + f"""
    SELECT series_id, ts, value AS y_true, round({inner('b', 'x')}, 4) AS yhat FROM design JOIN f USING (series_id)
    WHERE ts >= TIMESTAMP '{CUT}' AND ts + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 12 HOUR FROM events)
      AND value <> 0"""


def _stored_fit(spark, folder):
    """Daily sums before the cut, and the coefficients fitted on them as a stored table."""
    events = table(spark, folder, "events").select(F.col("event_type").alias("series_id"), "ts", "value")
    amount = F.sum(F.col("value").cast("decimal(18,2)")).cast("double")
    past = fill_grid(aggregate_to_grid(events.where(F.col("ts") < CUT), EVENTS, "day", value=amount), EVENTS, "day", 0.0)
    columns = ["one", "lag_1", "lag_2", "value"]
    fitted = regress(gram(ar.lag_rows(past, EVENTS, 2), ["series_id"], columns), ["series_id"], columns, columns[:-1], "value", 1.0)
    base = run_folder(spark, "stream")
    params = spark.read.parquet(write_params(fitted.select("series_id", "betas"), f"{base}/params", columns[:-1]))
    return past.select("series_id", F.col("ts").cast("timestamp").alias("ts"), "value"), params, base


def _arriving(spark, folder):
    arriving = spark.readStream.schema(table(spark, folder, "events").schema).parquet(f"{folder}/events*.parquet")
    return arriving.where(F.col("ts") >= CUT).select(
        F.col("event_type").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("decimal(18,2)").alias("value")
    )


def _as_rows(scored):
    return rounded(scored.withColumn("ts", F.col("ts").cast("timestamp_ntz")), 4, "yhat").select("series_id", "ts", "y_true", "yhat")


@query("x01_stream_forecast", FORECAST, "event_days")
def stream_forecast(spark, folder):
    """History before the cut gives coefficients; later events arrive as a stream of two-decimal amounts."""
    stored, params, base = _stored_fit(spark, folder)
    stored.write.parquet(f"{base}/history/batch=-1")
    daily = grid_counts(_arriving(spark, folder), EVENTS, "1 day", "12 hours").withColumn("value", F.col("value").cast("double"))
    writer = score_stream(daily, params, EVENTS, f"{base}/history", f"{base}/forecast", f"{base}/checkpoint", 86_400, 2)
    writer.trigger(availableNow=True).start().awaitTermination()
    return _as_rows(spark.read.parquet(f"{base}/forecast"))


@query("x01_keyed_stream_forecast", FORECAST, "event_days")
def keyed_stream_forecast(spark, folder):
    """The same with the last values of each series as keyed state."""
    use_keyed_state(spark)
    stored, params, base = _stored_fit(spark, folder)
    scored = score_keyed(_arriving(spark, folder), params, EVENTS, "1 day", 86_400, "12 hours", 2, stored)
    writer = scored.writeStream.outputMode("append").option("checkpointLocation", f"{base}/checkpoint").format("parquet")
    writer.option("path", f"{base}/forecast").trigger(availableNow=True).start().awaitTermination()
    return _as_rows(spark.read.parquet(f"{base}/forecast"))
