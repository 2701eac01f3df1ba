"""Phases, folds, origins."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.operators import split
from seriesloom.operators.position import with_pos
from seriesloom.operators.windows import supervised_windows, target_phase
from seriesloom.plans.frames import fixed_forecast
from seriesloom.plans.registry import DAYS, FC, PHASED, query
from seriesloom.sources.series import PANEL, SHIPMENTS, daily_orders, orders_by_day, shipments

PLACE = ("series_id", "ts", "pos")


@query("d01_phase_from_tail", """
    SELECT series_id, ts, pos, CASE WHEN pos < n - nt - nv THEN 'train' WHEN pos < n - nt THEN 'val' ELSE 'test' END AS phase
    FROM (SELECT *, CAST(round_even(n * 0.15::DOUBLE, 0) AS BIGINT) AS nt, CAST(round_even(n * 0.25::DOUBLE, 0) AS BIGINT) AS nv FROM daily)""", DAYS)
def phase_from_tail(spark, folder):
    return daily_orders(spark, folder).select(*PLACE, split.phase_from_tail(0.15, 0.25).alias("phase"))


@query("d01_shipment_phases", """
    SELECT pos, CASE WHEN pos < n - 2 * k THEN 'train' WHEN pos < n - k THEN 'val' ELSE 'test' END AS phase
    FROM (SELECT pos, n, CAST(round_even(n * 0.2::DOUBLE, 0) AS BIGINT) AS k FROM shipments)""", "shipments")
def shipment_phases(spark, folder):
    return with_pos(shipments(spark, folder), SHIPMENTS).select("pos", split.phase_from_tail().alias("phase"))


@query("d02_phase_from_head", "SELECT series_id, ts, pos, phase FROM phased", PHASED)
def phase_from_head(spark, folder):
    return daily_orders(spark, folder).select(*PLACE, split.phase_from_head().alias("phase"))


@query("d03_phase_rounded", """
    SELECT series_id, ts, pos, CASE WHEN pos < a THEN 'train' WHEN pos < a + b THEN 'val' ELSE 'test' END AS phase
    FROM (SELECT *, greatest(1, CAST(round_even(n * 0.6::DOUBLE, 0) AS BIGINT)) AS a, CAST(round_even(n * 0.2::DOUBLE, 0) AS BIGINT) AS b FROM ranked_days)""",
    "days ranked_days")
def phase_rounded(spark, folder):
    days = with_pos(orders_by_day(spark, folder), PANEL, "day")
    return days.select(*PLACE, split.phase_rounded().alias("phase"))


@query("d04_two_way", "SELECT series_id, ts, pos, CASE WHEN pos < n * 8 // 10 THEN 'train' ELSE 'test' END AS phase FROM ranked_days", "days ranked_days")
def two_way(spark, folder):
    days = with_pos(orders_by_day(spark, folder), PANEL, "day")
    return days.select(*PLACE, split.phase_two_way().alias("phase"))


@query("d05_expanding_folds", """
    SELECT series_id, fold, role, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts, sum(pos) AS pos_sum FROM (
      SELECT series_id, ts, pos, fold, CASE WHEN pos < n - (6 - fold) * b THEN 'fit' WHEN pos < n - (5 - fold) * b THEN 'eval' END AS role
      FROM (SELECT *, n // 6 AS b FROM daily) CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS fold))
    WHERE role IS NOT NULL GROUP BY 1, 2, 3""", DAYS)
def expanding_folds(spark, folder):
    folds = split.expanding_folds(daily_orders(spark, folder))
    return folds.groupBy("series_id", "fold", "role").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum("pos").alias("pos_sum")
    )


@query("d06_target_phase", """
    SELECT series_id, pos - 10 AS origin, ts AS target_ts, phase FROM phased WHERE pos >= 10""", PHASED)
def target_phases(spark, folder):
    windows = supervised_windows(daily_orders(spark, folder), PANEL, 10)
    placed = target_phase(windows, 10, split.phase_from_head())
    return placed.select("series_id", "origin", F.expr("ts + INTERVAL 1 DAY").alias("target_ts"), "phase")


@query("d07_rolling_origins", """
    SELECT series_id, pos AS origin, ts FROM daily WHERE CASE WHEN n >= 42 THEN pos % 7 = 0 AND pos <= n - 42 ELSE pos = 0 END""", DAYS)
def rolling_origins(spark, folder):
    return split.rolling_origins(daily_orders(spark, folder), PANEL, 42, 7).drop("n")


@query("d08_tail_origin", "SELECT series_id, pos AS origin, ts FROM daily WHERE pos = greatest(0, n - 42)", DAYS)
def tail_origin(spark, folder):
    return split.rolling_origins(daily_orders(spark, folder), PANEL, 42, 7, from_tail=True).drop("n")


@query("d09_refit_schedule", """
    SELECT series_id, ts, phase, step, (step // 3) * 3 AS refit_at FROM (
      SELECT series_id, ts, phase, row_number() OVER (PARTITION BY series_id, phase ORDER BY ts) - 1 AS step
      FROM phased WHERE phase <> 'train')""", PHASED)
def refit_schedule(spark, folder):
    rows = daily_orders(spark, folder).withColumn("phase", split.phase_from_head()).where("phase <> 'train'")
    starts = rows.groupBy("series_id", "phase").agg(F.min("pos").alias("start"))
    stepped = rows.join(starts, ["series_id", "phase"]).withColumn("step", F.col("pos") - F.col("start"))
    return stepped.select("series_id", "ts", "phase", "step", split.refit_origin(3).alias("refit_at"))


@query("d10_phase_by_length", """
    SELECT series_id, ts, CASE WHEN pos < n - v - t THEN 'train' WHEN pos < n - t THEN 'val' ELSE 'test' END AS phase
    FROM ranked_days JOIN (SELECT series_id, count_if(phase = 'val') AS v, count_if(phase = 'test') AS t FROM phased GROUP BY 1) USING (series_id)""",
    f"{PHASED} ranked_days")
def phase_by_length(spark, folder):
    phases = daily_orders(spark, folder).withColumn("phase", split.phase_from_head())
    sizes = phases.groupBy("series_id").agg(
        F.count_if(F.col("phase") == "val").alias("v"), F.count_if(F.col("phase") == "test").alias("t")
    )
    days = with_pos(orders_by_day(spark, folder), PANEL, "day").join(sizes, "series_id")
    return days.select("series_id", "ts", split.phase_by_length("v", "t").alias("phase"))


@query("d11_only_phase", """
    SELECT series_id, ts, 'labelled' AS kind FROM fc WHERE phase = 'val'
    UNION ALL SELECT series_id, ts, 'by share' FROM daily WHERE pos < n * 8 // 10""", FC)
def only_phase(spark, folder):
    labelled = split.only_phase(fixed_forecast(spark, folder), "val").select("series_id", "ts", F.lit("labelled").alias("kind"))
    shared = split.only_phase(daily_orders(spark, folder), "val").select("series_id", "ts", F.lit("by share").alias("kind"))
    return labelled.unionByName(shared)
