"""Overlap merges, pairings, unions, continuous series, payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.operators import merge
from seriesloom.operators.models.horizon import flat_forecast
from seriesloom.operators.position import with_pos
from seriesloom.plans.frames import dirty_items, fixed_forecast, phased
from seriesloom.plans.registry import DAYS, FC, PHASED, cents, query, rounded
from seriesloom.sources.series import PANEL, SHIPMENTS, daily_orders, orders_by_day, shipments

# Flat forecasts of 5 days from every second day: each day is covered by two or three windows.
OVERLAPS = """
    WITH starts AS (SELECT series_id, pos AS origin, n FROM daily WHERE pos <= n - 12 AND pos % 2 = 0),
    lo AS (
      SELECT o.series_id, o.origin, t.ts, t.pos, t.value AS y_true, l.value + 0.01 * o.origin AS yhat
      FROM starts o CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS h)
      JOIN daily l ON l.series_id = o.series_id AND l.pos = o.origin + 6
      JOIN daily t ON t.series_id = o.series_id AND t.pos = o.origin + 6 + h)"""


def overlaps(spark, folder):
    rows = flat_forecast(daily_orders(spark, folder), PANEL, seq_len=7, pred_len=5, step=2)
    return rows.withColumn("yhat", F.col("yhat") + 0.01 * F.col("origin"))


@query("e01_merge_overwrite", OVERLAPS + """
    SELECT series_id, ts, round(avg(y_true), 2) AS y_true, round(arg_max(yhat, origin), 3) AS yhat FROM lo GROUP BY 1, 2""", DAYS)
def merge_overwrite(spark, folder):
    return rounded(merge.merge_overlaps(overlaps(spark, folder), PANEL, "overwrite"), 3, "yhat").withColumn("y_true", F.round("y_true", 2))


@query("e02_merge_mean", OVERLAPS + """
    , folded AS (SELECT series_id, ts, round(avg(y_true), 2) AS y_true, list(yhat ORDER BY origin) AS l FROM lo GROUP BY 1, 2)
    SELECT series_id, ts, y_true, round(CASE len(l) WHEN 1 THEN l[1] WHEN 2 THEN (l[1] + l[2]) / 2
           ELSE ((l[1] + l[2]) / 2 + l[3]) / 2 END, 5) AS yhat FROM folded""", DAYS)
def merge_mean(spark, folder):
    return rounded(merge.merge_overlaps(overlaps(spark, folder), PANEL, "mean"), 5, "yhat").withColumn("y_true", F.round("y_true", 2))


@query("e03_merge_strict_mean", OVERLAPS + """
    SELECT series_id, ts, round(avg(y_true), 2) AS y_true, round(avg(yhat), 4) AS yhat FROM lo GROUP BY 1, 2""", DAYS)
def merge_strict_mean(spark, folder):
    return rounded(merge.merge_overlaps(overlaps(spark, folder), PANEL, "strict_mean"), 4, "yhat").withColumn("y_true", F.round("y_true", 2))


PAIRS = """
    WITH truth AS (SELECT series_id, value AS y_true, row_number() OVER (PARTITION BY series_id ORDER BY ts {0}) - 1 AS rank
                   FROM gaps {1}),
    pred AS (SELECT series_id, yhat, row_number() OVER (PARTITION BY series_id ORDER BY ts {0}) - 1 AS rank FROM fc)
    SELECT series_id, rank, y_true, round(yhat, 3) AS yhat FROM truth JOIN pred USING (series_id, rank)"""


def _sides(spark, folder):
    truth = daily_orders(spark, folder, fill=None).select("series_id", "ts", F.col("value").alias("y_true"))
    return truth, fixed_forecast(spark, folder)


@query("e04_pair_from_head", PAIRS.format("", "WHERE value IS NOT NULL"), FC)
def pair_from_head(spark, folder):
    return rounded(merge.pair_from_head(*_sides(spark, folder), PANEL, "day"), 3, "yhat")


# From the tail, days without orders keep their place.
@query("e05_pair_from_tail", PAIRS.format("DESC", ""), FC)
def pair_from_tail(spark, folder):
    return rounded(merge.pair_from_tail(*_sides(spark, folder), PANEL, "day"), 3, "yhat")


@query("e06_joined_truth", """
    SELECT f.series_id, f.ts, d.value AS validation_y_true, round(f.yhat, 3) AS validation_yhat
    FROM fc f JOIN days d ON f.series_id = d.series_id AND f.ts = d.ts WHERE f.phase = 'val'""", FC)
def joined_truth(spark, folder):
    truth = orders_by_day(spark, folder).withColumnRenamed("value", "y_true")
    val = fixed_forecast(spark, folder).where("phase = 'val'")
    return rounded(merge.join_truth(truth, val, PANEL, "validation"), 3, "validation_yhat")


@query("e07_standard_forecast", """
    SELECT series_id, ts, CAST(NULL AS DOUBLE) AS y_true, x AS yhat FROM numbers""", "dirty numbers")
def standard_forecast(spark, folder):
    return merge.standard_forecast(dirty_items(spark, folder).withColumnRenamed("value", "yhat"), PANEL)


@query("e08_union_with_phase", "SELECT series_id, ts, y_true, round(yhat, 3) AS yhat, phase FROM fc WHERE phase <> 'train'", FC)
def union_with_phase(spark, folder):
    rows = fixed_forecast(spark, folder)
    parts = [rows.where(F.col("phase") == p).select("series_id", "ts", "y_true", "yhat") for p in ("val", "test")]
    return rounded(merge.with_phases(*parts), 3, "yhat")


# Parts that share rows: validation starts two weeks early and test one.
PARTS = """
    WITH train AS (SELECT series_id, ts, y_true FROM fc WHERE phase = 'train'),
    val AS (SELECT series_id, ts, y_true + 1 AS y_true, yhat + 1 AS yhat FROM fc WHERE pos >= n*6//10 - 14 AND pos < n*6//10 + n*2//10),
    test AS (SELECT series_id, ts, y_true + 2 AS y_true, yhat + 2 AS yhat FROM fc WHERE pos >= n*6//10 + n*2//10 - 7),
    truths AS (SELECT *, 0 AS r FROM train UNION ALL SELECT series_id, ts, y_true, 1 FROM val UNION ALL SELECT series_id, ts, y_true, 2 FROM test),
    splice AS (SELECT series_id, max(ts) AS ts, arg_max(y_true, ts) AS yhat FROM train GROUP BY 1),
    preds AS (SELECT *, 0 AS r FROM splice UNION ALL SELECT series_id, ts, yhat, 1 FROM val UNION ALL SELECT series_id, ts, yhat, 2 FROM test)"""


def _parts(spark, folder):
    rows = fixed_forecast(spark, folder)
    columns = ["series_id", "ts", "y_true", "yhat"]
    train_end, val_end = F.expr("n * 6 div 10"), F.expr("n * 6 div 10 + n * 2 div 10")
    shift = lambda df, k: df.select("series_id", "ts", (F.col("y_true") + k).alias("y_true"), (F.col("yhat") + k).alias("yhat"))
    train = rows.where("phase = 'train'").select(*columns)
    val = rows.where((F.col("pos") >= train_end - 14) & (F.col("pos") < val_end))
    return train, shift(val, 1.0), shift(rows.where(F.col("pos") >= val_end - 7), 2.0)


@query("e09_continuous_truth", PARTS + " SELECT series_id, ts, round(arg_max(y_true, r), 2) AS y_true FROM truths GROUP BY 1, 2", FC)
def continuous_truth(spark, folder):
    return rounded(merge.continuous_truth(*_parts(spark, folder), PANEL), 2, "y_true")


@query("e10_continuous_forecast", PARTS + " SELECT series_id, ts, round(arg_max(yhat, r), 3) AS yhat FROM preds GROUP BY 1, 2", FC)
def continuous_forecast(spark, folder):
    return rounded(merge.continuous_forecast(*_parts(spark, folder), PANEL), 3, "yhat")


@query("e11_timeline", PARTS + """
    , ends AS (SELECT series_id, (SELECT max(ts) FROM train t WHERE t.series_id = s.series_id) AS te,
                      (SELECT max(ts) FROM val v WHERE v.series_id = s.series_id) AS ve FROM splice s)
    SELECT series_id, ts, ts <= te AS is_train, ts > te AND ts <= ve AS is_val, ts > ve AS is_test
    FROM (SELECT series_id, ts FROM truths UNION SELECT series_id, ts FROM preds) JOIN ends USING (series_id)""", FC)
def timeline(spark, folder):
    return merge.timeline(*_parts(spark, folder), PANEL)


@query("e12_payload_to_rows", "SELECT series_id, ts, y_true, round(yhat, 3) AS yhat FROM fc", FC)
def payload_to_rows(spark, folder):
    payload = merge.payload_from_rows(fixed_forecast(spark, folder), PANEL)
    # A truth list longer than the others is cut to the shortest.
    longer = payload.withColumn("y_true", F.concat("y_true", F.array(F.lit(0.0))))
    return rounded(merge.rows_from_payload(longer, PANEL), 3, "yhat")


@query("e13_payload", """
    SELECT series_id, pos // 512 AS chunk, string_agg(strftime(ts, '%Y-%m-%d %H:%M:%S'), ',' ORDER BY ts) AS timestamps,
           string_agg(CAST(CAST(round(y_true * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY ts) AS y_true,
           string_agg(CAST(CAST(round(yhat * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY ts) AS yhat FROM fc GROUP BY 1, 2""", FC)
def payload(spark, folder):
    made = merge.payload_from_rows(fixed_forecast(spark, folder), PANEL, chunk=512)
    tenths = F.transform("yhat", lambda v: v * 10)
    return made.withColumn("yhat", tenths).select(
        "series_id", "chunk", F.array_join("timestamps", ",").alias("timestamps"), cents("y_true").alias("y_true"), cents("yhat").alias("yhat")
    )


@query("e13_tail_payload", """
    SELECT series_id, string_agg(strftime(ts, '%Y-%m-%d %H:%M:%S'), ',' ORDER BY ts) AS timestamps,
           string_agg(CAST(CAST(round(y_true * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY ts) AS y_true,
           round(sum(yhat), 3) AS yhat_sum FROM fc WHERE pos >= n - 24 GROUP BY 1""", FC)
def tail_payload(spark, folder):
    made = merge.tail_payload(fixed_forecast(spark, folder), PANEL, 24)
    total = F.aggregate("yhat", F.lit(0.0), lambda a, b: a + b)
    return made.select(
        "series_id", F.array_join("timestamps", ",").alias("timestamps"), cents("y_true").alias("y_true"),
        F.round(total, 3).alias("yhat_sum"),
    )


@query("e14_flags_by_count", """
    SELECT series_id, ts, pos < 1000 AS is_train, pos >= 1000 AND pos < 1300 AS is_val, pos >= 1300 AS is_test FROM daily""", DAYS)
def flags_by_count(spark, folder):
    return daily_orders(spark, folder).withColumns(merge.flags_by_count(1000, 300)).select(
        "series_id", "ts", "is_train", "is_val", "is_test"
    )


@query("e14_flags_by_time", """
    SELECT series_id, ts, ts < v AS is_train, ts >= v AND ts < t AS is_val, ts >= t AS is_test
    FROM phased JOIN (SELECT series_id, min(ts) FILTER (phase = 'val') AS v, min(ts) FILTER (phase = 'test') AS t FROM phased GROUP BY 1)
    USING (series_id)""", PHASED)
def flags_by_time(spark, folder):
    rows = phased(spark, folder)
    starts = rows.groupBy("series_id").agg(
        F.min(F.when(F.col("phase") == "val", F.col("ts"))).alias("v"),
        F.min(F.when(F.col("phase") == "test", F.col("ts"))).alias("t"),
    )
    flags = merge.flags_by_time("ts", F.col("v"), F.col("t"))
    return rows.join(starts, "series_id").withColumns(flags).select("series_id", "ts", "is_train", "is_val", "is_test")


@query("e15_thinned", "SELECT pos, ts, value FROM shipments WHERE pos % greatest(1, n // 4000) = 0", "shipments")
def thinned(spark, folder):
    return merge.thinned(with_pos(shipments(spark, folder), SHIPMENTS)).select("pos", "ts", "value")


@query("e16_extent", "SELECT series_id, min(ts) AS first_ts, max(ts) AS last_ts FROM fc GROUP BY 1", FC)
def extent(spark, folder):
    return merge.extent(PANEL, *_parts(spark, folder))
