"""Sources, cleaning, quality, resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.functions.columns import finite_array, number, timestamp
from seriesloom.operators import clean, quality, scale
from seriesloom.operators.merge import display
from seriesloom.operators.metrics import first_k
from seriesloom.operators.position import first_rows, last_rows, with_pos
from seriesloom.operators.split import phase_from_head
from seriesloom.plans.frames import dirty_items, fixed_forecast, phased
from seriesloom.plans.registry import DAYS, FC, PHASED, query, rounded
from seriesloom.session import run_folder
from seriesloom.sources import reader, sink
from seriesloom.sources.series import (
    EVENTS, PANEL, SHIPMENTS, daily_events, daily_orders, hourly_users, orders_by_day, shipments, table,
)

ITEM = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("a01_csv_source", "SELECT series_id, ts, value FROM days", "days")
def csv_source(spark, folder):
    days = orders_by_day(spark, folder).select("series_id", F.date_format("ts", "yyyy-MM-dd").alias("date"), "value")
    path = sink.write_forecast(days, run_folder(spark, "source"), "csv", by_phase=False)
    return reader.read_csv(spark, path, keys=("series_id",)).withColumnRenamed("date", "ts")


@query("a01_typed_source", "SELECT series_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, ts, x AS value FROM numbers WHERE ts IS NOT NULL", "dirty numbers")
def typed_source(spark, folder):
    raw = dirty_items(spark, folder)
    time, value = reader.resolve_time(raw), reader.resolve_value(raw)
    return reader.typed(raw, time, value, ("series_id", *ITEM)).withColumnRenamed("date", "ts")


@query("a02_a03_resolved_roles", """
    SELECT 'Timestamp' AS time_name, 'event_id' AS value_name, min(ts) AS first_time, count(event_id) AS n_values
    FROM events""")
def resolved_roles(spark, folder):
    events = table(spark, folder, "events").withColumnRenamed("ts", "Timestamp")
    time, value = reader.resolve_time(events), reader.resolve_value(events, "amount")
    return events.agg(
        F.lit(time).alias("time_name"), F.lit(value).alias("value_name"),
        F.min(time).alias("first_time"), F.count(value).alias("n_values"),
    )


@query("a04_detected_columns", """
    SELECT 'value' AS target, 'event_id,user_id,event_type,props' AS features, count(value) AS n_targets,
           CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events""")
def detected_columns(spark, folder):
    events = table(spark, folder, "events").withColumnRenamed("ts", "event_timestamp")
    features, target = reader.detect_columns(events)
    return events.agg(
        F.lit(target).alias("target"), F.lit(",".join(features)).alias("features"), F.count(target).alias("n_targets"),
        F.sum(F.col(target).cast("decimal(18,2)")).cast("double").alias("total"),
    )


@query("a05_selected_features", "SELECT ts, value, event_id, user_id FROM events")
def selected_features(spark, folder):
    events = table(spark, folder, "events")
    return events.select("ts", *reader.select_features(events, EVENTS))


@query("a06_zero_filled_features", "SELECT series_id, ts, value, n_orders, 0.0::DOUBLE AS temperature FROM days", "days")
def zero_filled_features(spark, folder):
    return reader.with_features(orders_by_day(spark, folder), ["value", "n_orders", "temperature"])


@query("a07_forecast_sink", "SELECT series_id, ts, phase, y_true, round(yhat, 4) AS yhat FROM fc", FC)
def forecast_sink(spark, folder):
    rows = fixed_forecast(spark, folder).select("series_id", "ts", "phase", "y_true", "yhat")
    stored = spark.read.parquet(sink.write_forecast(rows, run_folder(spark, "forecast")))
    return rounded(stored.withColumn("phase", F.col("phase").cast("string")), 4, "yhat")


@query("a08_display", "SELECT series_id, ts, y_true, round(yhat, 4) AS yhat FROM fc", FC)
def display_rows(spark, folder):
    return rounded(display(fixed_forecast(spark, folder), PANEL), 4, "yhat")


@query("a09_preview", """
    SELECT series_id, ts, value, pos, CASE WHEN pos < 10 THEN 'head' ELSE 'tail' END AS part
    FROM ranked_days WHERE pos < 10 OR pos >= n - 200""", "days ranked_days")
def preview(spark, folder):
    days = with_pos(orders_by_day(spark, folder), PANEL, "day")
    rows = days.where((F.col("pos") < 10) | (F.col("pos") >= F.col("n") - 200))
    return rows.select("series_id", "ts", "value", "pos", F.when(F.col("pos") < 10, "head").otherwise("tail").alias("part"))


@query("t02_shipments_head_tail", """
    SELECT ts, value, l_orderkey, l_linenumber, pos FROM shipments WHERE pos < 10 OR pos >= n - 200""", "shipments")
def shipments_head_tail(spark, folder):
    rows = with_pos(shipments(spark, folder), SHIPMENTS)
    return first_rows(rows, SHIPMENTS, 10).unionByName(last_rows(rows, SHIPMENTS, 200)).select(
        "ts", "value", "l_orderkey", "l_linenumber", "pos"
    )


@query("t02_top_days", """
    SELECT series_id, ts, value FROM days
    QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY value DESC, ts) <= 5""", "days")
def top_days(spark, folder):
    return first_k(orders_by_day(spark, folder), ["series_id"], [F.desc("value"), F.asc("ts")], 5).select("series_id", "ts", "value")


@query("a10_a11_stored_scaler", """
    SELECT series_id, round(m, 4) AS value_mean, round(s, 4) AS value_std,
           round(mo, 8) AS n_orders_mean, round(so, 8) AS n_orders_std FROM scaler""", f"{PHASED} scaler")
def stored_scaler(spark, folder):
    params = scale.fit_scaler(phased(spark, folder), PANEL)
    path = sink.write_params(params, run_folder(spark, "scaler"), PANEL.columns)
    stored = sink.read_params(spark, path, PANEL.columns)
    return rounded(rounded(stored, 4, "value_mean", "value_std"), 8, "n_orders_mean", "n_orders_std")


@query("c01_parsed_times", "SELECT series_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, ts FROM numbers WHERE ts IS NOT NULL", "dirty numbers")
def parsed_times(spark, folder):
    parsed = dirty_items(spark, folder).withColumn("ts", timestamp("date"))
    return parsed.where(F.col("ts").isNotNull()).select("series_id", *ITEM, "ts")


@query("c02_checked_columns", "SELECT series_id, ts, value FROM days", "days")
def checked_columns(spark, folder):
    text = orders_by_day(spark, folder).withColumn("ts", F.date_format("ts", "yyyy-MM-dd"))
    return reader.check_columns(text, "ts", "value").select("series_id", "ts", "value")


@query("c03_ordered_shipments", "SELECT pos, ts, l_orderkey, l_linenumber, l_partkey, value FROM shipments", "shipments")
def ordered_shipments(spark, folder):
    return with_pos(shipments(spark, folder), SHIPMENTS).select("pos", "ts", "l_orderkey", "l_linenumber", "l_partkey", "value")


@query("c03_ordered_days", "SELECT series_id, ts, pos, n FROM ranked_days", "days ranked_days")
def ordered_days(spark, folder):
    return with_pos(orders_by_day(spark, folder), PANEL, "day").select("series_id", "ts", "pos", "n")


@query("c04_c05_numbers", "SELECT series_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, x FROM numbers", "dirty numbers")
def numbers(spark, folder):
    return dirty_items(spark, folder).select("series_id", *ITEM, number("value").alias("x"))


@query("c06_complete_rows", """
    SELECT series_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, x AS value, ts
    FROM numbers WHERE x IS NOT NULL AND ts IS NOT NULL""", "dirty numbers")
def complete_rows(spark, folder):
    read = dirty_items(spark, folder).withColumn("ts", timestamp("date")).drop("date")
    return clean.drop_incomplete(clean.clean_values(read, "value"), ["ts"])


@query("c07_fill_both_ways", """
    SELECT series_id, ts, pos, coalesce(
        last_value(value IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value(value IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value
    FROM gaps WINDOW w AS (PARTITION BY series_id ORDER BY ts)""", "days grid gaps")
def fill_both_ways(spark, folder):
    return clean.fill_missing(daily_orders(spark, folder, fill=None), PANEL, "both", ["value"]).select(
        "series_id", "ts", "pos", "value"
    )


@query("c07_fill_shipments", """
    SELECT pos, coalesce(
        last_value(value IGNORE NULLS) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value(value IGNORE NULLS) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value
    FROM (SELECT pos, CASE WHEN l_discount > 0.02 AND l_returnflag = 'R' THEN value END AS value FROM shipments)""", "shipments")
def fill_shipments(spark, folder):
    known = F.when((F.col("l_discount") > 0.02) & (F.col("l_returnflag") == "R"), F.col("value"))
    rows = with_pos(shipments(spark, folder), SHIPMENTS).withColumn("value", known)
    return clean.fill_missing(rows, SHIPMENTS, "both").select("pos", "value")


@query("c08_fill_strategies", """
    SELECT series_id, ts,
        last_value(value IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ffill,
        first_value(value IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bfill,
        coalesce(value, 0) AS zero, coalesce(value, -1) AS constant,
        round(coalesce(value, avg(value) OVER (PARTITION BY series_id)), 3) AS mean
    FROM gaps WINDOW w AS (PARTITION BY series_id ORDER BY ts)""", "days grid gaps")
def fill_strategies(spark, folder):
    gaps = daily_orders(spark, folder, fill=None)
    copies = gaps.select(
        "series_id", "ts", "pos", "n", "value", *[F.col("value").alias(c) for c in ("ffill", "bfill", "zero", "constant")]
    )
    out = clean.fill_missing(copies, PANEL, "ffill", ["ffill"])
    out = clean.fill_missing(out, PANEL, "bfill", ["bfill"])
    out = clean.fill_missing(out, PANEL, "zero", ["zero"])
    out = clean.fill_missing(out, PANEL, -1.0, ["constant"])
    out = clean.fill_missing(out, PANEL, "mean")
    return out.select("series_id", "ts", "ffill", "bfill", "zero", "constant", F.round("value", 3).alias("mean"))


@query("c09_distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_shipdate, l_quantity, l_discount FROM lineitem")
def distinct_rows(spark, folder):
    items = table(spark, folder, "lineitem")
    return clean.drop_repeats(items.select("l_returnflag", "l_linestatus", "l_shipdate", "l_quantity", "l_discount"))


@query("c10_kept_columns", "SELECT l_shipdate, l_quantity, l_tax FROM lineitem")
def kept_columns(spark, folder):
    wanted = ["l_shipdate", "l_quantity", "l_tax", "l_quantity", "absent"]
    return clean.keep_columns(table(spark, folder, "lineitem"), wanted)


@query("c11_clipped", """
    SELECT series_id, ts, CASE WHEN value IS NOT NULL THEN least(greatest(value, 100000), 300000) END AS value FROM gaps""",
    "days grid gaps")
def clipped_values(spark, folder):
    return clean.clip_values(daily_orders(spark, folder, fill=None), "value", 100_000, 300_000).select("series_id", "ts", "value")


@query("c12_sigma_clipped", """
    SELECT series_id, ts, round(least(greatest(value, m - 3 * s), m + 3 * s), 3) AS value
    FROM days JOIN (SELECT series_id, avg(value) AS m, stddev_pop(value) AS s FROM days GROUP BY 1) USING (series_id)""", "days")
def sigma_clipped(spark, folder):
    return rounded(clean.clip_sigma(orders_by_day(spark, folder), PANEL), 3, "value").select("series_id", "ts", "value")


@query("c13_preprocessed", """
    SELECT series_id, ts, pos, n, least(greatest(value, 50000), 400000) AS value, n_orders,
           CAST(year(ts) AS DOUBLE) AS year, CAST(month(ts) AS DOUBLE) AS month, CAST(day(ts) AS DOUBLE) AS day,
           CAST(isodow(ts) - 1 AS DOUBLE) AS weekday
    FROM (SELECT series_id, ts, pos, n,
            last_value(value IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value,
            last_value(n_orders IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_orders
          FROM gaps WINDOW w AS (PARTITION BY series_id ORDER BY ts))""", "days grid gaps")
def preprocessed(spark, folder):
    once = daily_orders(spark, folder, fill=None)
    repeated = once.unionByName(once.where("pos % 3 = 0"))
    return clean.preprocess(repeated, PANEL, clip_range=(50_000, 400_000), grid="day")


@query("c14_eligibility", """
    SELECT *, n_rows - n_finite AS n_unusable, n_finite < 10 AS few_rows, n_rows = n_finite AND n_rows >= 30 AS eligible_trend,
           n_finite >= 5 AS eligible_autoregression, n_rows >= 168 AS eligible_horizon, n_rows >= 61 AS eligible_windows
    FROM (SELECT series_id, count(*) AS n_rows, count(value) AS n_finite FROM gaps GROUP BY 1)""", "days grid gaps")
def eligibility(spark, folder):
    return quality.eligibility(daily_orders(spark, folder, fill=None), PANEL)


@query("c14_user_eligibility", """
    SELECT *, n_rows - n_finite AS n_unusable, n_finite < 10 AS few_rows, n_rows = n_finite AND n_rows >= 30 AS eligible_trend,
           n_finite >= 5 AS eligible_autoregression, n_rows >= 168 AS eligible_horizon, n_rows >= 61 AS eligible_windows
    FROM (SELECT CAST(user_id AS VARCHAR) AS series_id,
                 date_diff('hour', date_trunc('hour', min(ts)), date_trunc('hour', max(ts))) + 1 AS n_rows, n_rows AS n_finite
          FROM events GROUP BY user_id)""")
def user_eligibility(spark, folder):
    return quality.eligibility(hourly_users(spark, folder), EVENTS)


@query("c15_nonfinite_audit", """
    SELECT series_id, 'value' AS column, count_if(v IS NULL) AS n_null, count_if(isnan(v)) AS n_nan,
           count_if(isinf(v)) AS n_inf FROM (SELECT series_id, TRY_CAST(value AS DOUBLE) AS v FROM dirty) GROUP BY 1""", "dirty")
def nonfinite_audit(spark, folder):
    read = dirty_items(spark, folder).withColumn("value", F.col("value").try_cast("double"))
    return quality.nonfinite_audit(read, ["value"], ["series_id"])


@query("c15_required_finite", "SELECT series_id, count(*) AS n_rows FROM numbers WHERE x IS NOT NULL GROUP BY 1", "dirty numbers")
def required_finite(spark, folder):
    rows = clean.clean_values(dirty_items(spark, folder), "value")
    return quality.require_finite(rows, ["value"]).groupBy("series_id").agg(F.count("value").alias("n_rows"))


@query("c16_finite_arrays", """
    SELECT vec_id, round(list_sum(f), 4) AS total, len(f) AS size, f[1] AS head FROM (
      SELECT vec_id, list_transform(embedding, lambda v: CASE WHEN v > 0 THEN CAST(v AS DOUBLE) ELSE 0 END) AS f FROM embeddings)""")
def finite_arrays(spark, folder):
    # Non-positive elements are marked as not-a-number first, so they become 0.
    marked = F.transform("embedding", lambda v: F.when(v > 0, v.cast("double")).otherwise(F.lit(float("nan"))))
    safe = table(spark, folder, "embeddings").select("vec_id", finite_array(marked).alias("f"))
    total = F.aggregate("f", F.lit(0.0), lambda a, b: a + b)
    return safe.select("vec_id", F.round(total, 4).alias("total"), F.size("f").alias("size"), F.col("f")[0].alias("head"))


@query("c17_imputed", """
    SELECT series_id, ts, round(coalesce(value, m), 3) AS value FROM gaps JOIN (
      SELECT series_id, avg(value) AS m FROM gaps WHERE pos < n*6//10 GROUP BY 1) USING (series_id)""", "days grid gaps")
def imputed(spark, folder):
    gaps = daily_orders(spark, folder, fill=None).withColumn("phase", phase_from_head())
    return rounded(scale.impute_mean(gaps, PANEL, ["value"]), 3, "value").select("series_id", "ts", "value")


@query("c18_profiles", """
    SELECT series_id, count(*) AS n_rows, min(value) AS min_value, max(value) AS max_value, round(avg(value), 3) AS mean_value,
           sum(value) FILTER (pos = 0) AS head0, sum(value) FILTER (pos = 2) AS head2,
           sum(value) FILTER (pos = n - 3) AS tail0, sum(value) FILTER (pos = n - 1) AS tail2
    FROM ranked_days GROUP BY series_id""", "days ranked_days")
def profiles(spark, folder):
    got = quality.profile(with_pos(orders_by_day(spark, folder), PANEL, "day"), PANEL)
    edges = [F.col(side)[i].alias(f"{side}{i}") for side in ("head", "tail") for i in (0, 2)]
    return got.select("series_id", "n_rows", "min_value", "max_value", F.round("mean_value", 3).alias("mean_value"), *edges)


STEPS = """
    SELECT series_id, sum(c) AS n_rows, CASE WHEN min(gap) = max(gap) AND sum(c) >= 3 THEN min(gap) END AS regular_step,
           arg_max(gap, c * 1e12 - gap) FILTER (gap IS NOT NULL) AS modal_step
    FROM (SELECT series_id, gap, count(*) AS c FROM (
            SELECT series_id, CAST(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY series_id ORDER BY ts)) AS DOUBLE) AS gap FROM {0})
          GROUP BY 1, 2) GROUP BY 1"""


@query("c19_sampling_step", STEPS.format("days"), "days")
def sampling_step(spark, folder):
    return quality.sampling_step(with_pos(orders_by_day(spark, folder), PANEL, "day"), PANEL)


@query("c19_regular_step", STEPS.format("daily"), DAYS)
def regular_step(spark, folder):
    return quality.sampling_step(daily_orders(spark, folder), PANEL)


@query("x02_daily_orders", "SELECT series_id, ts, pos, n, value, n_orders FROM daily", DAYS)
def x02_daily_orders(spark, folder):
    return daily_orders(spark, folder)


@query("x02_daily_events", """
    SELECT g.series_id, g.ts, row_number() OVER (PARTITION BY g.series_id ORDER BY g.ts) - 1 AS pos,
           count(*) OVER (PARTITION BY g.series_id) AS n, coalesce(value, 0) AS value
    FROM (SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM event_days GROUP BY 1) g
    LEFT JOIN event_days d ON g.series_id = d.series_id AND g.ts = d.ts""", "event_days")
def x02_daily_events(spark, folder):
    return daily_events(spark, folder)


@query("x02_hourly_users", """
    WITH counted AS (SELECT CAST(user_id AS VARCHAR) AS series_id, date_trunc('hour', ts) AS ts, CAST(count(*) AS DOUBLE) AS value
                     FROM events GROUP BY 1, 2),
    hours AS (SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM counted GROUP BY 1)
    SELECT h.series_id, h.ts, row_number() OVER (PARTITION BY h.series_id ORDER BY h.ts) - 1 AS pos,
           count(*) OVER (PARTITION BY h.series_id) AS n, coalesce(value, 0) AS value
    FROM hours h LEFT JOIN counted c ON h.series_id = c.series_id AND h.ts = c.ts""")
def x02_hourly_users(spark, folder):
    return hourly_users(spark, folder)
