"""Calendar, lag, difference, seasonal and scaled features."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from seriesloom.functions import calendar
from seriesloom.functions.columns import timestamp
from seriesloom.operators import features, scale
from seriesloom.operators.keys import join_on
from seriesloom.operators.models.naive import naive_forecast
from seriesloom.operators.position import running_sum, with_pos
from seriesloom.operators.post import smooth
from seriesloom.plans.frames import dirty_items, fixed_forecast, phased
from seriesloom.plans.registry import DAYS, FC, PHASED, SCALED, query, rounded
from seriesloom.sources.series import EVENTS, PANEL, SHIPMENTS, daily_orders, hourly_users, orders_by_day, shipments, table


@query("f01_calendar", """
    SELECT event_id, ts, month(ts) AS month, day(ts) AS day_of_month, isodow(ts) - 1 AS day_of_week, hour(ts) AS hour,
           dayofyear(ts) AS day_of_year FROM events""")
def calendar_set(spark, folder):
    return features.with_calendar(table(spark, folder, "events").select("event_id", "ts"), EVENTS)


@query("f02_date_parts", """
    SELECT series_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, ts, year(ts) AS year, month(ts) AS month,
           day(ts) AS day, isodow(ts) - 1 AS weekday FROM numbers""", "dirty numbers")
def date_parts(spark, folder):
    rows = dirty_items(spark, folder).withColumn("ts", timestamp("date")).drop("date", "value")
    return features.with_date_parts(rows, EVENTS)


@query("f03_month_end", """
    SELECT series_id, ts, isodow(ts) - 1 AS dayofweek, CASE WHEN CAST(ts AS DATE) = last_day(ts) THEN 1 ELSE 0 END AS is_end_of_month
    FROM days""", "days")
def month_end(spark, folder):
    return features.with_month_end(orders_by_day(spark, folder).select("series_id", "ts"), PANEL)


CHANGES = """
    SELECT series_id, ts, value, lag(value) OVER w AS value_lag1, round(value - lag(value) OVER w, 3) AS value_diff,
           round((value - lag(value) OVER w) / nullif(lag(value) OVER w, 0), 8) + 0.0 AS value_pct_change,
           CASE WHEN count(value) OVER r = 3 THEN round(avg(value) OVER r, 4) END AS value_roll3
    FROM {0} WINDOW w AS (PARTITION BY series_id ORDER BY ts),
         r AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""


@query("f04_changes", CHANGES.format("days"), "days")
def changes(spark, folder):
    rows = features.with_changes(with_pos(orders_by_day(spark, folder), PANEL, "day"), PANEL)
    out = rounded(rounded(rounded(rows, 3, "value_diff"), 8, "value_pct_change"), 4, "value_roll3")
    return out.select("series_id", "ts", "value", "value_lag1", "value_diff", "value_pct_change", "value_roll3")


@query("f04_changes_on_grid", CHANGES.format("daily"), DAYS)
def changes_on_grid(spark, folder):
    out = rounded(features.with_changes(daily_orders(spark, folder), PANEL), 3, "value_diff")
    out = rounded(rounded(out, 8, "value_pct_change"), 4, "value_roll3")
    return out.select("series_id", "ts", "value", "value_lag1", "value_diff", "value_pct_change", "value_roll3")


LAGS = ", ".join(f"lag(value, {i}) OVER w AS lag_{i}" for i in range(1, 11))


@query("f05_lags", f"""
    SELECT * FROM (SELECT series_id, ts, pos, value, {LAGS} FROM ranked_days WINDOW w AS (PARTITION BY series_id ORDER BY ts))
    WHERE pos >= 10""", "days ranked_days")
def lags(spark, folder):
    rows = with_pos(orders_by_day(spark, folder), PANEL, "day")
    return features.with_lags(rows, PANEL).drop("n", "n_orders")


@query("f05_shipment_lags", f"SELECT * FROM (SELECT pos, value, {LAGS} FROM shipments WINDOW w AS (ORDER BY pos)) WHERE pos >= 10", "shipments")
def shipment_lags(spark, folder):
    rows = with_pos(shipments(spark, folder), SHIPMENTS).select("series_id", "pos", "value")
    return features.with_lags(rows, SHIPMENTS, block=8192).drop("series_id")


@query("f05_user_lags", f"""
    WITH counted AS (SELECT CAST(user_id AS VARCHAR) AS series_id, date_trunc('hour', ts) AS ts, CAST(count(*) AS DOUBLE) AS value
                     FROM events GROUP BY 1, 2),
    hours AS (SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM counted GROUP BY 1),
    filled AS (SELECT h.series_id, h.ts, coalesce(value, 0) AS value
               FROM hours h LEFT JOIN counted c ON h.series_id = c.series_id AND h.ts = c.ts)
    SELECT * FROM (SELECT series_id, ts, value, {LAGS} FROM filled WINDOW w AS (PARTITION BY series_id ORDER BY ts))
    WHERE lag_10 IS NOT NULL""")
def user_lags(spark, folder):
    return features.with_lags(hourly_users(spark, folder), EVENTS).drop("pos", "n")


@query("f06_first_difference", "SELECT series_id, ts, round(value - lag(value) OVER (PARTITION BY series_id ORDER BY ts), 3) + 0.0 AS d FROM daily", DAYS)
def first_difference(spark, folder):
    return rounded(features.with_difference(daily_orders(spark, folder), PANEL, "value", "d"), 3, "d").select("series_id", "ts", "d")


@query("f07_differences", """
    SELECT series_id, ts, round(d1 - lag(d1) OVER w, 3) + 0.0 AS d2, round(s1 - lag(s1) OVER w, 3) + 0.0 AS d1s7 FROM (
      SELECT series_id, ts, value - lag(value) OVER w AS d1, value - lag(value, 7) OVER w AS s1
      FROM daily WINDOW w AS (PARTITION BY series_id ORDER BY ts))
    WINDOW w AS (PARTITION BY series_id ORDER BY ts)""", DAYS)
def differences(spark, folder):
    rows = features.with_difference(daily_orders(spark, folder), PANEL, "value", "d2", order=2)
    rows = features.with_difference(rows, PANEL, "value", "s7", season=7)
    rows = features.with_difference(rows, PANEL, "s7", "d1s7")
    return rounded(rows, 3, "d2", "d1s7").select("series_id", "ts", "d2", "d1s7")


def _likelihood(power: float) -> str:
    moved = "ln(value)" if power == 0 else f"(pow(value, {power}) - 1) / {power}"
    return f"-count(*) * ln(stddev_pop({moved})) + ({power} - 1) * sum(ln(value))"


BOX_COX = " UNION ALL ".join(
    f"SELECT series_id, {p}::DOUBLE AS power, {_likelihood(p)} AS loglik FROM days GROUP BY 1" for p in features.POWERS
)


@query("f09_box_cox_power", f"""
    SELECT series_id, arg_max(power, loglik) AS power, round(max(loglik), 3) AS loglik FROM ({BOX_COX}) GROUP BY 1""", "days")
def box_cox_power(spark, folder):
    return rounded(features.box_cox_power(orders_by_day(spark, folder), PANEL), 3, "loglik")


@query("f09_box_cox", f"""
    SELECT series_id, ts, round(CASE WHEN power = 0 THEN ln(value) ELSE (pow(value, power) - 1) / power END, 3) AS moved
    FROM days JOIN (SELECT series_id, arg_max(power, loglik) AS power FROM ({BOX_COX}) GROUP BY 1) USING (series_id)""", "days")
def box_cox(spark, folder):
    days = orders_by_day(spark, folder)
    powered = days.join(features.box_cox_power(days, PANEL), "series_id")
    return powered.select("series_id", "ts", F.round(features.box_cox(F.col("value"), F.col("power")), 3).alias("moved"))


def _refined_sql(rounds: int) -> str:
    """Powers narrowed down as often, eight steps at a time."""
    steps = []
    for k in range(rounds):
        steps.append(f"""
    tried{k} AS (SELECT series_id, low, high, low + i * ((high - low) / 8) AS power, value FROM r{k} JOIN days USING (series_id)
                 CROSS JOIN (SELECT unnest(generate_series(0, 8)) AS i)),
    likely{k} AS (SELECT series_id, low, high, power, -count(*) * ln(stddev_pop(CASE WHEN power = 0 THEN ln(value) ELSE (pow(value, power) - 1) / power END))
                         + (power - 1) * sum(ln(value)) AS loglik FROM tried{k} GROUP BY series_id, low, high, power),
    r{k + 1} AS (SELECT series_id, power, loglik, greatest(low, power - (high - low) / 8) AS low, least(high, power + (high - low) / 8) AS high
                 FROM likely{k} QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY loglik DESC, power DESC) = 1)""")
    return f"""
    WITH r0 AS (SELECT series_id, power, CASE power WHEN -1 THEN -1 WHEN -0.5 THEN -1 WHEN 0 THEN -0.5 WHEN 0.5 THEN 0 WHEN 1 THEN 0.5 ELSE 1 END::DOUBLE AS low,
                       CASE power WHEN -1 THEN -0.5 WHEN -0.5 THEN 0 WHEN 0 THEN 0.5 WHEN 0.5 THEN 1 ELSE 2 END::DOUBLE AS high
                FROM (SELECT series_id, arg_max(power, loglik) AS power FROM ({BOX_COX}) GROUP BY 1)),
    """ + ",".join(steps)


@query("f09_box_cox_refined", _refined_sql(3) + " SELECT series_id, round(power, 8) AS power, round(loglik, 3) AS loglik FROM r3", "days")
def box_cox_refined(spark, folder):
    return rounded(rounded(features.refined_box_cox_power(orders_by_day(spark, folder), PANEL), 8, "power"), 3, "loglik")


@query("f09_box_cox_inverse", _refined_sql(3) + """
    , moved AS (SELECT series_id, ts, value, power, (pow(value, power) - 1) / power AS x FROM days JOIN r3 USING (series_id))
    SELECT series_id, ts, round(value, 2) AS back,
           round(value * (1 + 0.01 * (1 - power) / (2 * pow(power * x + 1, 2))), 2) AS mean FROM moved""", "days")
def box_cox_inverse(spark, folder):
    days = orders_by_day(spark, folder)
    powered = join_on(days, features.refined_box_cox_power(days, PANEL), ["series_id"])
    x = features.box_cox(F.col("value"), F.col("power"))
    back = {"back": features.inverse_box_cox(x, F.col("power")), "mean": features.inverse_box_cox(x, F.col("power"), F.lit(0.01))}
    return rounded(powered.withColumns(back).select("series_id", "ts", "back", "mean"), 2, "back", "mean")


def _fourier_sql() -> str:
    parts = []
    for name, (period, harmonics) in calendar.SEASONALITIES.items():
        for k in range(1, harmonics + 1):
            for f in ("sin", "cos"):
                parts.append(f"round({f}({2.0 * math.pi * k!r}::DOUBLE * t / {period}::DOUBLE), 7) + 0.0 AS {name}_{f}{k}")
    return ", ".join(parts)


@query("f10_fourier", f"""
    SELECT event_id, {_fourier_sql()} FROM (
      SELECT event_id, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE))::DOUBLE
             + (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::DOUBLE / 86400 AS t FROM events)""")
def fourier(spark, folder):
    terms = calendar.fourier_terms(calendar.epoch_days("ts"), list(calendar.SEASONALITIES))
    rows = table(spark, folder, "events").select("event_id", *[c.alias(name) for name, c in terms.items()])
    return rounded(rows, 7, *terms)


@query("f11_hinges", "SELECT series_id, ts, " + ", ".join(
    f"round(greatest(0, pos::DOUBLE / (n - 1) - {0.8 * j / 25!r}::DOUBLE), 9) AS hinge{j}" for j in range(1, 26)
) + " FROM daily", DAYS)
def hinges(spark, folder):
    terms = calendar.hinge_terms(F.col("pos") / (F.col("n") - 1), 25)
    rows = daily_orders(spark, folder).select("series_id", "ts", *[c.alias(name) for name, c in terms.items()])
    return rounded(rows, 9, *terms)


@query("f12_scaler", """
    SELECT series_id, round(m, 4) AS value_mean, round(s, 4) AS value_std,
           round(mo, 8) AS n_orders_mean, round(so, 8) AS n_orders_std FROM scaler""", f"{PHASED} scaler")
def scaler(spark, folder):
    params = scale.fit_scaler(phased(spark, folder), PANEL)
    return rounded(rounded(params, 4, "value_mean", "value_std"), 8, "n_orders_mean", "n_orders_std")


@query("f13_scaled", """
    SELECT series_id, ts, phase, round((value - m) / s, 8) + 0.0 AS value, round((n_orders - mo) / so, 8) + 0.0 AS n_orders
    FROM phased JOIN scaler USING (series_id)""", f"{PHASED} scaler")
def scaled(spark, folder):
    rows = phased(spark, folder)
    return rounded(scale.scale(rows, scale.fit_scaler(rows, PANEL), PANEL), 8, "value", "n_orders").drop("pos", "n")


@query("f14_unscaled", "SELECT series_id, ts, round(value, 4) AS value, round(n_orders, 6) AS n_orders FROM daily", DAYS)
def unscaled(spark, folder):
    rows = phased(spark, folder)
    params = scale.fit_scaler(rows, PANEL)
    back = scale.inverse_scale(scale.scale(rows, params, PANEL), params, PANEL)
    return rounded(rounded(back, 4, "value"), 6, "n_orders").select("series_id", "ts", "value", "n_orders")


@query("f15_unscaled_target", """
    SELECT series_id, ts, round(lag(z) OVER (PARTITION BY series_id ORDER BY ts) * s + m, 3) AS yhat
    FROM scaled JOIN scaler USING (series_id)""", SCALED)
def unscaled_target(spark, folder):
    rows = phased(spark, folder)
    params = scale.fit_scaler(rows, PANEL)
    forecast = naive_forecast(scale.scale(rows, params, PANEL), PANEL)
    return rounded(scale.inverse_target(forecast, params, PANEL, ["yhat"]), 3, "yhat").select("series_id", "ts", "yhat")


@query("f16_unscaled_difference", "SELECT series_id, ts, round(value - lag(value) OVER (PARTITION BY series_id ORDER BY ts), 3) + 0.0 AS d FROM daily", DAYS)
def unscaled_difference(spark, folder):
    rows = phased(spark, folder)
    moved = scale.scale(rows, scale.fit_scaler(rows, PANEL), PANEL, keep=True)
    steps = features.with_difference(moved, PANEL, "value", "d")
    return steps.select("series_id", "ts", F.round(scale.unscaled_difference("d", "value"), 3).alias("d"))


@query("f17_levels", """
    SELECT series_id, ts, round(first_value(value) OVER (PARTITION BY series_id ORDER BY ts) + sum(d) OVER (PARTITION BY series_id ORDER BY ts), 4) AS level
    FROM (SELECT *, coalesce(0.5 * (value - lag(value) OVER (PARTITION BY series_id ORDER BY ts)), 0) AS d FROM daily)""", DAYS)
def levels(spark, folder):
    rows = features.with_difference(daily_orders(spark, folder), PANEL, "value", "d")
    start = rows.where(F.col("pos") == 0).select("series_id", F.col("value").alias("start"))
    halved = rows.join(start, "series_id").withColumn("d", F.coalesce(0.5 * F.col("d"), F.lit(0.0)))
    out = features.levels_from_differences(halved, PANEL, "d", "start", "level")
    return rounded(out, 4, "level").select("series_id", "ts", "level")


@query("f17_one_step_levels", """
    SELECT series_id, ts, round(l1 + 0.25 * (l1 - l2), 5) AS level FROM (
      SELECT series_id, ts, lag(value) OVER w AS l1, lag(value, 2) OVER w AS l2 FROM daily WINDOW w AS (PARTITION BY series_id ORDER BY ts))""", DAYS)
def one_step_levels(spark, folder):
    rows = features.with_lags(daily_orders(spark, folder), PANEL, 2, drop_incomplete=False)
    rows = rows.withColumn("d", 0.25 * (F.col("lag_1") - F.col("lag_2")))
    return rounded(features.one_step_levels(rows, PANEL, "d", "level"), 5, "level").select("series_id", "ts", "level")


@query("f17_shipment_totals", "SELECT pos, sum(value) OVER (ORDER BY pos) AS total FROM shipments", "shipments")
def shipment_totals(spark, folder):
    rows = with_pos(shipments(spark, folder), SHIPMENTS).select("series_id", "pos", "value")
    return running_sum(rows, SHIPMENTS, "value", "total", block=8192).select("pos", "total")


@query("w07_trailing_mean", """
    SELECT pos, round(avg(value) OVER (ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS mean3 FROM shipments""", "shipments")
def trailing_mean(spark, folder):
    rows = with_pos(shipments(spark, folder), SHIPMENTS).select("series_id", "pos", "value")
    return rounded(features.with_trailing_mean(rows, SHIPMENTS, "value", "mean3", block=8192), 6, "mean3").select("pos", "mean3")


@query("p02_smoothed", """
    SELECT series_id, ts, round(avg(yhat) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 3) AS yhat
    FROM fc""", FC)
def smoothed(spark, folder):
    return rounded(smooth(fixed_forecast(spark, folder), PANEL), 3, "yhat").select("series_id", "ts", "yhat")
