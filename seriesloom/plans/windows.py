"""Sliding windows; whole windows are compared as text in hundredths."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.functions.columns import concat_arrays
from seriesloom.operators import windows
from seriesloom.operators.position import with_pos
from seriesloom.plans.registry import DAYS, cents, query
from seriesloom.sources.series import PANEL, SHIPMENTS, daily_orders, shipments

VALUE = PANEL.using(features=())


def _text(frame: str, column: str = "value") -> str:
    return f"string_agg(coalesce(CAST(CAST(round({column} * 100) AS BIGINT) AS VARCHAR), '-'), ',') OVER {frame}"


def _frame(name: str, first: int, last: int, by: str = "PARTITION BY series_id ORDER BY ts") -> str:
    edge = lambda k: f"{abs(k)} {'PRECEDING' if k <= 0 else 'FOLLOWING'}"
    return f"{name} AS ({by} ROWS BETWEEN {edge(first)} AND {edge(last)})"


@query("w01_supervised_windows", f"""
    SELECT series_id, pos - 9 AS origin, x, y FROM (
      SELECT series_id, pos, n, {_text('a')} AS x, {_text('b')} AS y FROM daily
      WINDOW {_frame('a', -9, 0)}, {_frame('b', 1, 3)})
    WHERE pos >= 9 AND pos < n - 3 AND (pos - 9) % 2 = 0""", DAYS)
def supervised(spark, folder):
    made = windows.supervised_windows(daily_orders(spark, folder), VALUE, 10, 3, stride=2)
    return made.select("series_id", "origin", cents(windows.flattened("x")).alias("x"), cents(windows.flattened("y")).alias("y"))


@query("w01_gap_windows", f"""
    SELECT series_id, pos - 9 AS origin, x, y FROM (
      SELECT series_id, pos, n, {_text('a')} AS x, {_text('b')} AS y FROM gaps
      WINDOW {_frame('a', -9, 0)}, {_frame('b', 1, 1)})
    WHERE pos >= 9 AND pos < n - 1""", "days grid gaps")
def gap_windows(spark, folder):
    made = windows.supervised_windows(daily_orders(spark, folder, fill=None), VALUE, 10)
    return made.select("series_id", "origin", cents(windows.flattened("x")).alias("x"), cents(windows.flattened("y")).alias("y"))


@query("w01_shipment_windows", f"""
    SELECT pos - 9 AS origin, x, y FROM (
      SELECT pos, n, {_text('a')} AS x, {_text('b')} AS y FROM shipments
      WINDOW {_frame('a', -9, 0, 'ORDER BY pos')}, {_frame('b', 1, 3, 'ORDER BY pos')})
    WHERE pos >= 9 AND pos < n - 3""", "shipments")
def shipment_windows(spark, folder):
    rows = with_pos(shipments(spark, folder), SHIPMENTS).select("series_id", "ts", "pos", "n", "value")
    made = windows.supervised_windows(rows, SHIPMENTS, 10, 3, block=8192)
    return made.select("origin", cents(windows.flattened("x")).alias("x"), cents(windows.flattened("y")).alias("y"))


@query("w02_encoder_decoder_windows", f"""
    SELECT series_id, pos - 95 AS origin, x AS x_enc, k || repeat(',-', 24) AS x_dec, k || ',' || y AS y_label FROM (
      SELECT series_id, pos, n, {_text('a')} AS x, {_text('k')} AS k, {_text('b')} AS y FROM daily
      WINDOW {_frame('a', -95, 0)}, {_frame('k', -47, 0)}, {_frame('b', 1, 24)})
    WHERE pos >= 95 AND pos < n - 24""", DAYS)
def encoder_decoder(spark, folder):
    made = windows.encoder_decoder_windows(daily_orders(spark, folder), VALUE, 96, 48, 24)
    return made.select("series_id", "origin", *[cents(windows.flattened(c)).alias(c) for c in ("x_enc", "x_dec", "y_label")])


@query("w03_disjoint_windows", f"""
    SELECT series_id, pos - 95 AS origin, x AS x_enc, d AS x_dec, y, f AS x_feature FROM (
      SELECT series_id, pos, n, {_text('a')} AS x, {_text('d')} AS d, {_text('b')} AS y, {_text('a', 'n_orders')} AS f FROM daily
      WINDOW {_frame('a', -95, 0)}, {_frame('d', 1, 72)}, {_frame('b', 49, 72)})
    WHERE pos >= 95 AND pos < n - 72""", DAYS)
def disjoint(spark, folder):
    made = windows.disjoint_windows(daily_orders(spark, folder), VALUE, 96, 48, 24, ["n_orders"])
    return made.select("series_id", "origin", *[cents(windows.flattened(c)).alias(c) for c in ("x_enc", "x_dec", "y", "x_feature")])


@query("w04_flattened_windows", f"""
    SELECT series_id, pos - 4 AS origin, x FROM (
      SELECT series_id, pos, n, string_agg(CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) || ',' ||
             CAST(CAST(round(n_orders * 100) AS BIGINT) AS VARCHAR), ',') OVER a AS x FROM daily WINDOW {_frame('a', -4, 0)})
    WHERE pos >= 4 AND pos < n - 1""", DAYS)
def flattened(spark, folder):
    made = windows.supervised_windows(daily_orders(spark, folder), PANEL, 5)
    return made.select("series_id", "origin", cents(windows.flattened("x")).alias("x"))


@query("w05_per_step", """
    SELECT series_id, pos - 4 AS origin, step, value AS last FROM daily CROSS JOIN (SELECT unnest([1, 2, 3]) AS step)
    WHERE pos >= 4 AND pos < n - 3""", DAYS)
def per_step(spark, folder):
    made = windows.supervised_windows(daily_orders(spark, folder), VALUE, 5, 3)
    last = F.element_at(F.element_at("x", -1), 1)
    return windows.per_step(made.select("series_id", "origin", last.alias("last")), 3)


@query("w06_last_difference", """
    SELECT series_id, pos - 4 AS origin, round(value - before, 3) + 0.0 AS d FROM (
      SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY ts) AS before FROM daily) WHERE pos >= 4 AND pos < n - 1""", DAYS)
def last_difference(spark, folder):
    made = windows.supervised_windows(daily_orders(spark, folder), VALUE, 5)
    return made.select("series_id", "origin", F.round(windows.last_difference("x"), 3).alias("d"))


@query("w08_unrolled", """
    SELECT w.series_id, w.pos - 4 AS origin, v.pos - w.pos + 4 AS step, v.value, v.n_orders
    FROM daily w JOIN daily v ON v.series_id = w.series_id AND v.pos BETWEEN w.pos - 4 AND w.pos
    WHERE w.pos >= 4 AND w.pos < w.n - 1""", DAYS)
def unrolled(spark, folder):
    made = windows.supervised_windows(daily_orders(spark, folder), PANEL, 5)
    return windows.unrolled(made, ["series_id", "origin"], "x", PANEL.columns)


@query("w09_concatenated", f"""
    SELECT series_id, pos - 4 AS origin, concat_ws(',', x, CASE WHEN (pos - 4) % 2 = 0 THEN y END) AS joined FROM (
      SELECT series_id, pos, n, {_text('a')} AS x, {_text('b')} AS y FROM daily WINDOW {_frame('a', -4, 0)}, {_frame('b', 1, 2)})
    WHERE pos >= 4 AND pos < n - 2""", DAYS)
def concatenated(spark, folder):
    made = windows.supervised_windows(daily_orders(spark, folder), VALUE, 5, 2)
    sometimes = F.when(F.col("origin") % 2 == 0, windows.flattened("y"))
    joined = concat_arrays(windows.flattened("x"), sometimes)
    return made.select("series_id", "origin", cents(joined).alias("joined"))
