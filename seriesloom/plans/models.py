"""Fitted models and their forecasts."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from seriesloom.functions.columns import dot
from seriesloom.operators import features, metrics, scale
from seriesloom.operators.gram import gram, regress
from seriesloom.operators.models import ar, arma, delta, dispatch, forest, horizon, trend
from seriesloom.operators.models.naive import naive_forecast
from seriesloom.operators.position import over_blocks, with_pos
from seriesloom.operators.post import apply_step_residual, fit_residual, fit_step_residual
from seriesloom.operators.split import phase_from_head
from seriesloom.plans.frames import fixed_forecast, phased
from seriesloom.plans.linear_sql import cells, inner, lags, least_squares, rss, shrunk, solution
from seriesloom.plans.registry import FC, PHASED, SCALED, query, rounded
from seriesloom.sources.series import EVENTS, PANEL, SHIPMENTS, daily_events, daily_orders, hourly_users, orders_by_day, shipments

TARGET = PANEL.using(features=())
LAGS3 = ["lag_1", "lag_2", "lag_3"]


def scaled_days(spark, folder):
    rows = phased(spark, folder).drop("n_orders")
    return scale.scale(rows, scale.fit_scaler(rows, TARGET), TARGET)


AR3 = f"""
    WITH design AS (SELECT * FROM (
      SELECT series_id, ts, pos, n, phase, z, [1, {lags('z', 3)}, z] AS x FROM scaled WINDOW w AS (PARTITION BY series_id ORDER BY ts))
      WHERE pos >= 3),
    train AS (SELECT * FROM design WHERE phase = 'train')"""


@query("m01_gram", AR3 + "," + cells("train", "series_id", "f") + """
    SELECT series_id, n, (i - 1) * 5 - (i - 1) * (i - 2) // 2 + (j - i) AS cell, round(g, 6) + 0.0 AS g FROM f_c WHERE i <= j""", SCALED)
def m_gram(spark, folder):
    rows = ar.lag_rows(scaled_days(spark, folder).where("phase = 'train'"), TARGET, 3)
    summed = gram(rows, ["series_id"], ["one", *LAGS3, "value"])
    return rounded(summed.select("series_id", "n", F.posexplode("cells").alias("cell", "g")), 6, "g")


@query("m01_least_squares", AR3 + "," + least_squares("train", "series_id", "f") + "," + rss("series_id", "f") + """
    SELECT series_id, n, round(b[1], 8) + 0.0 AS b0, round(b[2], 8) + 0.0 AS b1, round(b[3], 8) + 0.0 AS b2, round(b[4], 8) + 0.0 AS b3,
           round(rss, 6) AS rss FROM f JOIN f_e USING (series_id)""", SCALED)
def m_least_squares(spark, folder):
    rows = ar.lag_rows(scaled_days(spark, folder).where("phase = 'train'"), TARGET, 3)
    columns = ["one", *LAGS3, "value"]
    fitted = regress(gram(rows, ["series_id"], columns), ["series_id"], columns, columns[:-1], "value")
    return fitted.select("series_id", "n", *[F.round(F.col("betas")[i], 8).alias(f"b{i}") for i in range(4)], F.round("rss", 6).alias("rss"))


@query("m01_ridge_on_shipments", f"""
    WITH moved AS (SELECT pos, value / 50 AS v FROM shipments),
    design AS (SELECT * FROM (SELECT pos, 'shipments' AS series_id, [1, {lags('v', 3)}, v] AS x FROM moved WINDOW w AS (ORDER BY pos)) WHERE pos >= 3),
    """ + least_squares("design", "series_id", "f", "10") + """
    SELECT series_id, round(b[1], 8) + 0.0 AS b0, round(b[2], 8) + 0.0 AS b1, round(b[3], 8) + 0.0 AS b2, round(b[4], 8) + 0.0 AS b3 FROM f""", "shipments")
def m_ridge_on_shipments(spark, folder):
    rows = with_pos(shipments(spark, folder), SHIPMENTS).select("series_id", "pos", (F.col("value") / 50).alias("value"))
    columns = ["one", *LAGS3, "value"]
    grams = gram(ar.lag_rows(rows, SHIPMENTS, 3), ["series_id"], columns)
    fitted = regress(grams, ["series_id"], columns, columns[:-1], "value", 10.0)
    return fitted.select("series_id", *[F.round(F.col("betas")[i], 8).alias(f"b{i}") for i in range(4)])


ORDERS = f"""
    WITH lagged AS (SELECT * FROM (
      SELECT series_id, ts, pos, phase, z, [{lags('z', 5)}] AS l FROM scaled WINDOW w AS (PARTITION BY series_id ORDER BY ts)) WHERE pos >= 5),
    train AS (SELECT series_id, p, list_concat([1.0::DOUBLE], l[1:p], [z]) AS x
              FROM lagged CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4, 5]) AS p) WHERE phase = 'train'),
    """ + least_squares("train", "series_id, p", "f") + "," + rss("series_id, p", "f") + """
    , crit AS (SELECT series_id, p, n, rss, n * ln(rss / n) + 2 * (p + 1) AS aic,
                      n * ln(rss / n) + 2 * (p + 1) + 2.0 * (p + 1) * (p + 2) / (n - p - 2) AS aicc FROM f_e)"""


@query("g12_order_criteria", ORDERS + """
    SELECT series_id, p, n, round(rss, 6) AS rss, round(aic, 6) AS aic, round(aicc, 6) AS aicc FROM crit""", SCALED)
def g_criteria(spark, folder):
    tried = ar.order_candidates(scaled_days(spark, folder).where("phase = 'train'"), TARGET)
    return rounded(tried.drop("betas"), 6, "rss", "aic", "aicc")


@query("m02_plain_forecast", ORDERS + f"""
    , chosen AS (SELECT series_id, arg_min(p, aic * 1e6 + p) AS p FROM crit GROUP BY 1)
    SELECT l.series_id, ts, phase, c.p, round({inner('b', 'list_concat([1.0::DOUBLE], l)')}, 7) + 0.0 AS yhat
    FROM lagged l JOIN chosen c USING (series_id) JOIN f ON f.series_id = c.series_id AND f.p = c.p""", SCALED)
def m_plain(spark, folder):
    rows = scaled_days(spark, folder)
    params = ar.fit_plain(rows.where("phase = 'train'"), TARGET)
    out = ar.one_step(rows, params, TARGET).join(params.select("series_id", "p"), "series_id")
    return rounded(out, 7, "yhat").select("series_id", "ts", "phase", "p", "yhat")


UNIT_ROOT = f"""
    WITH lagged AS (SELECT * FROM (SELECT series_id, pos, [z, {lags('z', 6)}] AS l FROM scaled WINDOW w AS (PARTITION BY series_id ORDER BY ts))
                    WHERE pos >= 6 AND pos < (SELECT any_value(s.n) FROM scaled s WHERE s.series_id = series_id)),
    train AS (SELECT l.* FROM lagged l JOIN scaled s ON l.series_id = s.series_id AND l.pos = s.pos WHERE s.phase = 'train'),
    full0 AS (SELECT series_id, [1, l[2], l[2] - l[3], l[3] - l[4], l[4] - l[5], l[5] - l[6], l[1] - l[2]] AS x FROM train),
    part0 AS (SELECT series_id, [1, x[3], x[4], x[5], x[6], x[7]] AS x FROM full0),
    d AS (SELECT series_id, [l[i] - l[i + 1] for i in generate_series(1, 6)] AS l FROM train),
    full1 AS (SELECT series_id, [1, l[2], l[2] - l[3], l[3] - l[4], l[4] - l[5], l[5] - l[6], l[1] - l[2]] AS x FROM d),
    part1 AS (SELECT series_id, [1, x[3], x[4], x[5], x[6], x[7]] AS x FROM full1),
    """ + ",".join(least_squares(rows, "series_id", name) + "," + rss("series_id", name) for rows, name in (("full0", "a"), ("part0", "b"), ("full1", "c"), ("part1", "e")))


@query("f08_difference_orders", UNIT_ROOT + """
    , places AS (SELECT series_id, avg(z) AS m, count(*) AS c FROM scaled WHERE phase = 'train' GROUP BY series_id, pos % 7),
    strength AS (SELECT series_id, sum(c * m * m) - sum(c * m) * sum(c * m) / sum(c) AS between FROM places GROUP BY 1),
    overall AS (SELECT series_id, count(*) AS n, sum(z * z) - sum(z) * sum(z) / count(*) AS total FROM scaled WHERE phase = 'train' GROUP BY 1),
    t AS (SELECT a.series_id, sign(a.b[2]) * sqrt((b_e.rss - a_e.rss) / (a_e.rss / (a_e.n - 6))) AS level_t,
                 sign(c.b[2]) * sqrt((e_e.rss - c_e.rss) / (c_e.rss / (c_e.n - 6))) AS diff_t
          FROM a JOIN a_e USING (series_id) JOIN b_e USING (series_id) JOIN c USING (series_id) JOIN c_e USING (series_id) JOIN e_e USING (series_id))
    SELECT series_id, n, CASE WHEN level_t < -2.86 THEN 0 WHEN diff_t < -2.86 THEN 1 ELSE 2 END AS d,
           CASE WHEN between / total > 0.64 THEN 1 ELSE 0 END AS seasonal_d, round(level_t, 6) AS level_t, round(diff_t, 6) AS diff_t,
           round(between / total, 8) AS strength
    FROM t JOIN strength USING (series_id) JOIN overall USING (series_id)""", SCALED)
def f_difference_orders(spark, folder):
    out = ar.difference_orders(scaled_days(spark, folder).where("phase = 'train'"), TARGET, seasonal_test="strength")
    return rounded(rounded(out, 6, "level_t", "diff_t"), 8, "strength")


def _root_sql() -> str:
    """t values of the seasonal-root regression of a weekly season, for one to three lags on the same rows."""
    steps = []
    for p in (1, 2, 3):
        own = ", ".join(f"y[{i}]" for i in range(2, p + 2))
        before = " - ".join(["{0}[{1}]", "b[1]", *[f"b[{i + 1}] * {{0}}[{{1}} + {i}]" for i in range(1, p + 1)]])
        steps.append(f"""
    ar{p} AS (SELECT series_id, [1, {own}, y[1]] AS x FROM parts),
    {least_squares(f"ar{p}", "series_id", f"a{p}")},
    full{p} AS (SELECT series_id, [{own}, {before.format("s", 2)}, {before.format("f", 8)}, y[1]] AS x FROM parts JOIN a{p} USING (series_id)),
    part{p} AS (SELECT series_id, list_concat(x[1:{p + 1}], [x[{p + 3}]]) AS x FROM full{p}),
    {least_squares(f"full{p}", "series_id", f"g{p}")}, {rss("series_id", f"g{p}")},
    {least_squares(f"part{p}", "series_id", f"h{p}")}, {rss("series_id", f"h{p}")},
    t{p} AS (SELECT series_id, {p} AS lags, g{p}_e.n, sign(b[{p + 2}]) * sqrt((h{p}_e.rss - g{p}_e.rss) / (g{p}_e.rss / (g{p}_e.n - {p + 2}))) AS statistic,
                    g{p}_e.n * ln(g{p}_e.rss / g{p}_e.n) + 2 * {p + 2} AS aic FROM g{p} JOIN g{p}_e USING (series_id) JOIN h{p}_e USING (series_id))""")
    return f"""
    WITH lagged AS (SELECT * FROM (SELECT series_id, pos, phase, [z, {lags('z', 11)}] AS l FROM scaled WINDOW w AS (PARTITION BY series_id ORDER BY pos))
                    WHERE pos >= 11 AND phase = 'train'),
    parts AS (SELECT series_id, [l[i] - l[i + 1] - l[i + 7] + l[i + 8] for i in generate_series(1, 4)] AS y,
                     [l[i] - l[i + 7] for i in generate_series(1, 5)] AS s, [l[i] - l[i + 1] for i in generate_series(1, 11)] AS f FROM lagged),
    """ + ",".join(steps) + " SELECT series_id, lags, n, round(statistic, 5) AS statistic, round(aic, 5) AS aic FROM (FROM t1 UNION ALL FROM t2 UNION ALL FROM t3)"


@query("f08_seasonal_root", _root_sql(), SCALED)
def f_seasonal_root(spark, folder):
    tested = ar.seasonal_root_statistics(scaled_days(spark, folder).where("phase = 'train'"), TARGET)
    return rounded(tested, 5, "statistic", "aic")


@query("m03_order_bounds", """
    WITH sizes AS (SELECT CAST(user_id AS VARCHAR) AS series_id,
                          date_diff('hour', date_trunc('hour', min(ts)), date_trunc('hour', max(ts))) + 1 AS n FROM events GROUP BY 1),
    tiers AS (SELECT *, least(CASE WHEN n < 200 THEN 2 WHEN n < 1000 THEN 5 ELSE 7 END, 5) AS p, p AS q,
                     CASE WHEN n < 14 THEN 0 ELSE least(CASE WHEN n < 200 THEN 1 WHEN n < 1000 THEN 2 ELSE 3 END, 2) END AS s,
                     greatest(2, least(12, n // 10)) AS budget FROM sizes),
    walk AS (SELECT series_id, n, p, q, s, budget FROM tiers UNION ALL
             SELECT series_id, n, CASE WHEN p >= q THEN p - 1 ELSE p END, CASE WHEN p >= q THEN q ELSE q - 1 END, s, budget
             FROM walk WHERE p + q + 2 * s > budget AND greatest(p, q) > 1)
    SELECT series_id, n, min(p) AS max_p, min(q) AS max_q, any_value(s) AS max_sp, any_value(s) AS max_sq, n < 200 AS small_sample
    FROM walk GROUP BY series_id, n""", "event_days")
def m_order_bounds(spark, folder):
    lengths = hourly_users(spark, folder).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    return ar.order_bounds(lengths)


@query("m03_smart_forecast")
def m_smart(spark, folder):
    rows, _ = dispatch.forecast(daily_orders(spark, folder), TARGET, "arima")
    return rows


@query("m03_arma_residuals", f"""
    WITH r AS (
      SELECT series_id, 0::BIGINT AS pos, [0, 0, 0, 0, 0, 0, 0]::DOUBLE[] AS h, z AS last, 0::DOUBLE AS expected FROM scaled WHERE pos = 0
      UNION ALL
      SELECT s.series_id, s.pos, list_concat(h[2:7], [s.z - (0.1 + 0.5 * last + 0.3 * h[7] + 0.2 * h[1])]), s.z,
             0.1::DOUBLE + 0.5::DOUBLE * last + 0.3::DOUBLE * h[7] + 0.2::DOUBLE * h[1]
      FROM r JOIN scaled s ON s.series_id = r.series_id AND s.pos = r.pos + 1)
    SELECT series_id, pos, round(expected, 7) + 0.0 AS expected FROM r WHERE pos > 0""", SCALED)
def m_arma_residuals(spark, folder):
    rows = scaled_days(spark, folder).withColumnRenamed("value", "w")
    fixed = rows.select("series_id").distinct().withColumns(
        {"betas": F.array(*[F.lit(b) for b in (0.1, 0.5, 0.3, 0.2)]), "used": F.array(*[F.lit(i) for i in range(4)])}
    )
    return rounded(arma.expectations(rows, fixed, TARGET, ["one", "w_1", "e_1", "e_7"], block=512), 7, "expected")


def _refit_sql(source: str) -> str:
    """Expanding refits every third evaluated row, from running sums of products."""
    return f"""
    WITH design AS (SELECT * FROM (
      SELECT series_id, ts, pos, phase, z, min(pos) OVER (PARTITION BY series_id, phase) AS start, [1, {lags('z', 2)}, z] AS x
      FROM {source} WINDOW w AS (PARTITION BY series_id ORDER BY pos)) WHERE pos >= 2),
    eval AS (SELECT *, pos - (pos - start) % 3 AS refit_pos FROM design WHERE phase <> 'train'),
    running AS (SELECT series_id, pos, i, j, coalesce(sum(x[i] * x[j]) OVER (PARTITION BY series_id, i, j ORDER BY pos
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g
      FROM design CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS i) CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS j)),
    f_c AS (SELECT series_id, pos AS refit_pos, i, j, g, 3 AS d FROM running SEMI JOIN eval ON running.series_id = eval.series_id AND running.pos = eval.refit_pos),
    """ + solution("series_id, refit_pos", "f") + f"""
    SELECT series_id, ts, pos, phase, refit_pos, round(z, 7) + 0.0 AS y_true, round({inner('b', 'x')}, 7) + 0.0 AS yhat
    FROM eval JOIN f USING (series_id, refit_pos)"""


@query("m04_rolling_refit", _refit_sql("scaled"), SCALED)
def m_rolling_refit(spark, folder):
    out = ar.rolling_refit(scaled_days(spark, folder), TARGET, p=2, every=3)
    return rounded(out, 7, "y_true", "yhat").drop("n", "fallback")


@query("m04_rolling_refit_shipments", _refit_sql("""(SELECT 'shipments' AS series_id, ts, pos, value AS z,
      CASE WHEN pos < n*6//10 THEN 'train' WHEN pos < n*6//10 + n*2//10 THEN 'val' ELSE 'test' END AS phase FROM shipments)"""), "shipments")
def m_rolling_refit_shipments(spark, folder):
    rows = with_pos(shipments(spark, folder), SHIPMENTS).select("series_id", "ts", "pos", "n", "value")
    out = ar.rolling_refit(rows.withColumn("phase", phase_from_head()), SHIPMENTS, p=2, every=3)
    return rounded(out, 7, "y_true", "yhat").drop("n", "fallback")


ROLLING_SEARCH = f"""
    WITH lagged AS (SELECT * FROM (
      SELECT series_id, ts, pos, phase, z, [1.0::DOUBLE, {lags('z', 3)}] AS l FROM scaled WINDOW w AS (PARTITION BY series_id ORDER BY pos)) WHERE pos >= 3),
    long_rows AS (SELECT series_id, list_concat(l, [z]) AS x FROM lagged WHERE phase = 'train'),
    {least_squares("long_rows", "series_id", "a", "1e-8")},
    missed AS (SELECT series_id, ts, pos, phase, z, l, z - {inner('b', 'l')} AS e FROM lagged JOIN a USING (series_id)),
    design AS (SELECT * FROM (SELECT series_id, ts, pos, phase, z, [lag(z) OVER w, lag(z, 2) OVER w, lag(e) OVER w, z] AS x
                              FROM missed WINDOW w AS (PARTITION BY series_id ORDER BY pos)) WHERE x[2] IS NOT NULL),
    starts AS (SELECT series_id, phase, min(pos) AS start FROM scaled WHERE phase <> 'train' GROUP BY ALL),
    eval AS (SELECT d.*, pos - (pos - start) % 3 AS refit_pos FROM design d JOIN starts USING (series_id, phase)),
    running AS (SELECT series_id, pos AS refit_pos, i, j, sum(x[i] * x[j]) OVER past AS g, count(*) OVER past AS n
      FROM design CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS i) CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS j)
      WINDOW past AS (PARTITION BY series_id, i, j ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    at_refit AS (SELECT r.* FROM running r SEMI JOIN eval e ON r.series_id = e.series_id AND r.refit_pos = e.refit_pos),
    orders_tried AS (SELECT unnest([{{'p': 0, 'q': 0, 'c': [4]}}, {{'p': 1, 'q': 0, 'c': [1, 4]}}, {{'p': 2, 'q': 0, 'c': [1, 2, 4]}},
      {{'p': 0, 'q': 1, 'c': [3, 4]}}, {{'p': 1, 'q': 1, 'c': [1, 3, 4]}}, {{'p': 2, 'q': 1, 'c': [1, 2, 3, 4]}}]) AS o),
    f_c AS (SELECT series_id, refit_pos, o.p AS p, o.q AS q, a.k AS i, b.k AS j, g, n, len(o.c) - 1 AS d
      FROM orders_tried CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS k) a CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS k) b
      JOIN at_refit r ON a.k <= len(o.c) AND b.k <= len(o.c) AND r.i = o.c[a.k] AND r.j = o.c[b.k]),
    """ + solution("series_id, refit_pos, p, q", "f") + "," + rss("series_id, refit_pos, p, q", "f") + f"""
    , fits AS (SELECT series_id, refit_pos, p, q, b, f.d AS d, n, rss FROM f JOIN f_e USING (series_id, refit_pos, p, q)
      UNION ALL SELECT series_id, refit_pos, 0, 0, [], 0, n, g FROM f_c WHERE p = 0 AND q = 0),
    judged AS (SELECT *, n * ln(rss / n) + 2 * d + CASE WHEN refit_pos < 200 THEN 2.0 * d * (d + 1) / (n - d - 1) ELSE 0 END AS criterion FROM fits),
    chosen AS (SELECT * FROM judged QUALIFY row_number() OVER (PARTITION BY series_id, refit_pos ORDER BY criterion, p + q, p, q) = 1)
    SELECT series_id, ts, pos, phase, refit_pos, c.p::INTEGER AS p, c.q::INTEGER AS q, 0::INTEGER AS sp, 0::INTEGER AS sq, false AS fallback,
           round(criterion, 4) AS criterion, round(z, 6) + 0.0 AS y_true,
           round(coalesce({inner('b', "CASE WHEN c.q = 0 THEN x[1:c.p] ELSE list_concat(x[1:c.p], [x[3]]) END")}, 0), 6) + 0.0 AS yhat
    FROM eval JOIN chosen c USING (series_id, refit_pos)"""


@query("m04_rolling_search", ROLLING_SEARCH, SCALED)
def m_rolling_search(spark, folder):
    limits = {"max_p": 2, "max_q": 1, "max_sp": 0, "max_sq": 0, "max_d": 0, "max_seasonal": 0, "long_order": 3}
    out = ar.rolling_search(scaled_days(spark, folder), TARGET, every=3, **limits)
    return rounded(rounded(out, 6, "y_true", "yhat"), 4, "criterion").drop("n")


def _trend_sql(count: int) -> str:
    hinges = ", ".join(f"greatest(0, t - {0.8 * j / count!r}::DOUBLE)" for j in range(1, count + 1))
    waves = ", ".join(f"{f}({2.0 * math.pi * k!r}::DOUBLE * day / 365.25::DOUBLE)" for k in range(1, 11) for f in ("sin", "cos"))
    return f"""
    WITH dated AS (SELECT *, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE))::DOUBLE AS day FROM phased),
    span AS (SELECT series_id, min(day) AS d0, max(day) AS d1, max(abs(value)) AS peak FROM dated WHERE phase = 'train' GROUP BY 1),
    timed AS (SELECT d.*, (day - d0) / (d1 - d0) AS t, peak FROM dated d JOIN span USING (series_id)),
    basis AS (SELECT series_id, ts, phase, peak, value / peak AS y, [1.0::DOUBLE, t, {hinges}] AS tr, [{waves}] AS se FROM timed),
    train AS (SELECT * FROM basis WHERE phase = 'train'),
    joint AS (SELECT series_id, list_concat(tr, se, [y]) AS x FROM train),
    """ + shrunk("joint", "series_id", "g", f"CASE WHEN i <= 2 THEN 1 / 25.0 WHEN i <= {count + 2} THEN {TREND_WEIGHT} ELSE 1 / 100.0 END")


TREND_WEIGHT = "1 / (0.05::DOUBLE * 0.05)"
RELATIVE = "SELECT series_id, list_concat(se, [y / {0} - 1]) AS x FROM train JOIN {1} USING (series_id)"


@query("m05_trend_forecast", _trend_sql(25) + f"""
    SELECT series_id, ts, phase, round(peak * {inner('b', 'list_concat(tr, se)')}, 1) + 0.0 AS yhat FROM basis JOIN g USING (series_id)""", PHASED)
def m_trend(spark, folder):
    rows = phased(spark, folder)
    out = trend.predict_trend(rows, trend.fit_trend(rows, TARGET, prior="normal"), TARGET)
    return rounded(out, 1, "yhat").select("series_id", "ts", "phase", "yhat")


@query("m05_sparse_trend")
def m_sparse_trend(spark, folder):
    rows = phased(spark, folder)
    return trend.predict_trend(rows, trend.fit_trend(rows, TARGET), TARGET).select("series_id", "ts", "phase", "yhat")


@query("m05_multiplicative_trend", _trend_sql(25) + f"""
    , first_trend AS (SELECT series_id, b[1:27] AS b FROM g),
    rest1 AS ({RELATIVE.format(inner('b', 'tr'), 'first_trend')}),
    """ + shrunk("rest1", "series_id", "p", "1 / 100.0") + f"""
    , adjusted AS (SELECT series_id, list_concat(tr, [y / (1 + {inner('b', 'se')})]) AS x FROM train JOIN p USING (series_id)),
    """ + shrunk("adjusted", "series_id", "q", f"CASE WHEN i <= 2 THEN 1 / 25.0 ELSE {TREND_WEIGHT} END") + f"""
    , rest2 AS ({RELATIVE.format(inner('b', 'tr'), 'q')}),
    """ + shrunk("rest2", "series_id", "r", "1 / 100.0") + f"""
    SELECT series_id, ts, phase, y_true, round(peak * {inner('tb', 'tr')} * (1 + {inner('sb', 'se')}), 1) + 0.0 AS yhat FROM (
      SELECT basis.*, round(peak * y, 2) AS y_true, q.b AS tb, r.b AS sb FROM basis JOIN q USING (series_id) JOIN r USING (series_id))
    WHERE phase <> 'train'""", PHASED)
def m_multiplicative(spark, folder):
    rows, _ = dispatch.forecast(daily_orders(spark, folder), TARGET, "prophet", mode="multiplicative", prior="normal")
    return rounded(rounded(rows, 1, "yhat"), 2, "y_true").drop("pos", "model")


def _search_sql() -> str:
    """All 72 settings: additive ones from one matrix per changepoint count, relative ones fitted in turn."""
    waves = ", ".join(f"{f}({2.0 * math.pi * k!r}::DOUBLE * day / 365.25::DOUBLE)" for k in range(1, 11) for f in ("sin", "cos"))
    cs, ss, ks = (f"(SELECT unnest({list(trend.GRID[g])}::DOUBLE[]) AS {n})" for g, n in (("changepoint_scale", "cs"), ("seasonality_scale", "ss"), ("n_changepoints", "cp")))
    trend_weight = "CASE WHEN i <= 2 THEN 1 / 25.0 ELSE 1 / (cs * cs) END"
    relative = "SELECT series_id, cp, cs, list_concat(se, [y / {0} - 1]) AS x FROM train JOIN {1} USING (series_id, cp)"
    return f"""
    WITH ph AS (SELECT *, CASE WHEN pos < n*6//10 THEN 'train' WHEN pos < n*6//10 + n*2//10 THEN 'val' ELSE 'test' END AS phase,
                       date_diff('day', DATE '1970-01-01', CAST(ts AS DATE))::DOUBLE AS day FROM ranked_days),
    span AS (SELECT series_id, min(day) AS d0, max(day) AS d1, max(abs(value)) AS peak FROM ph WHERE phase = 'train' GROUP BY 1),
    timed AS (SELECT p.*, (day - d0) / (d1 - d0) AS t, peak FROM ph p JOIN span USING (series_id)),
    basis AS (SELECT series_id, ts, phase, cp, peak, value, value / peak AS y, [{waves}] AS se,
                     list_concat([1.0::DOUBLE, t], [greatest(0, t - 0.8::DOUBLE * j / cp) for j in generate_series(1, cp::INTEGER)]) AS tr
              FROM timed CROSS JOIN {ks}),
    train AS (SELECT * FROM basis WHERE phase = 'train'),
    joint AS (SELECT series_id, cp, list_concat(tr, se, [y]) AS x FROM train),
    """ + shrunk("joint", "series_id, cp", "g", "CASE WHEN i <= 2 THEN 1 / 25.0 WHEN i <= cp + 2 THEN 1 / (cs * cs) ELSE 1 / (ss * ss) END", f"{cs} CROSS JOIN {ss}", "cs, ss") + f"""
    , t1 AS (SELECT series_id, cp, cs, b[1:(cp::INTEGER + 2)] AS b FROM g WHERE ss = 10),
    rest1 AS ({relative.format(inner('b', 'tr'), 't1')}),
    """ + shrunk("rest1", "series_id, cp, cs", "p", "1 / 100.0") + f"""
    , adjusted AS (SELECT series_id, cp, cs, list_concat(tr, [y / (1 + {inner('b', 'se')})]) AS x FROM train JOIN p USING (series_id, cp)),
    """ + shrunk("adjusted", "series_id, cp, cs", "q", trend_weight) + f"""
    , rest2 AS ({relative.format(inner('b', 'tr'), 'q')}),
    """ + shrunk("rest2", "series_id, cp, cs", "r", "1 / (ss * ss)", ss, "ss") + f"""
    , fits AS (SELECT series_id, cp, cs, ss, 'additive' AS mode, b[1:(cp::INTEGER + 2)] AS tb, b[(cp::INTEGER + 3):] AS sb FROM g
      UNION ALL SELECT r.series_id, r.cp, r.cs, ss, 'multiplicative', q.b, r.b FROM r JOIN q ON q.series_id = r.series_id AND q.cp = r.cp AND q.cs = r.cs),
    scores AS (SELECT series_id, cs, cp, mode, ss, avg(abs(value - yhat) / greatest(abs(value), 2.220446049250313e-16::DOUBLE)) AS mape FROM (
      SELECT series_id, cs, cp, mode, ss, value, peak * CASE mode WHEN 'additive' THEN level + season ELSE level * (1 + season) END AS yhat FROM (
        SELECT f.*, value, peak, {inner('tb', 'tr')} AS level, {inner('sb', 'se')} AS season
        FROM basis JOIN fits f USING (series_id, cp) WHERE phase = 'val')) GROUP BY ALL),
    numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY series_id ORDER BY cs, cp, mode, ss) - 1 AS INTEGER) AS config FROM scores)
    SELECT series_id, cs AS changepoint_scale, ss AS seasonality_scale, mode, round(mape, 7) AS mape, CAST(cp AS INTEGER) AS n_changepoints, config
    FROM numbered QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY mape, config) = 1"""


@query("m06_trend_search", _search_sql(), "days ranked_days")
def m_trend_search(spark, folder):
    days = with_pos(orders_by_day(spark, folder), TARGET, "day").withColumn("phase", phase_from_head())
    return rounded(trend.best_trend(trend.search_trend(days, TARGET, prior="normal"), TARGET), 7, "mape")


@query("m07_future_frame", """
    SELECT series_id, hi + INTERVAL 1 DAY * step AS ts, step FROM (SELECT series_id, max(ts) AS hi FROM days GROUP BY 1)
    CROSS JOIN (SELECT CAST(unnest(generate_series(1, 30)) AS INTEGER) AS step)""", "days")
def m_future(spark, folder):
    return trend.future_frame(orders_by_day(spark, folder), PANEL, 30, "day")


@query("m08_forest")
def m_forest(spark, folder):
    rows, _ = dispatch.forecast(daily_orders(spark, folder), TARGET, "randomforest", n_estimators=20, max_depth=6)
    return rows


@query("m09_forest_search")
def m_forest_search(spark, folder):
    rows = forest.lag_design(phased(spark, folder), TARGET).where("phase = 'train'")
    small = forest.SPACE | {"n_estimators": (5, 10), "max_depth": (4, 6)}
    return forest.search_forest(rows, TARGET, trials=2, folds=3, space=small)


@query("m08_boosted_changes")
def m_boosted(spark, folder):
    rows = forest.lag_design(phased(spark, folder), TARGET)
    model = forest.fit_boosted(rows.where("phase = 'train'"), TARGET, rounds=5, depth=3)
    return forest.predict_boosted(model, rows, TARGET)


DELTA = f"""
    WITH channels AS (SELECT series_id, ts, pos, phase, value, m, s, (value - m) / s AS z, (n_orders - mo) / so AS o FROM phased JOIN scaler USING (series_id)),
    windows AS (SELECT * FROM (
      SELECT series_id, ts, pos, phase, value, s, z, lag(z) OVER w AS z1, lag(value) OVER w AS v1, lag(z, 2) OVER w AS z2, lag(o) OVER w AS o1, lag(o, 2) OVER w AS o2,
             [1, {", ".join(f"lag(z, {i}) OVER w, lag(o, {i}) OVER w" for i in range(10, 0, -1))}, z - lag(z) OVER w] AS x
      FROM channels WINDOW w AS (PARTITION BY series_id ORDER BY ts)) WHERE pos >= 10),
    train AS (SELECT * FROM windows WHERE phase = 'train'),
    """ + least_squares("train", "series_id", "f", "CASE WHEN i > 1 THEN 1 ELSE 0 END") + f"""
    , pred AS (SELECT series_id, ts, pos, phase, value AS y_true, v1 + s * {inner('b', 'x')} AS yhat, z1, z2, o1, o2, x FROM windows JOIN f USING (series_id))"""


@query("m10_change_forecast", DELTA + " SELECT series_id, ts, phase, round(y_true, 3) AS y_true, round(yhat, 3) AS yhat FROM pred", f"{PHASED} scaler")
def m_delta(spark, folder):
    rows = phased(spark, folder)
    out = delta.predict_delta(rows, delta.fit_delta(rows, PANEL), PANEL)
    return rounded(out, 3, "y_true", "yhat").drop("pos", "n")


@query("r08_window_residual", DELTA + f"""
    , res AS (SELECT *, list_concat(x[2:21], [z1 - z2, o1 - o2]) AS u, list_concat(u, [y_true - yhat]) AS q FROM pred),
    fitted AS (SELECT series_id, q AS x FROM res WHERE phase = 'val'),
    """ + least_squares("fitted", "series_id", "r", "5") + f"""
    SELECT series_id, ts, phase, round(yhat + {inner('b', 'u')}, 2) + 0.0 AS corrected FROM res JOIN r USING (series_id) WHERE phase <> 'train'""",
    f"{PHASED} scaler")
def r_window(spark, folder):
    return _window_residual(spark, folder, 5.0)


# The change columns repeat window columns, so leaving them out gives the same fitted values.
@query("r08_window_residual_unpenalised", DELTA + """
    , res AS (SELECT *, x[2:21] AS u, list_concat(u, [y_true - yhat]) AS q FROM pred),
    fitted AS (SELECT series_id, q AS x FROM res WHERE phase = 'val'),
    """ + least_squares("fitted", "series_id", "r") + f"""
    SELECT series_id, ts, phase, round(yhat + {inner('b', 'u')}, 2) + 0.0 AS corrected FROM res JOIN r USING (series_id) WHERE phase <> 'train'""",
    f"{PHASED} scaler")
def r_window_unpenalised(spark, folder):
    return _window_residual(spark, folder, 0.0)


def _window_residual(spark, folder, alpha):
    rows = phased(spark, folder)
    forecast = delta.predict_delta(rows, delta.fit_delta(rows, PANEL), PANEL)
    inputs = scale.scale(rows, scale.fit_scaler(rows, PANEL), PANEL)
    params = delta.fit_window_residual(inputs, forecast, PANEL, alpha=alpha)
    out = delta.apply_window_residual(inputs, forecast, params, PANEL).where("phase <> 'train'")
    return rounded(out, 2, "corrected").select("series_id", "ts", "phase", "corrected")


@query("r05_feature_residual", f"""
    WITH lagged AS (SELECT * FROM (SELECT series_id, ts, phase, y_true, yhat,
        [1, lag(y_true) OVER w / 1e5, lag(y_true, 7) OVER w / 1e5, (y_true - yhat) / 1e5] AS x, lag(y_true, 7) OVER w AS old
      FROM fc WINDOW w AS (PARTITION BY series_id ORDER BY ts)) WHERE old IS NOT NULL),
    fitted AS (SELECT * FROM lagged WHERE phase = 'val'),
    """ + least_squares("fitted", "series_id", "r") + f"""
    SELECT series_id, ts, round(yhat + 1e5 * {inner('b', 'x')}, 2) + 0.0 AS corrected FROM lagged JOIN r USING (series_id) WHERE phase <> 'train'""", FC)
def r_features(spark, folder):
    rows = fixed_forecast(spark, folder)
    lagged = features.with_lags(rows, PANEL.using(value="y_true"), 7)
    design = lagged.withColumns({
        "one": F.lit(1.0), "x1": F.col("lag_1") / 1e5, "x7": F.col("lag_7") / 1e5, "miss": (F.col("y_true") - F.col("yhat")) / 1e5,
    })
    columns = ["one", "x1", "x7", "miss"]
    grams = gram(design.where("phase = 'val'"), ["series_id"], columns)
    params = regress(grams, ["series_id"], columns, columns[:-1], "miss").select("series_id", "betas")
    out = design.where("phase <> 'train'").join(params, "series_id").withColumn("corrected", F.col("yhat") + 1e5 * dot("betas", columns[:-1]))
    return rounded(out, 2, "corrected").select("series_id", "ts", "corrected")


@query("r05_step_residual", """
    WITH design AS (SELECT series_id, ts, pos, n, phase, value / 1e5 AS x1, lag(value, 6) OVER w / 1e5 AS x7, value AS last,
        [lead(value, 1) OVER w, lead(value, 2) OVER w, lead(value, 3) OVER w] AS y FROM phased WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
    steps AS (SELECT *, y[h] AS y_true FROM design CROSS JOIN range(1, 4) r(h) WHERE pos >= 6 AND pos < n - 3),
    fitted AS (SELECT series_id, h, [1, x1, x7, y_true - last] AS x FROM steps WHERE phase = 'val'),
    """ + least_squares("fitted", "series_id, h", "r", "CASE WHEN i > 1 THEN 10 ELSE 0 END") + f"""
    SELECT series_id, ts, h AS step, round(last + {inner('b', '[1, x1, x7]')}, 2) + 0.0 AS corrected
    FROM steps JOIN r USING (series_id, h) WHERE phase = 'test'""", PHASED)
def r_steps(spark, folder):
    rows = over_blocks(
        phased(spark, folder), PANEL,
        lambda w: {"x7": F.lag("value", 6).over(w) / 1e5, "y_true": F.array(*[F.lead("value", h).over(w) for h in (1, 2, 3)])}, before=6, after=3,
    )
    rows = rows.where("pos >= 6 AND pos < n - 3").withColumns({"x1": F.col("value") / 1e5, "yhat": F.array_repeat("value", 3)})
    params = fit_step_residual(rows, PANEL, ["x1", "x7"], 3, alpha=10.0)
    out = apply_step_residual(rows.where("phase = 'test'"), params, PANEL, ["x1", "x7"])
    steps = out.select("series_id", "ts", F.posexplode("corrected").alias("step", "corrected")).withColumn("step", F.col("step") + 1)
    return steps.withColumn("corrected", F.round("corrected", 2) + 0.0)


SEEN, AHEAD = 96, 24
HORIZON = f"{SCALED} lists"


def _horizon_sql(steps: int = AHEAD, channels: str = "z") -> str:
    """Forecasts ``pred`` of all windows of ``SEEN`` rows; the sums of products are those of whole columns of training windows."""
    names = channels.split()
    inputs = 1 + SEEN * len(names)
    every = " UNION ALL ".join(
        f"SELECT series_id, {2 + c * SEEN} + o AS i, {name}[o + 1:o + w] AS c FROM sizes CROSS JOIN range({SEEN}) r(o)" for c, name in enumerate(names)
    )
    window = ", ".join(f"{name}[o + 1:o + {SEEN}]" for name in names)
    joined = f"flatten([[1.0::DOUBLE], {window}])"
    return f"""
    WITH sizes AS (SELECT *, n * 6 // 10 - {SEEN + steps} + 1 AS w FROM lists),
    parts AS (SELECT series_id, 1 AS i, [1.0::DOUBLE FOR x IN range(w)] AS c FROM sizes UNION ALL {every}
      UNION ALL SELECT series_id, {inputs + 1} + h AS i, z[h + {SEEN + 1}:h + {SEEN} + w] AS c FROM sizes CROSS JOIN range({steps}) r(h)),
    lines AS (SELECT a.series_id, a.i, list(list_inner_product(a.c, b.c) + CASE WHEN a.i = b.i THEN 1 ELSE 0 END ORDER BY b.i) AS line
      FROM parts a JOIN parts b USING (series_id) WHERE a.i <= {inputs} GROUP BY 1, 2),
    solving AS (SELECT series_id, 1 AS k, i, line FROM lines UNION ALL
      SELECT t.series_id, t.k + 1, t.i, CASE WHEN t.i = t.k THEN [t.line[j] / p.line[1] FOR j IN range(2, len(t.line) + 1)]
             ELSE [t.line[j] - t.line[1] * p.line[j] / p.line[1] FOR j IN range(2, len(t.line) + 1)] END
      FROM solving t JOIN solving p ON t.series_id = p.series_id AND p.i = t.k WHERE t.k <= {inputs}),
    f AS (SELECT series_id, h + 1 AS h, list(line[h + 1] ORDER BY i) AS b
      FROM solving CROSS JOIN range({steps}) r(h) WHERE k = {inputs + 1} GROUP BY 1, 2),
    seen AS (SELECT series_id, n, o AS origin, {joined} AS u FROM lists CROSS JOIN LATERAL (SELECT unnest(range(n - {SEEN} + 1)) AS o)),
    pred AS (SELECT p.series_id, origin, h, origin + {SEEN - 1} + h AS pos, p.n, list_inner_product(b, u) * s + m AS yhat
             FROM seen p JOIN f USING (series_id) JOIN scaler USING (series_id))"""


@query("m11_horizon_forecast", _horizon_sql() + """
    SELECT pred.series_id, origin, h AS step, ts, round(value, 2) AS y_true, round(yhat, 2) AS yhat
    FROM pred JOIN phased USING (series_id, pos) WHERE origin + 120 <= pred.n""", HORIZON)
def m_horizon(spark, folder):
    rows = phased(spark, folder)
    out = horizon.predict_rolling(rows, horizon.fit_horizon(rows, TARGET, SEEN, AHEAD), TARGET, SEEN, AHEAD)
    return rounded(out, 2, "y_true", "yhat").select("series_id", "origin", F.col("step"), "ts", "y_true", "yhat")


@query("m11_covariate_forecast", _horizon_sql(channels="z zo") + """
    SELECT pred.series_id, origin, h AS step, ts, round(value, 2) AS y_true, round(yhat, 2) AS yhat
    FROM pred JOIN phased USING (series_id, pos) WHERE origin + 120 <= pred.n AND origin % 24 = 0""", HORIZON)
def m_covariates(spark, folder):
    rows = phased(spark, folder)
    out = horizon.predict_rolling(rows, horizon.fit_horizon(rows, PANEL, SEEN, AHEAD), PANEL, SEEN, AHEAD, step=AHEAD)
    return rounded(out, 2, "y_true", "yhat").select("series_id", "origin", "step", "ts", "y_true", "yhat")


@query("m12_next_horizon", _horizon_sql() + """
    SELECT series_id, CAST(h AS INTEGER) AS step, hi + INTERVAL 1 DAY * h AS ts, round(yhat, 2) AS yhat
    FROM pred JOIN (SELECT series_id, max(ts) AS hi FROM phased GROUP BY 1) USING (series_id) WHERE origin = n - 96""", HORIZON)
def m_next(spark, folder):
    rows = phased(spark, folder)
    out = horizon.predict_next(rows, horizon.fit_horizon(rows, TARGET, SEEN, AHEAD), TARGET, SEEN, "day")
    return rounded(out, 2, "yhat")


@query("m13_rolling_forecast", _horizon_sql() + """
    SELECT pred.series_id, ts, round(arg_max(value, origin), 2) AS y_true, round(arg_max(yhat, origin), 2) AS yhat
    FROM pred JOIN phased USING (series_id, pos) WHERE origin + 120 <= pred.n AND origin % 24 = 0 GROUP BY 1, 2""", HORIZON)
def m_rolling(spark, folder):
    rows = phased(spark, folder)
    params = horizon.fit_horizon(rows, TARGET, SEEN, AHEAD)
    return rounded(horizon.rolling_forecast(rows, params, TARGET, SEEN, AHEAD), 2, "y_true", "yhat")


@query("m14_segment_forecast", _horizon_sql() + """
    , seg AS (SELECT pred.series_id, phase, origin, ts, value, yhat * 1.05 + 100 AS yhat
              FROM pred JOIN phased USING (series_id, pos) WHERE origin + 120 <= pred.n),
    fit AS (SELECT series_id, avg(value - yhat) AS intercept FROM seg WHERE phase = 'val' GROUP BY 1)
    SELECT series_id, ts, round(avg(value), 2) AS y_true, round(avg(yhat + intercept), 2) AS yhat FROM seg JOIN fit USING (series_id) GROUP BY 1, 2""", HORIZON)
def m_segment(spark, folder):
    rows = phased(spark, folder)
    params = horizon.fit_horizon(rows, TARGET, SEEN, AHEAD)
    steps = horizon.predict_rolling(rows, params, TARGET, SEEN, AHEAD).withColumn("yhat", F.col("yhat") * 1.05 + 100)
    val = steps.join(rows.where("phase = 'val'").select("series_id", "pos"), ["series_id", "pos"])
    residual = fit_residual(val, TARGET, "bias", phase=None)
    out = horizon.segment_forecast(rows, params, TARGET, SEEN, AHEAD, calibration=(1.05, 100.0), residual=residual)
    return rounded(out, 2, "y_true", "yhat")


@query("m15_dense_last", _horizon_sql(1) + """
    SELECT pred.series_id, ts, pos, round(value, 2) AS y_true, round(yhat, 2) AS yhat
    FROM pred JOIN phased USING (series_id, pos) WHERE pos >= pred.n - 200""", HORIZON)
def m_dense(spark, folder):
    rows = phased(spark, folder)
    out = horizon.dense_last(rows, horizon.fit_horizon(rows, TARGET, SEEN, 1), TARGET, SEEN, 200)
    return rounded(out, 2, "y_true", "yhat")


@query("m16_naive", "SELECT series_id, ts, phase, y_true, yhat FROM naive", f"{PHASED} naive")
def m_naive(spark, folder):
    return naive_forecast(daily_orders(spark, folder), PANEL).select("series_id", "ts", "phase", "y_true", "yhat")


@query("m16_naive_shipments", "SELECT pos, value AS y_true, lag(value) OVER (ORDER BY pos) AS yhat FROM shipments", "shipments")
def m_naive_shipments(spark, folder):
    rows = with_pos(shipments(spark, folder), SHIPMENTS)
    return naive_forecast(rows, SHIPMENTS, block=8192).select("pos", "y_true", "yhat")


@query("m17_model_comparison")
def m_models(spark, folder):
    panel = phased(spark, folder)
    chosen = {"naive": {}, "lstm": {}, "informer": {"seq_len": 14, "pred_len": 4}, "arima": {"mode": "plain"}}
    scores = None
    for model, settings in chosen.items():
        rows, _ = dispatch.forecast(panel, TARGET, model, stored=True, **settings)
        scored = metrics.evaluate(rows, ["model", "series_id", "phase"], "rmse", "mae", "mape_masked")
        scores = scored if scores is None else scores.unionByName(scored)
    return scores


@query("m17_event_forecast", f"""
    WITH filled AS (SELECT g.series_id, g.ts, coalesce(value, 0) AS value, row_number() OVER (PARTITION BY g.series_id ORDER BY g.ts) - 1 AS pos,
                           count(*) OVER (PARTITION BY g.series_id) AS n FROM (
        SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM event_days GROUP BY 1) g
      LEFT JOIN event_days d ON g.series_id = d.series_id AND g.ts = d.ts),
    ph AS (SELECT *, CASE WHEN pos < n*6//10 THEN 'train' WHEN pos < n*6//10 + n*2//10 THEN 'val' ELSE 'test' END AS phase FROM filled),
    sc AS (SELECT series_id, avg(value) AS m, stddev_pop(value) AS s FROM ph WHERE phase = 'train' GROUP BY 1),
    zs AS (SELECT ph.*, (value - m) / s AS z, s FROM ph JOIN sc USING (series_id)),
    design AS (SELECT * FROM (SELECT series_id, ts, pos, phase, value, s, lag(value) OVER w AS known,
        [1, lag(z, 3) OVER w, lag(z, 2) OVER w, lag(z, 1) OVER w, z - lag(z) OVER w] AS x FROM zs WINDOW w AS (PARTITION BY series_id ORDER BY ts))
      WHERE pos >= 3),
    train AS (SELECT * FROM design WHERE phase = 'train'),
    """ + least_squares("train", "series_id", "f", "CASE WHEN i > 1 THEN 1 ELSE 0 END") + f"""
    SELECT series_id, ts, pos, phase, round(value, 2) AS y_true, round(known + s * {inner('b', 'x')}, 5) AS yhat, 'lstm' AS model
    FROM design JOIN f USING (series_id) WHERE phase <> 'train'""", "event_days")
def m_events(spark, folder):
    rows, _ = dispatch.forecast(daily_events(spark, folder), EVENTS, "lstm", seq_len=3)
    return rounded(rounded(rows, 2, "y_true"), 5, "yhat")
