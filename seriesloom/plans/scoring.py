"""Metrics, calibration, residual models."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.operators import metrics, post
from seriesloom.operators.models.naive import naive_forecast
from seriesloom.plans.frames import fixed_forecast
from seriesloom.plans.registry import FC, PHASED, query, rounded
from seriesloom.session import run_folder
from seriesloom.sources import sink
from seriesloom.sources.series import EVENTS, PANEL, daily_orders, hourly_users, orders_by_day

BY = ["series_id", "phase"]


def scored(spark, folder):
    return fixed_forecast(spark, folder).where("phase <> 'train'")


EVALUATED = "SELECT series_id, phase, {0} FROM fc WHERE phase <> 'train' GROUP BY 1, 2"
RMSE = "sqrt(avg((y_true - {0}) * (y_true - {0})))"
CLASSIC = "avg(abs(y_true - {0}) / greatest(abs(y_true), 2.220446049250313e-16::DOUBLE))"


@query("g01_rmse", EVALUATED.format(f"round({RMSE.format('yhat')}, 3) AS rmse"), FC)
def g_rmse(spark, folder):
    return rounded(metrics.evaluate(scored(spark, folder), BY, "rmse"), 3, "rmse")


@query("g02_mape_masked", EVALUATED.format(
    "round(avg(abs(y_true - yhat) / (abs(y_true) + 1e-8)) FILTER (abs(y_true) > 1e-8), 8) AS mape_masked"), FC)
def g_mape_masked(spark, folder):
    return rounded(metrics.evaluate(scored(spark, folder), BY, "mape_masked"), 8, "mape_masked")


@query("g03_mape_safe", EVALUATED.format(
    "round(avg(abs(y_true - yhat) / (abs(y_true) + 1e-8)) FILTER (abs(y_true) > 1e-8 AND isfinite(yhat)), 8) AS mape_safe"), FC)
def g_mape_safe(spark, folder):
    return rounded(metrics.evaluate(scored(spark, folder), BY, "mape_safe"), 8, "mape_safe")


# Zero truths make this error astronomically large, so only its leading digits are compared.
@query("g04_mape_classic_rmse", EVALUATED.format(
    f"round(log10({CLASSIC.format('yhat')}), 8) AS log_mape, round({RMSE.format('yhat')}, 3) AS rmse"), FC)
def g_mape_classic(spark, folder):
    out = metrics.evaluate(scored(spark, folder), BY, "mape_classic", "rmse")
    return rounded(out, 3, "rmse").withColumn("log_mape", F.round(F.log10("mape_classic"), 8)).drop("mape_classic")


@query("g05_mape_eps", EVALUATED.format("round(log10(avg(abs(y_true - yhat) / (abs(y_true) + 1e-8))), 8) AS log_mape"), FC)
def g_mape_eps(spark, folder):
    out = metrics.evaluate(scored(spark, folder), BY, "mape_eps")
    return out.withColumn("log_mape", F.round(F.log10("mape_eps"), 8)).drop("mape_eps")


@query("g06_mape_stable", EVALUATED.format("round(log10(avg(abs(y_true - yhat) / greatest(abs(y_true), 1e-3))), 8) AS log_mape"), FC)
def g_mape_stable(spark, folder):
    out = metrics.evaluate(scored(spark, folder), BY, "mape_stable")
    return out.withColumn("log_mape", F.round(F.log10("mape_stable"), 8)).drop("mape_stable")


@query("g07_online_metrics", """
    SELECT series_id, count(yhat) AS n_points, round(sqrt(avg((yhat - y_true) * (yhat - y_true))), 3) AS rmse,
           round(avg(abs((yhat - y_true) / y_true)) FILTER (y_true <> 0) * 100, 6) AS mape_percent FROM naive GROUP BY 1""", f"{PHASED} naive")
def g_online(spark, folder):
    out = naive_forecast(daily_orders(spark, folder), PANEL).groupBy("series_id").agg(
        F.count("yhat").alias("n_points"), metrics.rmse().alias("rmse"), metrics.mape_percent().alias("mape_percent")
    )
    return rounded(rounded(out, 3, "rmse"), 6, "mape_percent")


@query("g08_mae", EVALUATED.format("round(avg(abs(y_true - yhat)), 4) AS mae"), FC)
def g_mae(spark, folder):
    return rounded(metrics.evaluate(scored(spark, folder), BY, "mae"), 4, "mae")


@query("g09_pair_metrics", """
    SELECT series_id, phase, count(*) AS n_pairs, round(sqrt(avg((y_true - yhat) * (y_true - yhat))), 3) AS rmse,
           round(avg(abs(y_true - yhat) / (abs(y_true) + 1e-8)) FILTER (abs(y_true) > 1e-8), 8) AS mape
    FROM naive WHERE yhat IS NOT NULL GROUP BY 1, 2""", f"{PHASED} naive")
def g_pairs(spark, folder):
    """Source, regular grid, phases, naive forecast and metrics in one plan."""
    out = metrics.evaluate_pairs(naive_forecast(daily_orders(spark, folder), PANEL), BY)
    return rounded(rounded(out, 3, "rmse"), 8, "mape")


@query("g09_user_pair_metrics", """
    WITH counted AS (SELECT CAST(user_id AS VARCHAR) AS series_id, date_trunc('hour', ts) AS ts, CAST(count(*) AS DOUBLE) AS value
                     FROM events GROUP BY 1, 2),
    hours AS (SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM counted GROUP BY 1),
    users AS (SELECT h.series_id, h.ts, coalesce(value, 0) AS y_true, row_number() OVER w - 1 AS pos,
                     count(*) OVER (PARTITION BY h.series_id) AS n, lag(coalesce(value, 0)) OVER w AS yhat
              FROM hours h LEFT JOIN counted c ON h.series_id = c.series_id AND h.ts = c.ts
              WINDOW w AS (PARTITION BY h.series_id ORDER BY h.ts))
    SELECT series_id, CASE WHEN pos < n*6//10 THEN 'train' WHEN pos < n*6//10 + n*2//10 THEN 'val' ELSE 'test' END AS phase,
           count(*) AS n_pairs, round(sqrt(avg((y_true - yhat) * (y_true - yhat))), 8) AS rmse,
           round(avg(abs(y_true - yhat) / (abs(y_true) + 1e-8)) FILTER (abs(y_true) > 1e-8), 8) AS mape
    FROM users WHERE yhat IS NOT NULL GROUP BY 1, 2""")
def g_user_pairs(spark, folder):
    out = metrics.evaluate_pairs(naive_forecast(hourly_users(spark, folder), EVENTS), BY)
    return rounded(out, 8, "rmse", "mape")


FITTED = """
    WITH v AS (SELECT series_id, y_true - yhat AS r, yhat AS x FROM fc WHERE phase = 'val'),
    fit AS (SELECT series_id, {0} AS slope, avg(r) AS mr, avg(x) AS mx FROM v GROUP BY 1),
    cor AS (SELECT f.*, slope, mr - slope * mx AS intercept, yhat + slope * yhat + mr - slope * mx AS corrected
            FROM fc f JOIN fit USING (series_id) WHERE phase <> 'train')"""
SLOPES = {
    "bias": "0.0::DOUBLE",
    "linear": "regr_slope(r, x)",
    "ridge": "count(*) * covar_pop(r, x) / (count(*) * var_pop(x) + 1)",
    "lasso": "sign(covar_pop(r, x)) * greatest(abs(covar_pop(r, x)) - 1, 0) / var_pop(x)",
}


def corrected(spark, folder, kind):
    rows = scored(spark, folder)
    return post.apply_residual(rows, post.fit_residual(rows, PANEL, kind), PANEL)


@query("g10_comparison", FITTED.format(SLOPES["linear"]) + f"""
    SELECT series_id, phase, round(log10({CLASSIC.format('yhat')}), 8) AS raw_mape, round({RMSE.format('yhat')}, 3) AS raw_rmse,
           round(log10({CLASSIC.format('corrected')}), 8) AS corrected_mape, round({RMSE.format('corrected')}, 3) AS corrected_rmse,
           round({RMSE.format('yhat')} - {RMSE.format('corrected')}, 3) AS improvement_rmse FROM cor GROUP BY 1, 2""", FC)
def g_compare(spark, folder):
    out = metrics.compare(corrected(spark, folder, "linear"), BY).drop("improvement_mape")
    logs = {c: F.round(F.log10(c), 8) for c in ("raw_mape", "corrected_mape")}
    return rounded(out, 3, "raw_rmse", "corrected_rmse", "improvement_rmse").withColumns(logs)


@query("g11_ljung_box", """
    WITH r AS (SELECT series_id, pos, y_true - yhat AS e FROM fc WHERE phase = 'val'),
    c AS (SELECT series_id, pos, e - avg(e) OVER (PARTITION BY series_id) AS e FROM r),
    s AS (SELECT series_id, count(*) AS n_rows, greatest(1, least(10, count(*) // 4)) AS lag, sum(e * e) AS v FROM c GROUP BY 1),
    ks AS (SELECT unnest(generate_series(1, 10)) AS k),
    p AS (SELECT a.series_id, k, sum(a.e * b.e) AS ck FROM c a CROSS JOIN ks JOIN c b ON a.series_id = b.series_id AND a.pos = b.pos + k GROUP BY 1, 2),
    q AS (SELECT series_id, n_rows, lag, n_rows * (n_rows + 2) * sum((ck / v) * (ck / v) / (n_rows - k)) AS q
          FROM s JOIN p USING (series_id) WHERE k <= lag GROUP BY series_id, n_rows, lag)
    SELECT series_id, n_rows, lag, round(q, 5) AS q,
           round(exp(-q / 2) * (1 + q / 2 + pow(q / 2, 2) / 2 + pow(q / 2, 3) / 6 + pow(q / 2, 4) / 24), 8) AS p_value,
           exp(-q / 2) * (1 + q / 2 + pow(q / 2, 2) / 2 + pow(q / 2, 3) / 6 + pow(q / 2, 4) / 24) > 0.05 AS uncorrelated
    FROM q""", FC)
def g_ljung_box(spark, folder):
    val = scored(spark, folder).where("phase = 'val'")
    return rounded(rounded(metrics.ljung_box(val, PANEL), 5, "q"), 8, "p_value")


@query("g13_threshold_gate", """
    SELECT series_id, phase, rmse <= 200000 AND mape <= 0.9 AS both_pass, rmse <= 200000 OR mape <= 0.9 AS any_pass FROM (
      SELECT series_id, phase, sqrt(avg((y_true - yhat) * (y_true - yhat))) AS rmse,
             avg(abs(y_true - yhat) / (abs(y_true) + 1e-8)) FILTER (abs(y_true) > 1e-8) AS mape FROM fc GROUP BY 1, 2)""", FC)
def g_gate(spark, folder):
    scores = metrics.evaluate_pairs(fixed_forecast(spark, folder), BY)
    return scores.select(
        *BY, metrics.passes(200_000, 0.9).alias("both_pass"), metrics.passes(200_000, 0.9, "or").alias("any_pass")
    )


CONFIGS = "CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS config)"
CONFIG_YHAT = "yhat * (0.8 + 0.1 * config)"


@query("g14_t03_best_config", f"""
    SELECT series_id, config, round(rmse, 3) AS rmse FROM (
      SELECT series_id, config, sqrt(avg((y_true - {CONFIG_YHAT}) * (y_true - {CONFIG_YHAT}))) AS rmse
      FROM fc {CONFIGS} WHERE phase = 'val' GROUP BY 1, 2)
    QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY rmse, config) = 1""", FC)
def g_best(spark, folder):
    tried = scored(spark, folder).where("phase = 'val'").withColumn("config", F.explode(F.lit([0, 1, 2, 3])))
    tried = tried.withColumn("yhat", F.col("yhat") * (0.8 + 0.1 * F.col("config")))
    scores = metrics.evaluate(tried, ["series_id", "config"], "rmse")
    return rounded(metrics.best(scores, ["series_id"], "rmse", "config"), 3, "rmse")


@query("g15_metric_table", """
    WITH m AS (SELECT series_id, phase, sqrt(avg((y_true - yhat) * (y_true - yhat))) AS rmse,
               avg(abs(y_true - yhat)) AS mae,
               avg(abs(y_true - yhat) / (abs(y_true) + 1e-8)) FILTER (abs(y_true) > 1e-8) AS mape_masked FROM fc GROUP BY 1, 2),
    l AS (SELECT series_id, phase, 'rmse' AS metric, rmse AS score FROM m UNION ALL SELECT series_id, phase, 'mae', mae FROM m
          UNION ALL SELECT series_id, phase, 'mape_masked', mape_masked FROM m)
    SELECT series_id, metric, round(sum(score) FILTER (phase = 'val'), 4) AS val, round(sum(score) FILTER (phase = 'test'), 4) AS test
    FROM l GROUP BY 1, 2""", FC)
def g_table(spark, folder):
    names = ["rmse", "mae", "mape_masked"]
    scores = metrics.long_metrics(metrics.evaluate(scored(spark, folder), BY, *names), BY, names)
    return rounded(metrics.metric_table(scores, ["series_id"]), 4, "val", "test")


@query("p01_clamped", """
    SELECT series_id, ts, round(greatest(1.5 * yhat - 200000, 0), 6) AS yhat FROM fc""", FC)
def p_clamped(spark, folder):
    shifted = fixed_forecast(spark, folder).withColumn("yhat", post.linear("yhat", 1.5, -200_000.0))
    return shifted.select("series_id", "ts", F.round(post.clamp_positive(), 6).alias("yhat"))


TAIL = """
    WITH k AS (SELECT series_id, count_if(phase = 'val') AS nv, greatest(7, least(14, count_if(phase = 'val'))) AS k,
                      max(pos) FILTER (phase = 'val') AS ve, min(pos) FILTER (phase = 'test') AS ts0 FROM fc GROUP BY 1)"""


@query("p03_bias_calibrated", TAIL + """
    , b AS (SELECT series_id, avg(y_true - yhat) AS bias FROM fc JOIN k USING (series_id) WHERE phase = 'val' AND pos > ve - k GROUP BY 1)
    SELECT series_id, ts, phase, round(bias, 3) AS bias, round(CASE WHEN phase = 'train' THEN yhat ELSE yhat + bias END, 3) AS yhat
    FROM fc JOIN b USING (series_id)""", FC)
def p_bias(spark, folder):
    out = post.calibrate_bias(fixed_forecast(spark, folder), PANEL)
    return rounded(out, 3, "yhat", "bias").select("series_id", "ts", "phase", "bias", "yhat")


@query("p04_spread_calibrated", TAIL + """
    , s AS (SELECT series_id, stddev_samp(y_true) FILTER (phase = 'val' AND pos > ve - k) AS st,
                   stddev_samp(yhat) FILTER (phase = 'val' AND pos > ve - k) AS sp,
                   avg(yhat) FILTER (phase = 'val' AND pos > ve - k) AS mv,
                   avg(yhat) FILTER (phase = 'test' AND pos < ts0 + k) AS mt FROM fc JOIN k USING (series_id) GROUP BY 1),
    r AS (SELECT *, least(greatest(st / sp, 0.7), 1.5) AS ratio FROM s)
    SELECT series_id, ts, phase, round(ratio, 8) AS ratio,
           round(CASE phase WHEN 'val' THEN mv + (yhat - mv) * ratio WHEN 'test' THEN mt + (yhat - mt) * ratio ELSE yhat END, 4) AS yhat
    FROM fc JOIN r USING (series_id)""", FC)
def p_spread(spark, folder):
    out = post.calibrate_spread(fixed_forecast(spark, folder), PANEL)
    return rounded(rounded(out, 4, "yhat"), 8, "ratio").select("series_id", "ts", "phase", "ratio", "yhat")


@query("p05_linear_calibrated", "SELECT series_id, ts, round(yhat * 1.1 + 250, 4) AS yhat FROM fc", FC)
def p_linear(spark, folder):
    return fixed_forecast(spark, folder).select("series_id", "ts", F.round(post.linear("yhat", 1.1, 250.0), 4).alias("yhat"))


def _residual(kind):
    def run(spark, folder):
        return rounded(corrected(spark, folder, kind), 3, "corrected").select("series_id", "ts", "phase", "corrected")

    return run


for number, kind in enumerate(SLOPES, 1):
    query(
        f"r0{number}_{kind}_residual",
        FITTED.format(SLOPES[kind]) + " SELECT series_id, ts, phase, round(corrected, 3) AS corrected FROM cor", FC,
    )(_residual(kind))


@query("r06_kept_if_better", FITTED.format(SLOPES["linear"]) + """
    , s AS (SELECT series_id, phase, avg(abs(y_true - yhat) / (abs(y_true) + 1e-8)) AS a,
                   avg(abs(y_true - corrected) / (abs(y_true) + 1e-8)) AS b FROM cor GROUP BY 1, 2)
    SELECT series_id, ts, phase, b < a AS used, round(CASE WHEN b < a THEN corrected ELSE yhat END, 4) AS final
    FROM cor JOIN s USING (series_id, phase)""", FC)
def r_kept(spark, folder):
    out = post.keep_if_better(corrected(spark, folder, "linear"), PANEL, BY)
    return rounded(out, 4, "final").select("series_id", "ts", "phase", "used", "final")


@query("r07_stored_residual", FITTED.format(SLOPES["ridge"]) + """
    SELECT f.series_id, f.ts, round(CASE WHEN f.series_id = '5-LOW' THEN f.yhat ELSE c.corrected END, 4) AS corrected
    FROM fc f JOIN cor c ON f.series_id = c.series_id AND f.ts = c.ts WHERE f.phase = 'test'""", FC)
def r_stored(spark, folder):
    rows = scored(spark, folder)
    fitted = post.fit_residual(rows, PANEL, "ridge").where("series_id <> '5-LOW'")
    path = sink.write_params(fitted, run_folder(spark, "residual"), ["yhat"])
    out = post.apply_residual(rows.where("phase = 'test'"), sink.read_params(spark, path, ["yhat"]), PANEL)
    return rounded(out, 4, "corrected").select("series_id", "ts", "corrected")


@query("r09_joined_correction", """
    SELECT f.series_id, f.ts, round(f.yhat + coalesce(d.n_orders * 100, 0), 3) AS corrected
    FROM fc f LEFT JOIN days d ON f.series_id = d.series_id AND f.ts = d.ts""", FC)
def r_joined(spark, folder):
    given = orders_by_day(spark, folder).withColumn("correction", F.col("n_orders") * 100)
    return rounded(post.add_correction(fixed_forecast(spark, folder), given, PANEL), 3, "corrected").select("series_id", "ts", "corrected")
