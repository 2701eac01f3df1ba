import itertools

import numpy as np
import pandas as pd
import pytest
from helpers import DAY0, column, panel
from pyspark.sql import functions as F

from seriesloom.operators import scale
from seriesloom.operators.gram import gram, regress, square
from seriesloom.operators.models import ar, delta, dispatch, forest, horizon, trend
from seriesloom.operators.split import phase_from_head
from seriesloom.spec import SeriesSpec

SPEC = SeriesSpec()


def simulated(n, ar_terms=(), ma_terms=(), seed=0, start=0.0):
    noise = np.random.default_rng(seed).normal(size=n)
    y = np.zeros(n)
    for t in range(n):
        y[t] = noise[t] + start * (t == 0)
        y[t] += sum(c * y[t - i] for i, c in enumerate(ar_terms, 1) if t >= i)
        y[t] += sum(c * noise[t - i] for i, c in enumerate(ma_terms, 1) if t >= i)
    return y


def lag_matrix(y, p):
    return np.column_stack([np.ones(len(y) - p), *[y[p - i : len(y) - i] for i in range(1, p + 1)]]), y[p:]


def test_gram_with_a_hot_key(spark):
    rng = np.random.default_rng(3)
    data = pd.DataFrame(rng.normal(size=(5000, 3)), columns=["a", "b", "y"])
    data["k"] = np.where(rng.random(5000) < 0.9, "hot", rng.integers(0, 700, 5000).astype(str))
    got = gram(spark.createDataFrame(data).repartition(6), ["k"], ["a", "b", "y"]).toPandas().set_index("k")
    for k, part in data.groupby("k"):
        x = part[["a", "b", "y"]].to_numpy()
        assert got.loc[k, "n"] == len(part)
        assert np.allclose(square(got.loc[k, "cells"], 3), x.T @ x)


def test_collinear_columns_get_the_shortest_solution(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 2))
    data = pd.DataFrame({"k": "k", "a": x[:, 0], "b": x[:, 1], "c": x[:, 0] - x[:, 1], "y": x @ [1.0, 2.0] + 0.1})
    fitted = regress(gram(spark.createDataFrame(data), ["k"], ["a", "b", "c", "y"]), ["k"], ["a", "b", "c", "y"], ["a", "b", "c"], "y")
    want = np.linalg.lstsq(data[["a", "b", "c"]].to_numpy(), data["y"].to_numpy(), rcond=None)[0]
    assert np.allclose(fitted.first().betas, want, atol=1e-6)


def test_order_search_equals_direct_fits(spark):
    y = simulated(2000, (0.6, -0.3))
    tried = {r.p: r for r in ar.order_candidates(panel(spark, {"a": y}), SPEC, 4).collect()}
    for p in range(5):
        x, target = lag_matrix(y, 4)
        b, rss = np.linalg.lstsq(x[:, : p + 1], target, rcond=None)[:2]
        assert np.allclose(tried[p].betas[: p + 1], b) and np.isclose(tried[p].rss, rss[0])
        assert np.isclose(tried[p].aic, len(target) * np.log(rss[0] / len(target)) + 2 * (p + 1))
    best = ar.fit_plain(panel(spark, {"a": y}), SPEC, 4).first()
    assert best.p >= 2 and abs(best.betas[1] - 0.6) < 0.06 and abs(best.betas[2] + 0.3) < 0.06


def test_difference_orders(spark):
    walk = np.cumsum(simulated(1500, seed=1))
    seasonal = np.tile([5.0, 0, 0, 9, 0, -4, 1], 200) + 0.1 * simulated(1400, seed=2)
    df = panel(spark, {"noise": simulated(1500, seed=3), "walk": walk, "twice": np.cumsum(walk), "week": seasonal, "short": [1, 2, 3]})
    got = {r.series_id: (r.d, r.seasonal_d) for r in ar.difference_orders(df, SPEC).collect()}
    assert got["noise"] == (0, 0) and got["walk"] == (1, 0) and got["twice"][0] == 2
    assert got["week"][1] == 1 and got["short"] == (1, 0)


# Worked out by hand for a season of 7: largest p, q, seasonal p and q by the length of the series.
BOUNDS = {
    (5, 5, 2, 2): {5: (1, 1, 0, 0), 13: (1, 1, 0, 0), 60: (2, 2, 1, 1), 199: (2, 2, 1, 1), 200: (4, 4, 2, 2), 5000: (4, 4, 2, 2)},
    (7, 3, 1, 2): {5: (1, 1, 0, 0), 13: (1, 1, 0, 0), 60: (2, 2, 1, 1), 199: (2, 2, 1, 1), 200: (5, 3, 1, 2), 5000: (6, 3, 1, 2)},
}


@pytest.mark.parametrize("limits", sorted(BOUNDS))
def test_order_bounds(spark, limits):
    lengths = spark.createDataFrame([(n,) for n in BOUNDS[limits]], "n bigint")
    got = {r.n: r for r in ar.order_bounds(lengths, 7, *limits).collect()}
    for n, expected in BOUNDS[limits].items():
        assert (got[n].max_p, got[n].max_q, got[n].max_sp, got[n].max_sq) == expected
        assert got[n].small_sample == (n < 200)


def test_smart_model_reaches_the_noise_level(spark):
    y = {"ma": simulated(2000, (), (0.8,), 5), "ar": simulated(2000, (0.7,), (), 6), "walk": np.cumsum(simulated(2000, (), (0.5,), 7))}
    df = panel(spark, y).withColumn("phase", phase_from_head())
    params = ar.fit_smart(df.where("phase = 'train'"), SPEC)
    chosen = {r.series_id: r for r in params.collect()}
    assert chosen["walk"].d == 1 and chosen["ma"].d == 0 and chosen["ar"].d == 0
    scored = ar.one_step_smart(df, params, SPEC).where("phase = 'test'")
    errors = scored.groupBy("series_id").agg(F.sqrt(F.avg((F.col("value") - F.col("yhat")) ** 2)).alias("rmse")).collect()
    assert len(errors) == 3
    for r in errors:
        assert 0.9 < r.rmse < 1.12, r


@pytest.mark.parametrize("block", [8, 33, 10_000])
@pytest.mark.parametrize("every", [1, 3])
def test_rolling_refit_equals_direct_refits(spark, block, every):
    y = simulated(120, (0.5, 0.2), seed=8)
    df = panel(spark, {"a": y, "b": simulated(9, seed=1)}).withColumn("phase", phase_from_head())
    rows = ar.rolling_refit(df, SPEC, p=2, every=every, block=block).where("series_id = 'a'").orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(72, 120))
    for r in rows:
        start = 72 if r.pos < 96 else 96
        origin = r.pos - (r.pos - start) % every
        assert r.refit_pos == origin
        x, target = lag_matrix(y[:origin], 2)
        b = np.linalg.lstsq(x, target, rcond=None)[0]
        assert np.isclose(r.yhat, b @ [1.0, y[r.pos - 1], y[r.pos - 2]])


def test_rolling_refit_with_too_little_history(spark):
    df = panel(spark, {"b": [3.0, 1.0, 2.0, 5.0, 4.0]}).withColumn("phase", F.lit("test"))
    rows = ar.rolling_refit(df, SPEC, p=1, every=1).orderBy("pos").collect()
    assert rows[0].yhat == 3.0 and rows[1].yhat == 1.0


def test_trend_and_season_are_recovered(spark):
    t = np.arange(1200)
    wave = np.sin(2 * np.pi * (t + 18262) / 365.25)
    bend = 100 + 0.05 * t + 0.1 * np.maximum(0, t - 300)
    df = panel(spark, {"add": bend + 8 * wave, "mul": bend * (1 + 0.08 * wave)}).withColumn("phase", phase_from_head())
    for mode, name in (("additive", "add"), ("multiplicative", "mul")):
        params = trend.fit_trend(df, SPEC, mode=mode, changepoint_scale=0.5)
        got = trend.predict_trend(df.where("phase = 'train'"), params, SPEC).where(F.col("series_id") == name)
        error = got.agg(F.max(F.abs(F.col("value") - F.col("yhat")))).first()[0]
        assert error < 1.5, (mode, error)


def test_trend_search_agrees_with_single_fits(spark):
    t = np.arange(500)
    df = panel(spark, {"a": 50 + 0.1 * t + 5 * np.cos(t / 20) + simulated(500, seed=2)}).withColumn("phase", phase_from_head())
    grid = {"changepoint_scale": (0.05, 0.5), "n_changepoints": (15, 25), "mode": ("additive", "multiplicative"), "seasonality_scale": (5.0, 10.0)}
    scores = trend.search_trend(df, SPEC, grid=grid).collect()
    assert sorted(r.config for r in scores) == list(range(16))
    order = list(itertools.product(*grid.values()))
    for r in scores:
        assert order[r.config] == (r.changepoint_scale, r.n_changepoints, r.mode, r.seasonality_scale)
    for config in (2, 15):
        r = next(s for s in scores if s.config == config)
        shape = trend.Shape(r.n_changepoints)
        params = trend.fit_trend(df, SPEC, shape, r.changepoint_scale, r.seasonality_scale, r.mode)
        one = trend.predict_trend(df.where("phase = 'val'"), params, SPEC, shape)
        assert np.isclose(one.agg(F.avg(F.abs(F.col("value") - F.col("yhat")) / F.abs("value"))).first()[0], r.mape)
    assert trend.best_trend(trend.search_trend(df, SPEC, grid=grid), SPEC).first().mape == min(s.mape for s in scores)


def test_change_forecast_equals_ridge(spark):
    y = simulated(200, (0.5,), seed=9) + 10
    df = panel(spark, {"a": y}).withColumn("phase", phase_from_head())
    got = column(delta.predict_delta(df, delta.fit_delta(df, SPEC, 4, 2.0), SPEC, 4), "yhat")
    mean, std = y[:120].mean(), y[:120].std()
    z = (y - mean) / std
    x = np.column_stack([np.ones(196), *[z[4 - i : 200 - i] for i in range(4, 0, -1)]])
    change = z[4:] - z[3:-1]
    b = np.linalg.solve(x[:116].T @ x[:116] + np.diag([0, 2, 2, 2, 2]), x[:116].T @ change[:116])
    assert np.allclose(got, y[3:-1] + std * (x @ b))


def test_window_residual_equals_lstsq(spark):
    y = simulated(150, (0.4,), seed=10)
    df = panel(spark, {"a": y}).withColumn("phase", phase_from_head())
    forecast = df.select("series_id", "ts", "pos", "phase", F.col("value").alias("y_true"), (F.col("value") * 0.5 + 1).alias("yhat"))
    got = delta.apply_window_residual(df, forecast, delta.fit_window_residual(df, forecast, SPEC, 3), SPEC, 3)
    x = np.column_stack([y[0:-3], y[1:-2], y[2:-1], y[2:-1] - y[1:-2]])
    miss = y[3:] - (y[3:] * 0.5 + 1)
    val = slice(90 - 3, 120 - 3)
    b = np.linalg.lstsq(x[val], miss[val], rcond=None)[0]
    want = y * 0.5 + 1
    want[3:] += x @ b
    assert np.allclose(column(got, "corrected"), want)


def test_horizon_forecast_equals_ridge_and_ignores_the_future(spark):
    y = simulated(150, (0.7,), seed=11) + 5
    df = panel(spark, {"a": y}).withColumn("phase", phase_from_head())
    params = horizon.fit_horizon(df, SPEC, 5, 3, penalty=0.5)
    got = horizon.predict_rolling(df, params, SPEC, 5, 3).toPandas().set_index(["origin", "step"])
    mean, std = y[:90].mean(), y[:90].std()
    z = (y - mean) / std
    train = [i for i in range(150) if i + 5 + 3 <= 90]
    x = np.array([[1, *z[i : i + 5]] for i in train])
    for h in (1, 3):
        target = np.array([z[i + 4 + h] for i in train])
        b = np.linalg.solve(x.T @ x + 0.5 * np.eye(6), x.T @ target)
        assert np.isclose(got.loc[(100, h), "yhat"], mean + std * (b @ [1, *z[100:105]]))
    assert got.index.get_level_values("origin").max() == 142
    changed = df.withColumn("value", F.when(F.col("pos") >= 120, 1e6).otherwise(F.col("value")))
    again = horizon.predict_rolling(changed, horizon.fit_horizon(changed, SPEC, 5, 3, 0.5), SPEC, 5, 3).toPandas().set_index(["origin", "step"])
    early = [i for i in got.index if i[0] + 5 <= 120]
    assert np.allclose(got.loc[early, "yhat"], again.loc[early, "yhat"])
    last = horizon.predict_next(df, params, SPEC, 5, "day").orderBy("step").collect()
    assert [str(r.ts)[:10] for r in last] == ["2020-05-30", "2020-05-31", "2020-06-01"]
    one = horizon.fit_horizon(df, SPEC, 5, 1)
    dense = column(horizon.dense_last(df, one, SPEC, 5, 10), "pos")
    assert dense == list(range(140, 150))


def test_forest_learns_and_search_is_repeatable(spark):
    y = 20 + 5 * np.sin(np.arange(300) / 5)
    df = panel(spark, {"a": y, "b": y * 3}).withColumn("phase", phase_from_head())
    rows = forest.lag_design(df, SPEC, 5)
    train = rows.where("phase = 'train'")
    model = forest.fit_forest(train, SPEC, 5, n_estimators=10, max_depth=6)
    scored = forest.predict_forest(model, rows.where("phase = 'test'"), SPEC)
    assert scored.agg(F.avg(F.abs(F.col("y_true") - F.col("yhat")) / F.col("y_true"))).first()[0] < 0.05
    space = forest.SPACE | {"n_estimators": (3,), "max_depth": (3, 4)}
    first = forest.search_forest(train, SPEC, 2, 2, 5, space=space).orderBy("trial").collect()
    assert first == forest.search_forest(train, SPEC, 2, 2, 5, space=space).orderBy("trial").collect()
    settings = forest.best_settings(spark.createDataFrame(first))
    assert settings["n_estimators"] == 3 and set(settings) == set(forest.DEFAULTS)
    assert len(list(forest.random_settings(50))) == 50


def test_every_model_by_name(spark):
    y = 30 + 5 * np.sin(np.arange(260) / 6) + simulated(260, seed=12)
    df = panel(spark, {"a": y, "b": y[:200] + 10})
    small = {
        "informer": {"seq_len": 8, "pred_len": 3}, "randomforest": {"n_estimators": 5, "max_depth": 4, "n_lags": 4},
        "prophet": {"n_changepoints": 5, "seasonalities": ("weekly",)}, "arima": {"max_p": 2, "max_q": 1, "max_sp": 1, "max_sq": 0},
    }
    for model in dispatch.MODELS:
        rows, _ = dispatch.forecast(df, SPEC, model, **small.get(model, {}))
        counts = {(r[0], r[1]): r[2] for r in rows.groupBy("series_id", "phase").count().collect()}
        assert counts[("a", "val")] == 52 and counts[("b", "val")] == 40, (model, counts)
        assert rows.columns == ["series_id", "ts", "pos", "phase", "y_true", "yhat", "model"]
        error = rows.agg(F.sqrt(F.avg((F.col("y_true") - F.col("yhat")) ** 2))).first()[0]
        assert error < 12, (model, error)
    with pytest.raises(ValueError):
        dispatch.forecast(df, SPEC, "oracle")


def test_a_long_series_is_scored_like_a_short_block(spark):
    y = simulated(400, (0.6,), seed=13)
    df = panel(spark, {"a": y})
    params = ar.fit_plain(df, SPEC, 3)
    got = column(ar.one_step(df, params, SPEC, 3), "yhat")
    b = params.first().betas
    x, _ = lag_matrix(y, 3)
    assert np.allclose(got, x @ b)


def test_imputation_uses_training_rows_only(spark):
    df = panel(spark, {"a": [1.0, None, 3.0, 100.0, None]}, {"phase": F.when(F.col("pos") < 3, "train").otherwise("test")})
    assert column(scale.impute_mean(df, SPEC, ["value"]), "value") == [1.0, 2.0, 3.0, 100.0, 2.0]
    assert DAY0.day == 1
