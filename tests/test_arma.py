"""Moving-average fits, rolling order searches, the seasonal-root test, sparse trends and NULL keys."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom import SeriesSpec
from seriesloom.operators import features
from seriesloom.operators.gram import sparse_solved
from seriesloom.operators.models import ar, arma, trend
from seriesloom.operators.models.dispatch import forecast
from seriesloom.operators.split import phase_from_head
from helpers import column, panel

SPEC = SeriesSpec()


def noise_model(n, seed, ar_part=(), ma_part=None, level=0.0):
    """A simulated series; ``ma_part`` maps lags to coefficients."""
    rng = np.random.default_rng(seed)
    e, y = rng.normal(size=n), np.zeros(n)
    for t in range(n):
        y[t] = level + e[t] + sum(p * y[t - i] for i, p in enumerate(ar_part, 1) if t >= i)
        y[t] += sum(c * e[t - lag] for lag, c in (ma_part or {}).items() if t >= lag)
    return y


def residuals(w, names, betas):
    """The recursion row by row; rows without their lags have the residual 0."""
    e, known = np.zeros(len(w)), np.zeros(len(w), bool)
    reach = max([int(c[2:]) for c in names if c.startswith("w_")], default=0)
    for t in range(reach, len(w)):
        x = [1.0 if c == "one" else w[t - int(c[2:])] if c[0] == "w" else (e[t - int(c[2:])] if t >= int(c[2:]) else 0.0) for c in names]
        if np.isfinite(w[t]) and np.isfinite(x).all():
            e[t], known[t] = w[t] - np.dot(betas, x), True
    return e, known


def start(df, names, betas, used=None):
    used = list(range(len(names))) if used is None else used
    values = {"betas": F.array(*[F.lit(float(b)) for b in betas]), "used": F.array(*[F.lit(i) for i in used]), "small_sample": F.lit(False)}
    return df.select("series_id").distinct().withColumns(values)


@pytest.mark.parametrize("block", [16, 50, 16_384])
def test_expectations_follow_the_recursion_across_blocks(spark, block):
    names, betas = ["one", "w_1", "w_7", "e_1", "e_2", "e_7"], [0.2, 0.4, 0.1, 0.5, -0.2, 0.3]
    y = noise_model(160, 1, (0.4,), {1: 0.5, 7: 0.3})
    y[[60, 61, 99]] = np.nan
    df = panel(spark, {"a": y, None: noise_model(90, 2), "short": [1.0, 2.0, 3.0]}).withColumn("w", F.when(~F.isnan("value"), F.col("value")))
    got = arma.expectations(df, start(df, names, betas), SPEC, names, block).collect()
    for key, w in (("a", y), (None, noise_model(90, 2))):
        e, known = residuals(w, names, betas)
        found = {r.pos: r.expected for r in got if r.series_id == key}
        assert sorted(found) == np.flatnonzero(known).tolist()
        assert np.allclose([w[t] - found[t] for t in sorted(found)], e[known], atol=1e-9)
    assert not [r for r in got if r.series_id == "short"]


@pytest.mark.parametrize("block", [200, 16_384])
def test_least_squares_recovers_moving_averages(spark, block):
    cases = {"ma": (["e_1"], {1: 0.6}), "season": (["e_1", "e_7"], {1: 0.3, 7: 0.5})}
    names = ["one", "w_1", "e_1", "e_7"]
    for case, (columns, truth) in cases.items():
        w = noise_model(1500, 4, (), truth)
        df = panel(spark, {case: w}).withColumn("w", F.col("value"))
        used = [names.index(c) for c in columns]
        row = arma.refined(df, start(df, names, [0.0] * 4, used), SPEC, names, block=block).first()
        for c, i in zip(columns, used):
            assert abs(row.betas[i] - truth[int(c[2:])]) < 0.06, (case, c, row.betas)
        # No direction lowers the sum of squares any more, and it equals the recursion's.
        e, known = residuals(w, columns, [row.betas[i] for i in used])
        assert math.isclose((e**2).sum(), row.rss, rel_tol=1e-9) and row.n == known.sum()
        for i in range(len(columns)):
            for step in (-1e-3, 1e-3):
                moved = [row.betas[j] + step * (k == i) for k, j in enumerate(used)]
                assert (residuals(w, columns, moved)[0] ** 2).sum() > row.rss
        assert row.rss < 1.02 * (np.array(noise_model(1500, 4)) ** 2).sum()


def test_refinement_never_fits_worse_than_the_two_step_start(spark):
    y = {"ma": noise_model(500, 5, (), {1: 0.8}), "both": noise_model(500, 6, (0.5,), {1: 0.4}), None: noise_model(400, 7, (0.3,), {7: 0.6})}
    df = panel(spark, y)
    two_step = {r.series_id: r for r in ar.fit_smart(df, SPEC, steps=0, max_p=2, max_q=2, max_sp=0, max_sq=1).collect()}
    better = {r.series_id: r for r in ar.fit_smart(df, SPEC, steps=6, max_p=2, max_q=2, max_sp=0, max_sq=1).collect()}
    assert set(better) == set(two_step) == set(y)
    for key, row in better.items():
        assert row.criterion <= two_step[key].criterion + 1e-9 and row.n == two_step[key].n
    assert better["ma"].rss < two_step["ma"].rss


def direct_search(y, train, d, hard, season, long_order, origin):
    """Orders and coefficients from the rows before ``origin``, each order by its own least squares."""
    # The library leaves out the rows without its longest difference, one row here.
    w, n = np.concatenate([[np.nan], np.diff(y) if d else y[1:]]), len(y)
    lags = np.array([[w[t - i] if t - i >= 1 else np.nan for i in range(1, long_order + 1)] for t in range(n)])
    x = np.column_stack([np.ones(n), lags])
    fit = np.array([t < train and np.isfinite(x[t]).all() and np.isfinite(w[t]) for t in range(n)])
    b = np.linalg.lstsq(x[fit], w[fit], rcond=None)[0]
    e = w - x @ b
    columns = {"one": np.ones(n)} | {f"w_{i}": np.concatenate([[np.nan] * i, w[:-i]]) for i in (1, 2, 7)}
    columns |= {f"e_{i}": np.concatenate([[np.nan] * i, e[:-i]]) for i in (1, 2, 7)}
    names = ["one", *[f"w_{i}" for i in sorted({*range(1, hard[0] + 1), *[season] * hard[2]})], *[f"e_{i}" for i in sorted({*range(1, hard[1] + 1), *[season] * hard[3]})]]
    design = np.column_stack([columns[c] for c in names])
    rows = np.array([t < origin and np.isfinite(design[t]).all() and np.isfinite(w[t]) for t in range(n)])
    count = int(rows.sum())

    def fitted(order):
        p, q, sp, sq = order
        used = (["one"] if d else []) + [f"w_{i}" for i in range(1, p + 1)] + [f"e_{i}" for i in range(1, q + 1)] + ["w_7"] * sp + ["e_7"] * sq
        a = np.column_stack([columns[c] for c in used]) if used else np.zeros((n, 0))
        b = np.linalg.lstsq(a[rows], w[rows], rcond=None)[0]
        rss, k = ((w[rows] - a[rows] @ b) ** 2).sum(), len(used)
        aic = count * math.log(rss / count) + 2 * k
        return aic + (2 * k * (k + 1) / (count - k - 1) if origin < 200 else 0.0), sum(order), order, a, b

    bound = ar.bounds_at(origin, hard, season, ar.TIERS)
    for _ in range(3):
        best = min((fitted(o) for o in itertools.product(*[range(x + 1) for x in bound])), key=lambda f: f[:3])
        if not any(o >= x for o, x in zip(best[2], bound)):
            break
        wider = tuple(min(x + 1, h) for x, h in zip(bound, hard))
        bound = wider if sum(bound[2:]) else (*wider[:2], 0, 0)
    return best[2], best[0], y - w, best[3] @ best[4]


@pytest.mark.parametrize("block", [40, 16_384])
def test_rolling_search_equals_direct_searches(spark, block):
    hard, season, long_order = (2, 2, 1, 1), 7, 4
    y = {"flat": noise_model(150, 11, (0.5,), {1: 0.4}), "walk": np.cumsum(noise_model(220, 12, (), {1: 0.5, 7: 0.4}))}
    df = panel(spark, y).withColumn("phase", phase_from_head())
    limits = {"max_p": 2, "max_q": 2, "max_sp": 1, "max_sq": 1, "max_d": 1, "max_seasonal": 0, "long_order": long_order}
    got = ar.rolling_search(df, SPEC, season, every=5, block=block, **limits).orderBy("pos").collect()
    chosen_d = {r.series_id: r.d for r in ar.difference_orders(df.where("phase = 'train'"), SPEC, season, 1, 0).collect()}
    assert chosen_d == {"flat": 0, "walk": 1}
    for key, values in y.items():
        n, d = len(values), chosen_d[key]
        train, test = n * 6 // 10, n * 6 // 10 + n * 2 // 10
        rows = [r for r in got if r.series_id == key]
        assert [r.pos for r in rows] == list(range(train, n)) and not any(r.fallback for r in rows)
        known = {}
        for r in rows:
            first = train if r.pos < test else test
            origin = r.pos - (r.pos - first) % 5
            assert r.refit_pos == origin
            if origin not in known:
                known[origin] = direct_search(values, train, d, hard, season, long_order, origin)
            order, criterion, rest, expected = known[origin]
            assert (r.p, r.q, r.sp, r.sq) == order and math.isclose(r.criterion, criterion, rel_tol=1e-6, abs_tol=1e-6)
            assert math.isclose(r.yhat, (rest[r.pos] if d else 0.0) + expected[r.pos], rel_tol=1e-6, abs_tol=1e-6)


def test_rolling_search_without_history_falls_back(spark):
    df = panel(spark, {"a": noise_model(24, 1)}).withColumn("phase", phase_from_head())
    rows = ar.rolling_search(df, SPEC, every=2, max_p=2, max_q=1, max_sp=0, max_sq=0, max_d=1, max_seasonal=0, long_order=8).orderBy("pos").collect()
    y = column(df, "value")
    lost = [r for r in rows if r.fallback]
    assert lost and all(math.isclose(r.yhat, y[r.pos - 1]) and r.criterion is None for r in lost)


def root_statistic(x, m, p, most):
    """The seasonal-root regression by direct least squares."""
    x, n = np.asarray(x), len(x)
    lag = lambda v, k: np.concatenate([np.full(k, np.nan), v[: n - k]])
    first, seasonal = x - lag(x, 1), x - lag(x, m)
    y = seasonal - lag(seasonal, 1)
    rows = np.arange(m + most + 1, n)
    a = np.column_stack([np.ones(n), *[lag(y, i) for i in range(1, p + 1)]])
    b = np.linalg.lstsq(a[rows], y[rows], rcond=None)[0]
    z4 = seasonal - b[0] - sum(f * lag(seasonal, i) for i, f in enumerate(b[1:], 1))
    z5 = first - b[0] - sum(f * lag(first, i) for i, f in enumerate(b[1:], 1))
    a = np.column_stack([*[lag(y, i) for i in range(1, p + 1)], lag(z4, 1), lag(z5, m)])[rows]
    b, rss = np.linalg.lstsq(a, y[rows], rcond=None)[:2]
    spread = rss[0] / (len(rows) - p - 2) * np.linalg.inv(a.T @ a)[-1, -1]
    return b[-1] / math.sqrt(spread)


def test_seasonal_roots(spark):
    rng = np.random.default_rng(9)
    walk = np.zeros(420)
    for t in range(7, 420):
        walk[t] = walk[t - 7] + rng.normal()
    fixed = np.tile([5.0, 0, 0, 9, 0, -4, 1], 60) + rng.normal(size=420)
    series = {"walk": walk, "noise": rng.normal(size=420), "fixed": fixed, None: walk, "short": rng.normal(size=9)}
    df = panel(spark, series)
    got = {(r.series_id, r.lags): r.statistic for r in ar.seasonal_root_statistics(df, SPEC).collect()}
    for (key, p), value in got.items():
        if key != "short":
            assert math.isclose(value, root_statistic(series[key], 7, p, 3), rel_tol=1e-6), (key, p)
    d = {r.series_id: r.seasonal_d for r in ar.difference_orders(df, SPEC).collect()}
    assert d == {"walk": 1, "noise": 0, "fixed": d["fixed"], None: 1, "short": 0}
    assert abs(ar.seasonal_root_limit(12) + 1.8) < 0.2
    with pytest.raises(ValueError, match="seasonal test"):
        ar.difference_orders(df, SPEC, seasonal_test="other")


@pytest.mark.parametrize("seed", range(8))
def test_sparse_solution_is_the_least(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 30))
    x = rng.normal(size=(60, n)) @ np.diag(rng.uniform(0.1, 3, n))
    if n > 6:
        x[:, 5] = x[:, 4] + 1e-3 * rng.normal(size=60)
    m, r = x.T @ x, x.T @ rng.normal(size=60) * 3
    l1, l2 = np.where(np.arange(n) < 2, 0.0, rng.uniform(0, 40)), rng.uniform(0, 2, n)
    b = sparse_solved(m, r, l1, l2)
    slope = r - m @ b - l2 * b
    assert np.allclose(slope[b != 0], (l1 * np.sign(b))[b != 0], atol=1e-6)
    assert (np.abs(slope[b == 0]) <= l1[b == 0] + 1e-6).all()


def test_sparse_trend_changes_where_the_slope_changes(spark):
    t = np.arange(400)
    y = np.where(t < 160, 10 + 0.1 * t, 26 - 0.05 * (t - 160)) + 0.2 * np.random.default_rng(3).normal(size=400)
    df = panel(spark, {"a": y, None: 5 + 0.02 * t}).withColumn("phase", F.lit("train"))
    shape = trend.Shape(20, ("weekly",))
    found = {p: {r.series_id: np.array(r.betas[2:]) for r in trend.fit_trend(df, SPEC, shape, prior=p).collect()} for p in ("laplace", "normal")}
    sparse, dense = found["laplace"]["a"], found["normal"]["a"]
    assert (sparse != 0).sum() <= 10 < 15 <= (np.abs(dense) > 1e-9).sum()
    assert abs(int(np.argmin(sparse)) - 9) <= 1  # the change is at two fifths, hinges are 0.04 apart
    assert (np.abs(found["laplace"][None]) < 1e-3).all()
    with pytest.raises(ValueError, match="prior"):
        trend.fit_trend(df, SPEC, shape, prior="other")


SETTINGS = {
    "naive": {}, "lstm": {"seq_len": 3}, "informer": {"seq_len": 5, "pred_len": 2}, "prophet": {"n_changepoints": 3, "seasonalities": ("weekly",)},
    "randomforest": {"n_estimators": 3, "max_depth": 3},
    "arima": {"max_p": 1, "max_q": 1, "max_sp": 0, "max_sq": 0, "long_order": 3, "max_d": 1, "max_seasonal": 0},
}


@pytest.mark.parametrize("model", [*SETTINGS, "arima smart", "arima plain"])
def test_a_null_key_is_a_series_in_every_model(spark, model):
    name, _, mode = model.partition(" ")
    settings = ({"max_p": 2} if mode == "plain" else SETTINGS[name]) | ({"mode": mode} if mode else {})
    y = 20 + noise_model(120, 21, (0.5,))
    rows, _ = forecast(panel(spark, {"named": y, None: y}), SPEC, name, **settings)
    found = rows.groupBy("series_id", "phase").agg(F.count("yhat").alias("n"), F.sum("yhat").alias("s")).collect()
    counts = {(r.series_id, r.phase): (r.n, r.s) for r in found}
    for phase in ("val", "test"):
        assert counts["named", phase][0] == counts[None, phase][0] > 0
        if name != "randomforest":
            assert math.isclose(counts["named", phase][1], counts[None, phase][1], rel_tol=1e-9)


def test_a_null_key_in_a_rolling_refit(spark):
    y = noise_model(60, 22, (0.5,))
    df = panel(spark, {"named": y, None: y}).withColumn("phase", phase_from_head())
    rows = ar.rolling_refit(df, SPEC, p=2, every=3, block=16).collect()
    named, other = (sorted((r.pos, r.yhat) for r in rows if r.series_id == k) for k in ("named", None))
    assert len(named) == 24 and np.allclose(named, other)


def test_box_cox_goes_there_and_back(spark):
    rng = np.random.default_rng(4)
    series = {"log": np.exp(rng.normal(1.0, 0.6, 900)), "root": (5 + rng.normal(0, 0.5, 900)) ** 2, None: np.exp(rng.normal(0, 0.3, 300)), "bad": [1.0, -1.0, 2.0]}
    df = panel(spark, series)
    powers = {r.series_id: r.power for r in features.refined_box_cox_power(df, SPEC).collect()}
    assert abs(powers["log"]) < 0.12 and 0.2 < powers["root"] < 0.8 and abs(powers[None]) < 0.5 and powers["bad"] is None
    for key in ("log", "root", None):  # no power near by is likelier
        y = np.array(series[key])
        likely = [-len(y) * math.log(np.std(np.log(y) if p == 0 else (y**p - 1) / p)) + (p - 1) * np.log(y).sum() for p in (powers[key], powers[key] - 0.02, powers[key] + 0.02)]
        assert likely[0] >= max(likely[1:])
    for p in (-0.5, 0.0, 0.3, 1.0):
        moved = features.box_cox(F.col("value"), F.lit(p))
        rows = df.where("series_id = 'log'").select("value", features.inverse_box_cox(moved, F.lit(p)).alias("back")).collect()
        assert np.allclose([r.value for r in rows], [r.back for r in rows])
    x = rng.normal(1.0, 0.2, 200_000)
    for p, value in ((0.0, np.exp(x)), (0.5, (0.5 * x + 1) ** 2)):
        one = spark.range(1).select(features.inverse_box_cox(F.lit(float(x.mean())), F.lit(p), F.lit(float(x.var()))).alias("m")).first()
        assert abs(one.m - value.mean()) < 0.003 * value.mean()


def test_arima_on_transformed_values(spark):
    y = np.exp(1 + 0.4 * noise_model(240, 31, (0.8,)))
    df = panel(spark, {"a": y, None: y, "signed": noise_model(240, 32, (0.5,))})
    rows, _ = forecast(df, SPEC, "arima", box_cox=True, calibrate=False, **SETTINGS["arima"])
    got = rows.orderBy("pos").collect()
    for key in ("a", None):
        part = [r for r in got if r.series_id == key]
        assert len(part) == 96 and all(r.yhat > 0 for r in part) and np.allclose([r.y_true for r in part], y[144:])
        assert np.corrcoef([r.yhat for r in part], y[144:])[0, 1] > 0.5
    assert len([r for r in got if r.series_id == "signed"]) == 96
