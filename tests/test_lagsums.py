"""Window matrices from lag products, covariates of the horizon model, strided windows."""

import numpy as np
from helpers import column, panel
from pyspark.sql import functions as F

from seriesloom.operators.lagsums import per_window_matrix
from seriesloom.operators.models import horizon
from seriesloom.operators.split import phase_from_head
from seriesloom.operators.windows import supervised_windows
from seriesloom.spec import SeriesSpec

SPEC = SeriesSpec()
PAIR = SPEC.using(features=("extra",))


def paired(spark, y, z, key="a"):
    df = panel(spark, {key: y})
    extra = spark.createDataFrame([(i, None if np.isnan(v) else float(v)) for i, v in enumerate(z)], "pos long, extra double")
    df = df.join(extra, "pos").withColumn("value", F.when(F.col("value").isNaN(), None).otherwise(F.col("value")))
    return df.withColumn("phase", phase_from_head())


def windows_of(y, z, width):
    rows = np.column_stack([np.ones(len(y)), y, z])
    every = [rows[i : i + width].T.ravel() for i in range(len(y) - width + 1)]
    return np.array([w for w in every if np.isfinite(w).all()])


def test_matrix_equals_products_of_window_rows(spark):
    rng = np.random.default_rng(3)
    y, z = rng.normal(size=230), rng.normal(size=230)
    for missing, block in (((), 64), ((0, 41, 42, 100, 127, 128, 190, 229), 64), ((77,), 7), ((5,), 1000)):
        y2, z2 = y.copy(), z.copy()
        y2[list(missing)] = np.nan
        z2[150] = np.nan
        got = per_window_matrix(
            paired(spark, y2, z2), PAIR, PAIR.columns, 9, "n bigint, m array<double>", lambda m, n: [{"n": n, "m": m.ravel().tolist()}], block
        ).collect()
        want = windows_of(y2, z2, 9)
        assert len(got) == 1 and got[0].n == len(want)
        assert np.allclose(np.array(got[0].m), (want.T @ want).ravel())


def test_series_without_a_whole_window_has_no_row_and_a_null_key_has_one(spark):
    y = np.arange(30.0)
    df = paired(spark, y, y).withColumn("series_id", F.when(F.col("pos") < 0, "a"))
    short = paired(spark, y[:6], y[:6])
    got = per_window_matrix(df.unionByName(short), PAIR, PAIR.columns, 8, "n bigint", lambda m, n: [{"n": n}]).collect()
    assert [(r.series_id, r.n) for r in got] == [(None, 23)]
    assert per_window_matrix(df.limit(0), PAIR, PAIR.columns, 8, "n bigint", lambda m, n: [{"n": n}]).count() == 0


def test_covariates_enter_the_horizon_model(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(size=200)
    y = 10 + np.concatenate([[0.0, 0.0], 3 * z[:-2]]) + 0.1 * rng.normal(size=200)
    df = paired(spark, y, 100 * z - 7)
    params = horizon.fit_horizon(df, PAIR, 6, 2, penalty=0.5)
    got = horizon.predict_rolling(df, params, PAIR, 6, 2).toPandas().set_index(["origin", "step"])
    train = slice(0, 120)
    a, b = (y - y[train].mean()) / y[train].std(), 100 * z - 7
    b = (b - b[train].mean()) / b[train].std()
    x = np.array([[1, *a[i : i + 6], *b[i : i + 6]] for i in range(113)])
    for h in (1, 2):
        beta = np.linalg.solve(x.T @ x + 0.5 * np.eye(13), x.T @ a[5 + h : 5 + h + 113])
        want = y[train].mean() + y[train].std() * (beta @ [1, *a[150:156], *b[150:156]])
        assert np.isclose(got.loc[(150, h), "yhat"], want)
    test = got[got.index.get_level_values("origin") >= 120]
    alone = horizon.predict_rolling(df, horizon.fit_horizon(df, SPEC, 6, 2, 0.5), SPEC, 6, 2).toPandas().set_index(["origin", "step"])
    error = lambda rows: np.abs(rows["y_true"] - rows["yhat"]).mean()
    assert error(test) < 0.3 * error(alone.loc[test.index])
    ahead = horizon.predict_next(df, params, PAIR, 6, "day").orderBy("step").collect()
    assert np.allclose([r.yhat for r in ahead], y[-2:].mean(), atol=30) and len(ahead) == 2


def test_strided_windows_are_those_of_all_windows(spark):
    y = np.arange(100.0)
    df = panel(spark, {"a": y, "b": y[:37]})
    for stride, block in ((2, 16), (4, 65_536), (25, 10)):
        every = supervised_windows(df, SPEC, 7, 3).where(F.col("origin") % stride == 0)
        some = supervised_windows(df, SPEC, 7, 3, stride, block)
        assert some.columns == every.columns
        assert sorted(map(str, some.collect())) == sorted(map(str, every.collect()))
    late = supervised_windows(df.where("pos >= 5"), SPEC, 7, 3, 4)
    assert column(late.where("series_id = 'b'"), "origin") == [8, 12, 16, 20, 24]
