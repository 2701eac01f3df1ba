"""NULLs, duplicates, short series and long lags."""

import math

import numpy as np
import pytest
from helpers import column, panel
from pyspark.sql import functions as F

from seriesloom.operators import clean, merge, metrics
from seriesloom.operators.models import ar, dispatch, forest
from seriesloom.operators.position import fill_forward, with_pos
from seriesloom.operators.scale import fit_scaler, scale
from seriesloom.operators.split import phase_from_head
from seriesloom.spec import SeriesSpec

SPEC = SeriesSpec()


def direct_refit(values, origin, p):
    """Least squares on the complete rows before ``origin``."""
    rows = [values[t - p : t + 1] for t in range(p, origin)]
    rows = np.array([[1.0, *r[:-1][::-1], r[-1]] for r in rows if all(v is not None for v in r)], float)
    return np.linalg.lstsq(rows[:, :-1], rows[:, -1], rcond=None)[0]


@pytest.mark.parametrize("gap", [125, 128, 130, 143])
def test_a_missing_value_ends_no_rolling_refit(spark, gap):
    values = np.random.default_rng(5).normal(size=200).cumsum().tolist()
    values[gap] = None
    df = panel(spark, {"a": values}).withColumn("phase", phase_from_head())
    rows = ar.rolling_refit(df, SPEC, p=2, every=3, block=32).orderBy("pos").collect()
    assert len(rows) == 78  # the two rows with a missing lag have no forecast
    for r in rows:
        b = direct_refit(values, r.refit_pos, 2)
        assert np.isclose(r.yhat, b @ [1.0, values[r.pos - 1], values[r.pos - 2]])


def test_preprocess_drops_repeats_of_numbered_rows(spark):
    df = panel(spark, {"a": [1.0, 2.0, None, 4.0]})
    out = clean.preprocess(df.unionByName(df).unionByName(df.where("pos = 1")), SPEC, grid="day")
    assert column(out, "value") == [1.0, 2.0, 2.0, 4.0] and column(out, "pos") == [0, 1, 2, 3]
    kept = clean.preprocess(df.unionByName(df.where("pos = 1")), SPEC, fill=None, drop_duplicates=False)
    assert kept.count() == 5


@pytest.mark.parametrize("grid", ["day", None])
def test_rows_without_key_or_time_stay(spark, grid):
    rows = [(None, "2020-01-01", 1.0), (None, "2020-01-02", None), ("a", "2020-01-01", 3.0), ("a", None, 4.0)]
    df = spark.createDataFrame(rows, "series_id string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    numbered = with_pos(df, SPEC, grid)
    assert sorted((r.series_id or "", r.pos, r.n) for r in numbered.collect()) == [("", 0, 2), ("", 1, 2), ("a", 0, 2), ("a", 1, 2)]
    filled = fill_forward(numbered, SPEC, ["value"])
    assert sorted(r.value for r in filled.collect()) == [1.0, 1.0, 3.0, 4.0]
    assert scale(df, fit_scaler(df.withColumn("phase", F.lit("train")), SPEC), SPEC).count() == 4


def test_chi_square_tail(spark):
    qs = [0.0, 0.3, 1.0, 3.84, 12.0, 40.0, 400.0]
    df = spark.createDataFrame([(q, k) for q in qs for k in (1, 2, 3, 7, 20, 41)], "q double, k int")
    for r in df.withColumn("p", metrics.chi_square_tail(F.col("q"), F.col("k"))).collect():
        x = r.q / 2
        if r.k % 2 == 0:
            expected = math.exp(-x) * sum(x**j / math.factorial(j) for j in range(r.k // 2))
        else:
            expected = math.erfc(math.sqrt(x)) + math.exp(-x) * sum(x ** (j - 0.5) / math.gamma(j + 0.5) for j in range(1, (r.k + 1) // 2))
        assert math.isclose(r.p, expected, rel_tol=1e-9, abs_tol=1e-13), r


def test_ljung_box_with_twenty_lags_and_short_series(spark):
    noise = np.random.default_rng(2).normal(size=200)
    df = panel(spark, {"long": noise.tolist(), "short": [1.0, 2.0, 3.0]}).withColumnsRenamed({"value": "y_true"}).withColumn("yhat", F.lit(0.0))
    got = {r.series_id: r for r in metrics.ljung_box(df, SPEC, max_lag=20).collect()}
    e = noise - noise.mean()
    q = 200 * 202 * sum((e[k:] @ e[:-k] / (e @ e)) ** 2 / (200 - k) for k in range(1, 21))
    assert got["long"].lag == 20 and math.isclose(got["long"].q, q, rel_tol=1e-9) and 0 < got["long"].p_value < 1
    assert got["short"].q is None and got["short"].p_value is None


def test_tail_pairs_keep_missing_values(spark):
    truth = panel(spark, {"a": [1.0, 3.0, None, 4.0]}).withColumnRenamed("value", "y_true")
    guess = panel(spark, {"a": [10.0, 20.0]}).withColumnRenamed("value", "yhat")
    tail = merge.pair_from_tail(truth, guess, SPEC, "day")
    assert sorted((r.y_true, r.yhat) for r in tail.fillna(-1.0).collect()) == [(-1.0, 10.0), (4.0, 20.0)]
    head = merge.pair_from_head(truth, guess, SPEC, "day")
    assert sorted((r.y_true, r.yhat) for r in head.collect()) == [(1.0, 10.0), (3.0, 20.0)]


def test_trees_beyond_the_limit_are_refused(spark):
    df = panel(spark, {"a": list(range(40))}).withColumn("phase", phase_from_head())
    with pytest.raises(ValueError, match="depth 30"):
        forest.fit_forest(forest.lag_design(df, SPEC, 2), SPEC, 2, max_depth=32)
    assert max(forest.SPACE["max_depth"]) <= forest.MAX_DEPTH


def test_interpolating_fits_have_no_criterion():
    assert ar.information_criteria(3, 0.0, 3) == (math.inf, math.inf)
    assert math.isfinite(ar.information_criteria(9, 0.0, 3)[0])


@pytest.mark.parametrize("model", ["prophet", "arima", "lstm"])
def test_short_series_get_a_reason_and_no_forecast(spark, model):
    rng = np.random.default_rng(1)
    df = panel(spark, {"short": [3.0, 9.0, 1.0, 7.0, 4.0], "long": (50 + rng.normal(size=120).cumsum()).tolist()})
    settings = {"mode": "plain"} if model == "arima" else {}
    rows, _ = dispatch.forecast(df, SPEC, model, **settings)
    assert {r.series_id for r in rows.select("series_id").distinct().collect()} == {"long"}
    reasons = {r.series_id: r.reason for r in dispatch.shortfall(df, SPEC, model).collect()}
    assert reasons["long"] is None and model in reasons["short"]
