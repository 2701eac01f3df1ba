import math

import numpy as np
import pytest
from helpers import DAY0, column, panel
from pyspark.sql import functions as F

from seriesloom.operators import clean, features, merge, metrics, post, quality, scale, split
from seriesloom.sources import reader, resample, sink
from seriesloom.session import run_folder
from seriesloom.spec import SeriesSpec

SPEC = SeriesSpec()


def test_csv_with_bad_cells(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("Date,Sales\n2022-01-02,5\nnot a day,3\n2022-01-01,inf\n2022-01-03,x\n")
    df = reader.read_csv(spark, str(path), value="Sales")
    assert sorted((str(r[0])[:10], r[1]) for r in df.collect() if r[1]) == [("2022-01-02", 5.0)]
    assert df.count() == 3 and df.columns == ["Date", "Sales"]
    numeric = tmp_path / "numeric.csv"
    numeric.write_text("time,label,amount\n2022-01-01,a,1.5\n")
    assert reader.read_csv(spark, str(numeric)).columns == ["time", "amount"]


def test_roles(spark):
    df = spark.createDataFrame([("x", 1, 2.0, "2022-01-01")], "name string, code int, close double, event_time string")
    assert reader.detect_columns(df) == (["name", "code"], "close")
    assert reader.resolve_value(df) == "code"
    with pytest.raises(reader.ColumnNotFound):
        reader.resolve_time(df)
    with pytest.raises(reader.ColumnNotFound):
        reader.resolve_value(df.select("name"))
    with pytest.raises(reader.ColumnNotFound):
        reader.with_features(df, ["absent"], locked=True)
    assert reader.with_features(df, ["absent"]).first()["absent"] == 0.0
    assert reader.select_features(df, SPEC.using(value="close"), ["code", "gone", "close"]) == ["close", "code"]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        reader.check_columns(df.withColumn("event_time", F.lit("no date")), "event_time", "close").collect()


def test_stored_feature_order_is_checked(spark):
    params = spark.createDataFrame([("a", 1.0)], "series_id string, slope double")
    path = sink.write_params(params, run_folder(spark, "test"), ["x", "y"])
    assert sink.read_params(spark, path, ["x", "y"]).count() == 1
    with pytest.raises(Exception, match="fitted for features x, y"):
        sink.read_params(spark, path, ["y", "x"]).collect()


def test_fill_methods(spark):
    df = panel(spark, {"a": [None, 2.0, None, 4.0]})
    fill = lambda how: column(clean.fill_missing(df, SPEC, how), "value")
    assert fill("ffill") == [None, 2.0, 2.0, 4.0]
    assert fill("bfill") == [2.0, 2.0, 4.0, 4.0]
    assert fill("both") == [2.0, 2.0, 2.0, 4.0]
    assert fill("mean") == [3.0, 2.0, 3.0, 4.0]
    assert fill("zero") == [0.0, 2.0, 0.0, 4.0]
    assert fill(7) == [7.0, 2.0, 7.0, 4.0]
    assert fill(None) == [None, 2.0, None, 4.0]
    with pytest.raises(ValueError):
        fill("guess")


def test_non_finite_values(spark):
    df = panel(spark, {"a": [1.0, float("nan"), float("inf"), -float("inf"), None, 3.0]})
    assert column(clean.clean_values(df, "value"), "value") == [1.0, 3.0]
    audit = quality.nonfinite_audit(df, ["value"]).first()
    assert (audit.n_null, audit.n_nan, audit.n_inf) == (1, 1, 2)
    with pytest.raises(Exception, match="not finite: value"):
        quality.require_finite(df, ["value"]).collect()
    row = quality.eligibility(df, SPEC).first()
    assert (row.n_rows, row.n_finite, row.few_rows, row.eligible_autoregression) == (6, 2, True, False)


def test_gap_filling_keeps_every_step(spark, monkeypatch):
    monkeypatch.setattr(resample, "GRID_CHUNK", 3)
    df = panel(spark, {"a": range(12), "b": [5.0]}).where("pos % 5 <> 1").drop("pos", "n")
    got = resample.fill_grid(df, SPEC, "day").orderBy("series_id", "pos").collect()
    a = [r for r in got if r.series_id == "a"]
    assert [r.pos for r in a] == list(range(11)) and {r.n for r in a} == {11}
    assert [r.value for r in a] == [None if i % 5 == 1 else float(i) for i in range(11)]


def test_sampling_step(spark):
    days = panel(spark, {"a": [1] * 8, "b": [1, 2]})
    steps = {r.series_id: r for r in quality.sampling_step(days, SPEC).collect()}
    assert steps["a"].regular_step == 86_400.0 and steps["b"].regular_step is None
    gappy = days.where("pos not in (3, 5)").withColumn("pos", F.when(F.col("pos") > 5, F.col("pos") - 2).when(F.col("pos") > 3, F.col("pos") - 1).otherwise(F.col("pos")))
    row = {r.series_id: r for r in quality.sampling_step(gappy, SPEC).collect()}["a"]
    assert row.regular_step is None and row.modal_step == 86_400.0


@pytest.mark.parametrize("n", [1, 2, 5, 7, 10, 13, 168, 2405])
def test_phases_cover_the_series(spark, n):
    df = panel(spark, {"a": [0.0] * n})
    count = lambda phase: {r[0]: r[1] for r in df.groupBy(phase.alias("p")).count().collect()}
    head = count(split.phase_from_head())
    assert head.get("train", 0) == int(n * 0.6) and head.get("val", 0) == int(n * 0.2) and sum(head.values()) == n
    tail = count(split.phase_from_tail(0.2, 0.2))
    assert tail.get("test", 0) == round(n * 0.2) and tail.get("val", 0) == round(n * 0.2)
    rounded = count(split.phase_rounded())
    assert rounded["train"] == max(1, round(n * 0.6))
    with pytest.raises(ValueError):
        split.phase_from_head((7, 10), (4, 10))


def test_folds_and_origins(spark):
    df = panel(spark, {"a": range(25), "b": range(4)})
    folds = split.expanding_folds(df).where("series_id = 'a'").groupBy("fold", "role").agg(F.min("pos"), F.max("pos")).collect()
    got = {(r[0], r[1]): (r[2], r[3]) for r in folds}
    assert got[(1, "fit")] == (0, 4) and got[(1, "eval")] == (5, 8) and got[(5, "eval")] == (21, 24)
    starts = split.rolling_origins(df, SPEC, 10, 4)
    assert sorted((r.series_id, r.origin) for r in starts.collect()) == [("a", 0), ("a", 4), ("a", 8), ("a", 12), ("b", 0)]
    tail = split.rolling_origins(df, SPEC, 10, 4, from_tail=True)
    assert sorted((r.series_id, r.origin) for r in tail.collect()) == [("a", 15), ("b", 0)]


def test_scaler_round_trip_and_constant_series(spark):
    df = panel(spark, {"a": [1, 2, 4, 9, 1], "c": [3, 3, 3, 3, 3]}).withColumn("phase", split.phase_from_head())
    params = scale.fit_scaler(df, SPEC)
    stats = {r.series_id: (r.value_mean, r.value_std) for r in params.collect()}
    assert stats["c"] == (3.0, 1.0) and np.isclose(stats["a"][1], np.std([1, 2, 4]))
    back = scale.inverse_scale(scale.scale(df, params, SPEC), params, SPEC)
    assert np.allclose(column(back, "value", "a"), [1, 2, 4, 9, 1])


def test_changes_on_short_and_zero_series(spark):
    got = features.with_changes(panel(spark, {"a": [0.0, 5.0, 10.0], "b": [1.0]}), SPEC)
    assert column(got, "value_pct_change", "a") == [None, None, 1.0]
    assert column(got, "value_roll3", "a") == [None, None, 5.0]
    assert column(got, "value_roll3", "b") == [None]


def test_box_cox_needs_positive_values(spark):
    values = [math.exp(x) for x in np.random.default_rng(0).normal(size=400)]
    rows = {r.series_id: r.power for r in features.box_cox_power(panel(spark, {"log": values, "bad": [1.0, -1.0]}), SPEC).collect()}
    assert rows == {"log": 0.0, "bad": None}


def test_overlap_modes_differ(spark):
    rows = [("s", 1, 0, 5.0, 1.0), ("s", 1, 1, 5.0, 3.0), ("s", 1, 2, 5.0, 8.0), ("s", 2, 1, 6.0, 4.0), ("s", 3, 0, 7.0, None)]
    df = spark.createDataFrame(rows, "series_id string, ts int, origin int, y_true double, yhat double")
    merged = lambda mode: column(merge.merge_overlaps(df, SPEC, mode), "yhat", order="ts")
    assert merged("overwrite") == [8.0, 4.0, None]
    assert merged("mean") == [5.0, 4.0, None]
    assert merged("strict_mean") == [4.0, 4.0, None]


def test_pairings_differ_with_gaps(spark):
    truth = panel(spark, {"a": [1, None, 3, 4]}).withColumnRenamed("value", "y_true")
    forecast = panel(spark, {"a": [10, 20]}).withColumnRenamed("value", "yhat")
    head = merge.pair_from_head(truth, forecast, SPEC, "day").orderBy("rank").collect()
    tail = merge.pair_from_tail(truth, forecast, SPEC, "day").orderBy("rank").collect()
    assert [(r.y_true, r.yhat) for r in head] == [(1.0, 10.0), (3.0, 20.0)]
    assert [(r.y_true, r.yhat) for r in tail] == [(4.0, 20.0), (3.0, 10.0)]


def test_timeline_without_validation(spark):
    parts = panel(spark, {"a": range(5)}).select("series_id", "ts", "pos", F.col("value").alias("y_true"), F.col("value").alias("yhat"))
    train, test = parts.where("pos < 3"), parts.where("pos >= 3")
    flags = merge.timeline(train, parts.where("false"), test, SPEC).orderBy("ts").collect()
    assert [(r.is_train, r.is_val, r.is_test) for r in flags] == [(True, False, False)] * 3 + [(False, False, True)] * 2


def test_payload_cut_to_shortest(spark):
    df = spark.createDataFrame([("a", ["2020-01-01", "2020-01-02", "x"], [1.0, 2.0], [5.0, float("nan"), 7.0])],
                               "series_id string, timestamps array<string>, y_true array<double>, yhat array<double>")
    rows = merge.rows_from_payload(df, SPEC).orderBy("ts").collect()
    assert [(r.ts, r.y_true, r.yhat) for r in rows] == [(DAY0, 1.0, 5.0), (DAY0.replace(day=2), 2.0, None)]


def test_metrics_on_zero_truth_and_nothing(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0), (None, 4.0)], "y_true double, yhat double")
    row = df.agg(*[m().alias(name) for name, m in metrics.METRICS.items()]).first()
    assert row.rmse == 1.0 and row.mae == 1.0
    assert np.isclose(row.mape_masked, 0.5) and np.isclose(row.mape_percent, 50.0)
    assert np.isclose(row.mape_stable, (1 / 1e-3 + 0.5) / 2) and np.isclose(row.mape_eps, (1e8 + 0.5) / 2)
    assert row.mape_classic > 1e15
    nothing = df.where("false").agg(*[m().alias(name) for name, m in metrics.METRICS.items()]).first()
    assert set(nothing) == {None}
    assert not metrics.evaluate_pairs(df.where("false").withColumn("g", F.lit(1)), ["g"]).count()


def test_percent_text(spark):
    assert spark.range(1).select(metrics.percent_text(F.lit(0.12345))).first()[0] == "12.35%"


def test_best_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([("a", 3, 0.5), ("a", 1, 0.5), ("a", 0, None), ("a", 2, 0.9)], "series_id string, config int, mape double")
    assert metrics.best(df, ["series_id"], "mape", "config").first().config == 1


@pytest.mark.parametrize("dof", range(1, 11))
def test_chi_square_tail(spark, dof):
    points = [0.1, 1.0, 3.5, 9.0, 25.0, 80.0, 400.0]
    got = [r[0] for r in spark.createDataFrame([(q,) for q in points], "q double").select(metrics.chi_square_tail(F.col("q"), F.lit(dof))).collect()]
    # Numeric integration of the density in u = sqrt(x), which has no pole at 0.
    for q, p in zip(points, got):
        u = np.linspace(math.sqrt(q), math.sqrt(q) + 40, 400_001)
        density = 2 * u ** (dof - 1) * np.exp(-u * u / 2) / (2 ** (dof / 2) * math.gamma(dof / 2))
        assert abs(np.trapezoid(density, u) - p) < 1e-8


def test_calibration_skips_flat_forecasts(spark):
    df = panel(spark, {"a": [float(i % 5) for i in range(40)]}).withColumn("phase", split.phase_from_head())
    df = df.withColumnRenamed("value", "y_true").withColumn("yhat", F.lit(2.0))
    same = post.calibrate_spread(df, SPEC)
    assert set(column(same, "yhat")) == {2.0}
    shifted = post.calibrate_bias(df.withColumn("yhat", F.col("y_true") - 3.0), SPEC)
    assert np.allclose([a - b for a, b in zip(column(shifted.where("phase <> 'train'"), "y_true"), column(shifted.where("phase <> 'train'"), "yhat"))], 0.0)


def test_residual_of_constant_forecast(spark):
    df = panel(spark, {"a": [1.0, 2.0, 3.0]}, {"phase": F.lit("val"), "yhat": F.lit(1.0)}).withColumnRenamed("value", "y_true")
    for kind in ("bias", "linear", "ridge", "lasso"):
        row = post.fit_residual(df, SPEC, kind).first()
        assert (row.slope, row.intercept) == (0.0, 1.0)
    other = panel(spark, {"b": [1.0]}, {"yhat": F.lit(4.0)})
    kept = post.apply_residual(other, post.fit_residual(df, SPEC), SPEC)
    assert kept.first().corrected == 4.0
