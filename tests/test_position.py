import random

import numpy as np
import pandas as pd
import pytest
from helpers import DAY0, column, panel
from pyspark.sql import functions as F

from seriesloom.operators import features, position, windows
from seriesloom.spec import SeriesSpec

SPEC = SeriesSpec()


def test_range_positions_with_one_hot_time(spark):
    """Half of one series shares a single time; ties decide, whatever the input order."""
    rows = [("a", 5, i) for i in range(400)] + [("a", i % 9, 1000 + i) for i in range(400)] + [("b", 1, 7), ("c", 3, 1)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "series_id string, ts int, tie int").repartition(7)
    got = position.with_pos(df, SPEC.using(ties=("tie",))).toPandas()
    want = pd.DataFrame(rows, columns=["series_id", "ts", "tie"]).sort_values(["series_id", "ts", "tie"])
    want["pos"] = want.groupby("series_id").cumcount()
    want["n"] = want.groupby("series_id")["ts"].transform("size")
    merged = want.merge(got, on=["series_id", "ts", "tie"], suffixes=("", "_got"))
    assert len(merged) == len(rows)
    assert (merged["pos"] == merged["pos_got"]).all() and (merged["n"] == merged["n_got"]).all()


@pytest.mark.parametrize("partitions", ["1", "3", "16"])
def test_range_positions_do_not_depend_on_partitions(spark, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.range(500).select(F.lit("s").alias("series_id"), (F.col("id") * 37 % 101).alias("ts"), F.col("id").alias("tie"))
        got = position.with_pos(df, SPEC.using(ties=("tie",))).orderBy("pos").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got["pos"].tolist() == list(range(500))
    assert got[["ts", "tie"]].apply(tuple, axis=1).is_monotonic_increasing


def test_bucket_positions_cross_years(spark):
    days = pd.date_range("2018-11-01", periods=800).delete([3, 5, 100, 500])
    df = spark.createDataFrame(pd.DataFrame({"series_id": "a", "ts": days})).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = position.with_pos(df, SPEC, "day").orderBy("ts").toPandas()
    assert got["pos"].tolist() == list(range(len(days))) and set(got["n"]) == {len(days)}


VALUES = [None if i % 7 in (2, 3) else float((i * 31) % 17) for i in range(53)]


@pytest.mark.parametrize("block", [1, 4, 7, 1000])
def test_blocks_equal_one_window(spark, block):
    df = panel(spark, {"a": VALUES, "b": [1.0], "c": [None, 2.0]})
    got = features.with_lags(df, SPEC, 9, drop_incomplete=False, block=block)
    series = pd.Series(VALUES, dtype=float)
    for i in (1, 5, 9):
        want = [None if pd.isna(v) else v for v in series.shift(i)]
        assert column(got, f"lag_{i}", "a") == want
    assert column(got, "lag_1", "c") == [None, None]


@pytest.mark.parametrize("block", [1, 5, 1000])
def test_fill_and_running_sum(spark, block):
    values = [None, None, *VALUES, None]
    df = panel(spark, {"a": values, "b": [None, None], "c": [4.0]})
    series = pd.Series(values, dtype=float)
    forward = position.fill_forward(df, SPEC, ["value"], block)
    assert column(forward, "value", "a") == [None if pd.isna(v) else v for v in series.ffill()]
    backward = position.fill_backward(df, SPEC, ["value"], block)
    assert column(backward, "value", "a") == [None if pd.isna(v) else v for v in series.bfill()]
    assert column(forward, "value", "b") == [None, None]
    total = position.running_sum(df.na.fill(0.0), SPEC, "value", "total", block)
    assert np.allclose(column(total, "total", "a"), series.fillna(0).cumsum())


@pytest.mark.parametrize("block", [3, 8, 1000])
def test_windows_reach_over_blocks(spark, block):
    df = panel(spark, {"a": list(range(30)), "b": list(range(6)), "c": [1.0, 2.0]})
    got = windows.supervised_windows(df, SPEC, 4, 3, stride=2, block=block).orderBy("series_id", "origin").collect()
    assert [r.origin for r in got if r.series_id == "a"] == list(range(0, 24, 2))
    assert [r.series_id for r in got if r.series_id != "a"] == []
    for r in got:
        assert [c[0] for c in r.x] == [r.origin + i for i in range(4)]
        assert [c[0] for c in r.y] == [r.origin + 4 + i for i in range(3)]


def test_decoder_does_not_see_the_future(spark):
    df = panel(spark, {"a": list(range(20))})
    row = windows.encoder_decoder_windows(df, SPEC, 6, 3, 4).orderBy("origin").first()
    assert [c[0] for c in row.x_dec] == [3.0, 4.0, 5.0, None, None, None, None]
    assert [c[0] for c in row.y_label] == [float(v) for v in range(3, 10)]


def test_empty_input(spark):
    df = panel(spark, {"a": [1.0]}).where("false")
    assert features.with_lags(df, SPEC, 3).count() == 0
    assert position.with_pos(df.drop("pos", "n"), SPEC).count() == 0
    assert position.with_pos(df.drop("pos", "n"), SPEC, "day").count() == 0
    assert position.fill_forward(df, SPEC, ["value"]).count() == 0
    assert DAY0.year == 2020
