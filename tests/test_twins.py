"""Queries against their SQL twins; TWINS=all runs every one of them."""

import os

import pytest

import __spark_entry__ as entry
from check_oracles import connect, differences

FOLDER = "/root/testdata/sf0.001"
CORE = [
    "a01_typed_source", "c07_fill_both_ways", "c07_fill_shipments", "c14_user_eligibility", "f05_lags", "f05_shipment_lags",
    "f13_scaled", "d05_expanding_folds", "w01_gap_windows", "w02_encoder_decoder_windows", "e02_merge_mean", "e11_timeline",
    "g09_pair_metrics", "g11_ljung_box", "p04_spread_calibrated", "r06_kept_if_better", "m02_plain_forecast", "m04_rolling_refit",
    "m10_change_forecast", "m13_rolling_forecast", "x02_hourly_users",
]
NAMES = sorted(entry.queries()) if os.environ.get("TWINS") == "all" else CORE


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, con, name):
    assert differences(spark, con, FOLDER, name) is None


def test_registered_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns == ["series_id", "phase", "n_pairs", "rmse", "mape"] and result.count() == 15
