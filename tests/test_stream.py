from datetime import datetime, timedelta

import numpy as np
from helpers import column

from seriesloom.session import run_folder
from seriesloom.spec import SeriesSpec
from seriesloom.streaming.keyed import moved_on, score_keyed, use_keyed_state
from seriesloom.streaming.score import grid_counts, score_batch, score_stream

SPEC = SeriesSpec()
START = datetime(2024, 1, 1)


def test_several_batches_and_late_rows(spark):
    """Three arrivals; one row comes after its day was closed and must not count."""
    base = run_folder(spark, "stream-test")
    schema = "series_id string, ts timestamp, value double"
    day = lambda d, v, hour=6: ("a", START + timedelta(days=d, hours=hour), float(v))
    spark.createDataFrame([("a", START + timedelta(days=d), float(d)) for d in (-2, -1)], schema).write.parquet(f"{base}/history/batch=-1")
    params = spark.createDataFrame([("a", [1.0, 0.5, 0.25])], "series_id string, betas array<double>")
    arrivals = [[day(0, 4), day(0, 6), day(1, 2)], [day(3, 8), day(3, 1)], [day(0, 1000), day(4, 3), day(6, 5)]]
    for rows in arrivals:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = grid_counts(spark.readStream.schema(schema).parquet(f"{base}/in"), SPEC, "1 day", "1 hour")
        writer = score_stream(stream, params, SPEC, f"{base}/history", f"{base}/forecast", f"{base}/checkpoint", 86_400, 2)
        writer.trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{base}/forecast")
    truth = {-2: -2.0, -1: -1.0, 0: 10.0, 1: 2.0, 2: 0.0, 3: 9.0, 4: 3.0, 5: 0.0}
    assert column(got, "y_true", order="ts") == [10.0, 2.0, 9.0, 3.0]
    want = [1 + 0.5 * truth[d - 1] + 0.25 * truth[d - 2] for d in (0, 1, 3, 4)]
    assert np.allclose(column(got, "yhat", order="ts"), want)


def test_empty_batch(spark):
    schema = "series_id string, ts timestamp, value double"
    empty = spark.createDataFrame([], schema)
    params = spark.createDataFrame([("a", [1.0, 0.5])], "series_id string, betas array<double>")
    assert score_batch(empty, empty, params, SPEC, 3600, 1).count() == 0


def test_keyed_state_over_restarts_with_late_rows_and_gaps(spark):
    """Each arrival is a restarted query; a NULL key is a series; the state stays as long as the lags."""
    use_keyed_state(spark)
    base = run_folder(spark, "keyed-test")
    schema = "series_id string, ts timestamp, value double"
    day = lambda d, v, hour=6, key="a": (key, START + timedelta(days=d, hours=hour), float(v))
    past = [(k, START + timedelta(days=d), float(10 + d)) for k in ("a", None) for d in (-4, -2, -1)]
    history = spark.createDataFrame(past, schema)
    params = spark.createDataFrame([("a", [1.0, 0.5, 0.25]), (None, [2.0, 1.0, 0.0])], "series_id string, betas array<double>")
    arrivals = [
        [day(0, 4), day(0, 6), day(1, 2), day(0, 7, key=None), day(0, 1, key="new")],
        [day(3, 8), day(3, 1)],
        [day(0, 1000), day(4, 3), day(20, 5), day(21, 6), day(20, 9, key=None)],
        [day(23, 1), day(30, 1)],
    ]
    for rows in arrivals:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(schema).parquet(f"{base}/in")
        scored = score_keyed(stream, params, SPEC, "1 day", 86_400, "1 hour", 2, history)
        writer = scored.writeStream.outputMode("append").option("checkpointLocation", f"{base}/checkpoint").format("parquet")
        writer.option("path", f"{base}/out").trigger(availableNow=True).start().awaitTermination()
    got = {(r.series_id, (r.ts - START).days): (r.y_true, r.yhat) for r in spark.read.parquet(f"{base}/out").collect()}
    truth = {-2: 8.0, -1: 9.0, 0: 10.0, 1: 2.0, 3: 9.0, 4: 3.0, 20: 5.0, 21: 6.0, 23: 1.0}
    for d in (0, 1, 3, 4, 20, 21, 23):
        assert got["a", d] == (truth[d], 1 + 0.5 * truth.get(d - 1, 0.0) + 0.25 * truth.get(d - 2, 0.0))
    assert got[None, 0] == (7.0, 2 + 9.0) and got[None, 20] == (9.0, 2.0) and got["new", 0] == (1.0, None)
    assert len(got) == 10


def test_window_moves_on():
    assert moved_on(np.array([1.0, 2.0, 3.0]), 1).tolist() == [2.0, 3.0, 0.0]
    assert moved_on(np.array([1.0, 2.0]), 0).tolist() == [1.0, 2.0] and moved_on(np.array([1.0, 2.0]), 9).tolist() == [0.0, 0.0]
