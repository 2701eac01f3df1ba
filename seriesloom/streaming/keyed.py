"""Scoring a stream with the last values of each series as keyed state.

The state of a series is its last ``lags`` grid values and the step of the newest
one, so its size does not depend on how long the stream has run, and no batch
reads earlier rows again. It lives in the state store below the checkpoint of the
query: a restarted query goes on where it ended, a lost executor loses nothing.
After ``lags`` steps without rows all values would be 0, which is what no state
means, so it expires then.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from seriesloom.operators.gram import plain
from seriesloom.operators.keys import join_on
from seriesloom.session import cut_lineage
from seriesloom.spec import SeriesSpec

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE = "step bigint, recent array<double>"


def use_keyed_state(spark: SparkSession) -> None:
    """Choose the state store that keyed state with timers needs."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def moved_on(recent: np.ndarray, steps: int) -> np.ndarray:
    """The window ``steps`` later, with 0 for what is not known yet."""
    out = np.zeros_like(recent)
    if steps < len(recent):
        out[: len(recent) - steps] = recent[steps:]
    return out


# Names of the columns handed to the processor; a leading underscore would be renamed on the way.
class RecentValues(StatefulProcessor):
    """Forecasts finished grid steps one step ahead from the values before them."""

    def __init__(self, keys: list[str], columns: list[str], lags: int, step_seconds: int):
        self.keys, self.columns, self.lags, self.step_seconds = keys, columns, lags, step_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("recent", STATE)

    def _store(self, step: int, recent: np.ndarray) -> None:
        self.state.update((step, recent.tolist()))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((step + self.lags + 1) * self.step_seconds * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values("loom_step")  # finished steps of one series in one batch
        if self.state.exists():
            step, recent = self.state.get()
        else:  # what the history ends with; nothing of it is left after an expiry
            step, recent = found["loom_last"].iloc[0], found["loom_recent"].iloc[0]
        if recent is None:
            step, recent = None, np.zeros(self.lags)
        recent, out = np.asarray(recent, float), []
        for now, value, betas in zip(found["loom_step"], found["loom_value"], found["loom_betas"]):
            now = int(now)
            recent = np.zeros(self.lags) if step is None else moved_on(recent, now - 1 - int(step))
            known = betas is not None
            yhat = float(betas[0] + np.asarray(betas[1:], float) @ recent[::-1]) if known else None
            out.append((pd.Timestamp(now * self.step_seconds, unit="s"), float(value), yhat))
            recent, step = moved_on(recent, 1), now
            recent[-1] = value
        self._store(step, recent)
        made = pd.DataFrame(out, columns=self.columns[len(self.keys) :])
        for i, (name, value) in enumerate(zip(self.keys, key)):
            made.insert(i, name, pd.Series([plain(value)] * len(made), dtype=object))
        yield made

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def score_keyed(
    stream: DataFrame, params: DataFrame, spec: SeriesSpec, step: str, step_seconds: int, lateness: str, lags: int,
    history: DataFrame | None = None,
) -> DataFrame:
    """A stream of one-step forecasts of each grid step that is finished: keys, time, ``y_true`` and ``yhat``.

    Values are summed per series and step first; events later than ``lateness`` are
    dropped, absent steps count as 0. ``params`` holds ``betas`` per series, intercept
    first, then the value one step before and so on; a series without them gets NULL.
    ``history`` gives values before the stream starts; a series without state goes on
    from its last ``lags`` steps. The stream's time is a timestamp with zone.
    """
    keys = list(spec.keys)
    sums = (
        stream.withWatermark(spec.time, lateness)
        .groupBy(*keys, F.window(spec.time, step).alias("_window"))
        .agg(F.sum(spec.value).cast("double").alias("loom_value"))
        .select(*keys, F.window_time("_window").alias("loom_event"), _step_of(F.col("_window.start"), step_seconds).alias("loom_step"), "loom_value")
    )
    rows = join_on(sums, params.select(*keys, F.col("betas").alias("loom_betas")), keys, "left")
    if history is None:
        rows = rows.withColumns({"loom_last": F.lit(None).cast("bigint"), "loom_recent": F.lit(None).cast("array<double>")})
    else:
        rows = join_on(rows, _recent(history, spec, step_seconds, lags), keys, "left")
    schema = T.StructType(
        [stream.schema[k] for k in keys]
        + [T.StructField(spec.time, T.TimestampType()), T.StructField("y_true", T.DoubleType()), T.StructField("yhat", T.DoubleType())]
    )
    processor = RecentValues(keys, schema.names, lags, step_seconds)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "EventTime")


def _recent(history: DataFrame, spec: SeriesSpec, step_seconds: int, lags: int) -> DataFrame:
    """Per series the last step and the values of the ``lags`` steps up to it, oldest first."""
    keys = list(spec.keys)
    placed = history.groupBy(*keys, _step_of(F.col(spec.time), step_seconds).alias("loom_step")).agg(F.sum(spec.value).cast("double").alias("loom_value"))
    ends = placed.groupBy(*keys).agg(F.max("loom_step").alias("loom_last"))
    late = join_on(placed, ends, keys).withColumn("_back", (F.col("loom_last") - F.col("loom_step")).cast("int")).where(F.col("_back") < lags)
    at = late.groupBy(*keys, "loom_last").agg(F.map_from_entries(F.collect_list(F.struct("_back", "loom_value"))).alias("_at"))
    cells = F.transform(F.sequence(F.lit(lags - 1), F.lit(0)), lambda back: F.coalesce(F.element_at("_at", back), F.lit(0.0)))
    return cut_lineage(at.select(*keys, "loom_last", cells.alias("loom_recent")))


def _step_of(time: Column, step_seconds: int) -> Column:
    return F.floor(F.unix_seconds(time) / step_seconds).cast("bigint")
