"""The last observed value as forecast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.position import BLOCK_ROWS, over_blocks
from seriesloom.operators.split import phase_from_head
from seriesloom.spec import SeriesSpec


def naive_forecast(df: DataFrame, spec: SeriesSpec, phase: Column | None = None, block: int = BLOCK_ROWS) -> DataFrame:
    """Each row forecast by the row before it; first rows have no forecast."""
    lagged = over_blocks(df, spec, lambda w: {"yhat": F.lag(spec.value).over(w)}, before=1, block=block)
    return lagged.select(
        *spec.keys, spec.time, "pos", "n",
        (phase_from_head() if phase is None else phase).alias("phase"),
        F.col(spec.value).alias("y_true"), "yhat",
    )
