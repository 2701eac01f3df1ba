"""Phases, folds and forecast origins, all from ``pos`` and ``n``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.spec import SeriesSpec

Ratio = tuple[int, int]


def _pos() -> Column:
    return F.col("pos")


def _n() -> Column:
    return F.col("n")


def _rounded(ratio: float) -> Column:
    """Rows for a ratio of the series, halves to the even number."""
    return F.bround(_n().cast("double") * F.lit(float(ratio))).cast("bigint")


def _floored(ratio: Ratio) -> Column:
    top, bottom = ratio
    return F.expr(f"n * {top} div {bottom}")


def _phase(val_from: Column, test_from: Column) -> Column:
    return F.when(_pos() < val_from, "train").when(_pos() < test_from, "val").otherwise("test")


def phase_from_tail(test: float = 0.2, val: float = 0.2) -> Column:
    """The last rounded share is test, the one before validation, the rest train."""
    test_from = F.greatest(_n() - _rounded(test), F.lit(0))
    val_from = F.greatest(test_from - _rounded(val), F.lit(0))
    return _phase(val_from, test_from)


def phase_from_head(train: Ratio = (6, 10), val: Ratio = (2, 10)) -> Column:
    """The first floored share is train, the next validation, the rest test."""
    if train[0] * val[1] + val[0] * train[1] > train[1] * val[1]:
        raise ValueError("train and validation shares sum to more than the series")
    return _phase(_floored(train), _floored(train) + _floored(val))


def phase_rounded(train: float = 0.6, val: float = 0.2) -> Column:
    """As :func:`phase_from_head` with rounded shares and at least one training row."""
    train_rows = F.greatest(_rounded(train), F.lit(1))
    return _phase(train_rows, train_rows + _rounded(val))


def phase_two_way(train: Ratio = (8, 10)) -> Column:
    """Train and test only."""
    return F.when(_pos() < _floored(train), "train").otherwise("test")


def refit_origin(every: int) -> Column:
    """Position in the evaluated part at which the model used for this row was fitted."""
    return F.expr(f"step div {every} * {every}")


def fold_role(fold: Column | int, folds: int = 5) -> Column:
    """``fit``, ``eval`` or NULL: a fold evaluates one block of rows after all it fits on."""
    size = F.expr(f"n div {folds + 1}")
    start = _n() - (folds + 1 - fold) * size
    return F.when((size > 0) & (_pos() < start), "fit").when((size > 0) & (_pos() < start + size), "eval")


def expanding_folds(df: DataFrame, folds: int = 5) -> DataFrame:
    """Rows repeated per fold 1..``folds`` with their ``role`` in it."""
    out = df.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    return out.withColumn("role", fold_role(F.col("fold"), folds)).where(F.col("role").isNotNull())


def is_origin(need: int, step: int, from_tail: bool = False) -> Column:
    """Whether a rolling window of ``need`` rows starts at this row.

    Windows start every ``step`` rows from the first row on while they fit; a
    series too short for one still has its last possible start. ``from_tail``
    keeps only the last possible start.
    """
    last = F.greatest(_n() - need, F.lit(0))
    if from_tail:
        return _pos() == last
    return F.when(_n() >= need, (_pos() % step == 0) & (_pos() <= last)).otherwise(_pos() == last)


def rolling_origins(df: DataFrame, spec: SeriesSpec, need: int, step: int, from_tail: bool = False) -> DataFrame:
    """One row per rolling window with its start ``origin`` and the start's time."""
    starts = df.where(is_origin(need, step, from_tail))
    return starts.select(*spec.keys, F.col("pos").alias("origin"), spec.time, "n")


def phase_by_length(val_rows: str, test_rows: str) -> Column:
    """Phase from known row counts of the later parts: train is what is left."""
    test_from = _n() - F.col(test_rows)
    return _phase(test_from - F.col(val_rows), test_from)


def only_phase(df: DataFrame, phase: str) -> DataFrame:
    """Rows of one phase; a frame without phases counts its first 80 % as validation."""
    if "phase" in df.columns:
        return df.where(F.col("phase") == phase)
    head = _pos() < _floored((8, 10))
    return df.where(head if phase == "val" else ~head)
