"""Files in, and which columns play which role."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.functions.columns import number, timestamp
from seriesloom.spec import SeriesSpec

# Names that mark a time column, a target column, and parts of time column names.
TIME_NAMES = ("date", "datetime", "time", "timestamp")
TARGET_NAMES = ("value", "target", "close", "temperature", "label")


class ColumnNotFound(ValueError):
    """No column fits the asked role."""


def read_csv(
    spark: SparkSession, path: str, time: str = "date", value: str = "value", keys: tuple[str, ...] = ()
) -> DataFrame:
    """A headed CSV as keys, ``time`` and ``value``; rows without a readable time are dropped."""
    raw = spark.read.csv(path, header=True)
    return typed(raw, resolve_time(raw, time), resolve_value(raw.drop(*keys), value, numeric_text=True), keys)


def typed(df: DataFrame, time: str, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Keep keys, time and value with their types; unreadable values become NULL."""
    return df.select(*keys, timestamp(time).alias(time), number(value).alias(value)).where(F.col(time).isNotNull())


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def resolve_time(df: DataFrame, time: str = "date") -> str:
    """The named column, else the first with a usual time name."""
    if time in df.columns:
        return time
    named = [c for c in df.columns if c.lower() in TIME_NAMES]
    if not named:
        raise ColumnNotFound(f"no time column {time!r} in {df.columns}")
    return named[0]


def resolve_value(df: DataFrame, value: str = "value", numeric_text: bool = False) -> str:
    """The named column, else the first numeric one.

    Columns read as text count as numeric with ``numeric_text`` when every
    filled cell reads as a number.
    """
    if value in df.columns:
        return value
    numeric = numeric_columns(df)
    if not numeric and numeric_text:
        unread = df.agg(
            *[
                F.struct(
                    F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).alias("bad"),
                    F.count(c).alias("filled"),
                ).alias(c)
                for c in df.columns
            ]
        ).first()
        numeric = [c for c in df.columns if unread[c].bad == 0 and unread[c].filled > 0]
    if not numeric:
        raise ColumnNotFound(f"no value column {value!r} and no numeric column in {df.columns}")
    return numeric[0]


def detect_columns(df: DataFrame, target: str | None = None, time_words: tuple[str, ...] = TIME_NAMES) -> tuple[list[str], str]:
    """Features and target by name: time-like names are neither."""
    if target is None:
        target = next((c for c in df.columns if c.lower() in TARGET_NAMES), df.columns[-1])
    features = [c for c in df.columns if c != target and not any(word in c.lower() for word in time_words)]
    return features, target


def select_features(df: DataFrame, spec: SeriesSpec, wanted: list[str] | None = None) -> list[str]:
    """Target first, then all other numeric columns or the present ones of ``wanted``."""
    pool = [c for c in wanted if c in df.columns] if wanted else numeric_columns(df)
    return [spec.value, *[c for c in pool if c not in (spec.value, spec.time)]]


def with_features(df: DataFrame, features: list[str], locked: bool = False) -> DataFrame:
    """Add missing feature columns as 0, or fail when the feature order is locked."""
    missing = [c for c in features if c not in df.columns]
    if missing and locked:
        raise ColumnNotFound(f"features {missing} are missing and their order is locked")
    return df.withColumns({c: F.lit(0.0) for c in missing}) if missing else df


def check_columns(df: DataFrame, time: str, value: str) -> DataFrame:
    """Require both columns and parse the time strictly: unreadable text fails the job."""
    absent = [c for c in (time, value) if c not in df.columns]
    if absent:
        raise ColumnNotFound(f"missing columns {absent}")
    return df.withColumn(time, F.col(time).cast("timestamp_ntz"))
