"""Forecasts and fitted parameters out to files, and back."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_forecast(df: DataFrame, path: str, fmt: str = "parquet", by_phase: bool = True) -> str:
    """Forecast rows as CSV or parquet, by default one folder per phase."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy("phase") if by_phase else writer).save(path)
    return path


def write_params(df: DataFrame, path: str, features: list[str]) -> str:
    """A parameter table together with the feature order it belongs to."""
    df.withColumn("feature_order", F.array(*[F.lit(c) for c in features])).write.mode("overwrite").parquet(path)
    return path


def read_params(spark: SparkSession, path: str, features: list[str]) -> DataFrame:
    """A parameter table; fails where the stored feature order is another one."""
    stored = spark.read.parquet(path)
    expected = F.array(*[F.lit(c) for c in features])
    same = F.when(F.col("feature_order") == expected, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("parameters were fitted for features "), F.array_join("feature_order", ", ")))
    )
    return stored.where(same).drop("feature_order")


def write_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def read_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
