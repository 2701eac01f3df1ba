"""Frames several queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.operators.features import with_lags
from seriesloom.operators.split import phase_from_head
from seriesloom.session import cut_lineage
from seriesloom.sources.series import PANEL, daily_orders, table


def phased(spark: SparkSession, folder: str) -> DataFrame:
    """Gap-free order days with their 60/20/20 phase, as a written table for repeated use."""
    return cut_lineage(daily_orders(spark, folder).withColumn("phase", phase_from_head()))


def fixed_forecast(spark: SparkSession, folder: str) -> DataFrame:
    """One-step forecasts of the order days from three lags with fixed coefficients."""
    lagged = with_lags(phased(spark, folder), PANEL, 10)
    yhat = 0.5 * F.col("lag_1") + 0.3 * F.col("lag_7") + 0.2 * F.col("lag_10")
    return lagged.select("series_id", "ts", "pos", "n", "phase", F.col("value").alias("y_true"), yhat.alias("yhat"))


def dirty_items(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as text with unreadable, missing and infinite cells."""
    items = table(spark, folder, "lineitem")
    tax = F.col("l_tax")
    date = F.when((F.col("l_linestatus") == "O") & (tax == 0), "not a date").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    value = (
        F.when((F.col("l_discount") == 0) & (tax == 0), "NaN")
        .when(F.col("l_discount") == 0, "Infinity")
        .when(tax == 0.01, "n/a")
        .when(tax == 0.02, None)
        .otherwise(F.col("l_extendedprice").cast("string"))
    )
    return items.select(
        F.col("l_returnflag").alias("series_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        date.alias("date"), value.alias("value"),
    )
