"""Series sets derived from the order, line item and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.session import cut_lineage
from seriesloom.sources.resample import aggregate_to_grid, fill_grid
from seriesloom.spec import SeriesSpec

PANEL = SeriesSpec(features=("n_orders",))
EVENTS = SeriesSpec()
SHIPMENTS = SeriesSpec(
    ties=(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "value",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus",
    )
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def exact_sum(c: str) -> Column:
    """Sum of a two-decimal amount, independent of the order of addition."""
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


def orders_by_day(spark: SparkSession, folder: str) -> DataFrame:
    """Order value and count per priority and day with orders; days without are absent.

    The result is a written table: what follows reads it more than once, and the
    orders should be scanned only once.
    """
    orders = table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").alias("ts"), "o_totalprice"
    )
    return cut_lineage(
        aggregate_to_grid(
            orders, PANEL, "day", value=exact_sum("o_totalprice"), n_orders=F.count(F.lit(1)).cast("double")
        )
    )


def daily_orders(spark: SparkSession, folder: str, fill: float | None = 0.0) -> DataFrame:
    """:func:`orders_by_day` on every day of the series, with ``pos`` and ``n``."""
    return fill_grid(orders_by_day(spark, folder), PANEL, "day", fill)


def daily_events(spark: SparkSession, folder: str) -> DataFrame:
    """Event value per event type and day, with ``pos`` and ``n``."""
    events = table(spark, folder, "events").select(F.col("event_type").alias("series_id"), "ts", "value")
    summed = cut_lineage(aggregate_to_grid(events, EVENTS, "day", value=exact_sum("value")))
    return fill_grid(summed, EVENTS, "day", 0.0)


def hourly_users(spark: SparkSession, folder: str) -> DataFrame:
    """Events per user and hour, with ``pos`` and ``n``: many short series."""
    events = table(spark, folder, "events").select(F.col("user_id").cast("string").alias("series_id"), "ts")
    counted = cut_lineage(aggregate_to_grid(events, EVENTS, "hour", value=F.count(F.lit(1)).cast("double")))
    return fill_grid(counted, EVENTS, "hour", 0.0)


def shipments(spark: SparkSession, folder: str) -> DataFrame:
    """All line items as one series of quantities in shipping order."""
    items = table(spark, folder, "lineitem")
    return items.select(
        F.lit("shipments").alias("series_id"), F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("value"),
        *[c for c in SHIPMENTS.ties if c != "value"],
    )
