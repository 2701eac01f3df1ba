"""Small frames built from plain lists."""

from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

DAY0 = datetime(2020, 1, 1)


def panel(spark, series, extra=None):
    """``series`` maps an id to its daily values; gives series_id, ts, pos, n, value."""
    rows = [
        (name, DAY0 + timedelta(days=i), i, len(values), None if v is None else float(v))
        for name, values in series.items()
        for i, v in enumerate(values)
    ]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, pos bigint, n bigint, value double")
    return df if extra is None else df.withColumns(extra)


def column(df, name, series=None, order="pos"):
    """Values of a column in order, NULL as None."""
    rows = df if series is None else df.where(F.col("series_id") == series)
    return [r[0] for r in rows.orderBy("series_id", order).select(name).collect()]


def frame(df, *order):
    return df.toPandas().sort_values(list(order)).reset_index(drop=True) if order else df.toPandas()


def nulls(values):
    return [None if v is None or pd.isna(v) else v for v in values]
