"""Panel time-series forecasting on Spark DataFrames."""

from seriesloom.spec import SeriesSpec

__all__ = ["SeriesSpec"]
