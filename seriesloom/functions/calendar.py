"""Calendar parts and seasonal terms of a timestamp."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def calendar_features(time: str) -> dict[str, Column]:
    """Month, day, weekday (Monday is 0), hour and day of the year."""
    return {
        "month": F.month(time),
        "day_of_month": F.dayofmonth(time),
        "day_of_week": F.weekday(time),
        "hour": F.hour(time),
        "day_of_year": F.dayofyear(time),
    }


def date_parts(time: str) -> dict[str, Column]:
    return {"year": F.year(time), "month": F.month(time), "day": F.dayofmonth(time), "weekday": F.weekday(time)}


def month_end_features(time: str) -> dict[str, Column]:
    day = F.to_date(time)
    return {"dayofweek": F.weekday(time), "is_end_of_month": (day == F.last_day(day)).cast("int")}


# Seasonality name -> (period in days, number of harmonics).
SEASONALITIES = {"yearly": (365.25, 10), "weekly": (7.0, 3), "daily": (1.0, 4)}


def epoch_days(time: str) -> Column:
    """Days since 1970-01-01 with the time of day as fraction."""
    day = F.date_diff(F.to_date(time), F.lit("1970-01-01").cast("date"))
    second_of_day = F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time)
    return day.cast("double") + second_of_day.cast("double") / F.lit(86400.0)


def fourier_terms(days: Column, seasonalities: list[str]) -> dict[str, Column]:
    """``sin`` and ``cos`` of each harmonic of the named seasonalities."""
    terms = {}
    for name in seasonalities:
        period, harmonics = SEASONALITIES[name]
        for k in range(1, harmonics + 1):
            angle = F.lit(2.0 * math.pi * k) * days / F.lit(period)
            terms[f"{name}_sin{k}"] = F.sin(angle)
            terms[f"{name}_cos{k}"] = F.cos(angle)
    return terms


def hinge_terms(t: Column, n_changepoints: int, span: float = 0.8) -> dict[str, Column]:
    """Slope changes of a piecewise-linear trend at even points of the first ``span`` of ``t`` in [0, 1]."""
    return {
        f"hinge{j}": F.greatest(F.lit(0.0), t - F.lit(span * j / n_changepoints)) for j in range(1, n_changepoints + 1)
    }
