"""Typing and value-range expressions; missing is always NULL, never NaN."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """NaN and infinities become NULL."""
    c = _col(c).cast("double")
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def number(c: Column | str) -> Column:
    """Text or any numeric type to a finite double; unreadable text becomes NULL."""
    return finite(_col(c).try_cast("double"))


def timestamp(c: Column | str, fmt: str | None = None) -> Column:
    """Text to a timestamp without zone; unreadable text becomes NULL."""
    c = _col(c)
    parsed = c.try_cast("timestamp_ntz") if fmt is None else F.try_to_timestamp(c, F.lit(fmt))
    return parsed.cast("timestamp_ntz")


def clipped(c: Column | str, low: Column | float, high: Column | float) -> Column:
    """Limit to ``[low, high]``; NULL stays NULL."""
    c = _col(c)
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))


def finite_array(c: Column | str) -> Column:
    """Missing and non-finite elements of a numeric array become 0."""
    return F.transform(_col(c), lambda x: F.coalesce(finite(x), F.lit(0.0)))


def concat_arrays(*arrays: Column | str) -> Column:
    """Concatenate arrays, skipping missing ones."""
    empty = F.array().cast("array<double>")
    return F.concat(*[F.coalesce(_col(a), empty) for a in arrays])


def dot(betas: Column | str, xs: list[Column | str]) -> Column:
    """Inner product of a coefficient array with columns, as plain arithmetic."""
    betas = _col(betas)
    return reduce(lambda a, b: a + b, [betas[i] * _col(x) for i, x in enumerate(xs)])


def weighted_sum(betas: Column | str, xs: Column | str) -> Column:
    """Inner product of two arrays of the same length."""
    products = F.zip_with(_col(betas), _col(xs), lambda b, x: b * x)
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)
