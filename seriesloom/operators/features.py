"""Calendar, lag, difference and seasonal features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions import calendar
from seriesloom.operators.keys import join_on
from seriesloom.operators.position import BLOCK_ROWS, over_blocks, running_sum
from seriesloom.session import cut_lineage
from seriesloom.spec import SeriesSpec


def with_calendar(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    return df.withColumns(calendar.calendar_features(spec.time))


def with_date_parts(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    return df.withColumns(calendar.date_parts(spec.time))


def with_month_end(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    return df.withColumns(calendar.month_end_features(spec.time))


def lag_names(n: int) -> list[str]:
    return [f"lag_{i}" for i in range(1, n + 1)]


def with_lags(df: DataFrame, spec: SeriesSpec, n: int = 10, drop_incomplete: bool = True, block: int = BLOCK_ROWS) -> DataFrame:
    """``lag_1`` ... ``lag_n`` of the target; rows without full history are dropped by default."""
    lagged = over_blocks(
        df, spec, lambda w: {name: F.lag(spec.value, i).over(w) for i, name in enumerate(lag_names(n), 1)},
        before=n, block=block,
    )
    return lagged.na.drop(subset=lag_names(n)) if drop_incomplete else lagged


def with_changes(df: DataFrame, spec: SeriesSpec, block: int = BLOCK_ROWS) -> DataFrame:
    """Previous value, difference, relative change and the mean of the last three rows."""
    v = spec.value

    def look_back(w):
        last3 = w.rowsBetween(-2, 0)
        return {
            "value_lag1": F.lag(v).over(w),
            "value_roll3": F.when(F.count(v).over(last3) == 3, F.avg(v).over(last3)),
        }

    return over_blocks(df, spec, look_back, before=2, block=block).withColumns(
        {
            "value_diff": F.col(v) - F.col("value_lag1"),
            "value_pct_change": F.try_divide(F.col(v) - F.col("value_lag1"), F.col("value_lag1")),
        }
    )


def with_trailing_mean(df: DataFrame, spec: SeriesSpec, column: str, name: str, width: int = 3, block: int = BLOCK_ROWS) -> DataFrame:
    """Mean of the last ``width`` rows, of fewer at the start."""
    return over_blocks(
        df, spec, lambda w: {name: F.avg(column).over(w.rowsBetween(1 - width, 0))}, before=width - 1, block=block
    )


def with_difference(
    df: DataFrame, spec: SeriesSpec, column: str, name: str, order: int = 1, season: int = 1, block: int = BLOCK_ROWS
) -> DataFrame:
    """``order`` times the difference to ``season`` rows before."""

    def step(source: str):
        return lambda w: {name: F.col(source) - F.lag(source, season).over(w)}

    stages = [step(column), *[step(name)] * (order - 1)]
    return over_blocks(df, spec, *stages, before=order * season, block=block)


def levels_from_differences(df: DataFrame, spec: SeriesSpec, difference: str, start: str, name: str) -> DataFrame:
    """Cumulative sum of the differences on top of the known ``start`` level."""
    return running_sum(df, spec, difference, "_walk").withColumn(name, F.col(start) + F.col("_walk")).drop("_walk")


def one_step_levels(df: DataFrame, spec: SeriesSpec, difference: str, name: str) -> DataFrame:
    """Previous true value plus the difference of this row."""
    stepped = over_blocks(df, spec, lambda w: {"_last": F.lag(spec.value).over(w)}, before=1)
    return stepped.withColumn(name, F.col("_last") + F.col(difference)).drop("_last")


def box_cox(value: Column, power: Column) -> Column:
    """Power transform; needs positive values."""
    return F.when(power == 0, F.ln(value)).otherwise((F.pow(value, power) - 1) / power)


def inverse_box_cox(moved: Column, power: Column, variance: Column | None = None) -> Column:
    """Back to the units of the value; NULL where no value has this transform.

    The plain inverse of a forecast is a median. With the ``variance`` of the forecast
    error in transformed units it is the mean, to second order.
    """
    base = power * moved + 1
    spread = F.lit(0.0) if variance is None else variance
    log = F.exp(moved) * (1 + spread / 2)
    other = F.pow(base, 1 / F.nullif(power, F.lit(0.0))) * (1 + spread * (1 - power) / (2 * base * base))
    return F.when(power == 0, log).when(base > 0, other)


# Powers tried for the variance-stabilising transform.
POWERS = (-1.0, -0.5, 0.0, 0.5, 1.0, 2.0)


def box_cox_power(df: DataFrame, spec: SeriesSpec, powers: tuple[float, ...] = POWERS) -> DataFrame:
    """The power of the highest profile likelihood per series, from one aggregation.

    Series with a value that is not positive get no power.
    """
    y = F.col(spec.value)
    positive = F.when(y > 0, y)
    spread = [F.stddev_pop(box_cox(positive, F.lit(p))).alias(f"_s{i}") for i, p in enumerate(powers)]
    sums = df.groupBy(*spec.keys).agg(
        F.count(y).alias("_n"), F.count(positive).alias("_ok"), F.sum(F.ln(positive)).alias("_logs"), *spread
    )
    tried = F.array(
        *[
            F.struct(
                (-F.col("_n") * F.ln(F.nullif(F.col(f"_s{i}"), F.lit(0.0))) + (p - 1) * F.col("_logs")).alias("loglik"),
                F.lit(float(p)).alias("power"),
            )
            for i, p in enumerate(powers)
        ]
    )
    best = F.array_max(F.filter(tried, lambda t: t["loglik"].isNotNull()))
    usable = (F.col("_n") == F.col("_ok")) & (F.col("_n") > 0)
    return sums.select(*spec.keys, F.when(usable, best["power"]).alias("power"), F.when(usable, best["loglik"]).alias("loglik"))


def refined_box_cox_power(df: DataFrame, spec: SeriesSpec, powers: tuple[float, ...] = POWERS, rounds: int = 3, cells: int = 8) -> DataFrame:
    """The power of the highest profile likelihood per series, narrowed down between its neighbours in ``powers``.

    Each round is one aggregation that tries ``cells`` + 1 powers in the interval of
    the series and goes on between the neighbours of the best one. Series without a
    power on the grid have none here.
    """
    keys = list(spec.keys)
    first = box_cox_power(df, spec, powers)
    lower = {p: powers[max(i - 1, 0)] for i, p in enumerate(powers)}
    upper = {p: powers[min(i + 1, len(powers) - 1)] for i, p in enumerate(powers)}
    found = cut_lineage(
        first.select(
            *keys, "power", "loglik", *[F.coalesce(*[F.when(F.col("power") == p, float(v)) for p, v in side.items()]).alias(name)
                                        for name, side in (("_low", lower), ("_high", upper))],
        )
    )
    y = F.col(spec.value)
    for _ in range(rounds):
        step = (F.col("_high") - F.col("_low")) / cells
        rows = join_on(df.select(*keys, spec.value), found.where("power IS NOT NULL").select(*keys, "_low", "_high"), keys)
        tried = [F.col("_low") + i * step for i in range(cells + 1)]
        spread = [F.stddev_pop(box_cox(y, p)).alias(f"_s{i}") for i, p in enumerate(tried)]
        sums = rows.groupBy(*keys, "_low", "_high").agg(F.count(y).alias("_n"), F.sum(F.ln(y)).alias("_logs"), *spread)
        likely = [
            F.struct((-F.col("_n") * F.ln(F.nullif(F.col(f"_s{i}"), F.lit(0.0))) + (p - 1) * F.col("_logs")).alias("loglik"), p.alias("power"))
            for i, p in enumerate(tried)
        ]
        best = F.array_max(F.filter(F.array(*likely), lambda t: t["loglik"].isNotNull()))
        sums = sums.select(*keys, "_low", "_high", step.alias("_step"), best.alias("_b"))
        better = sums.select(
            *keys, F.col("_b.power").alias("power"), F.col("_b.loglik").alias("loglik"),
            F.greatest("_low", F.col("_b.power") - F.col("_step")).alias("_low"), F.least("_high", F.col("_b.power") + F.col("_step")).alias("_high"),
        )
        found = cut_lineage(better.unionByName(found.where("power IS NULL")))
    return found.drop("_low", "_high")
