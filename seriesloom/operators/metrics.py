"""Accuracy as aggregate expressions over ``y_true`` and ``yhat``; no usable pair gives NULL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.operators.keys import join_on
from seriesloom.functions.columns import finite
from seriesloom.operators.position import over_blocks
from seriesloom.session import cut_lineage
from seriesloom.spec import SeriesSpec

# Guards of the different relative errors.
MASK_EPS, CLASSIC_EPS, STABLE_EPS = 1e-8, 2.220446049250313e-16, 1e-3


def _y(y: Column | str) -> Column:
    return F.col(y) if isinstance(y, str) else y


def rmse(y: str = "y_true", yhat: str = "yhat") -> Column:
    error = _y(y) - _y(yhat)
    return F.sqrt(F.avg(error * error))


def mae(y: str = "y_true", yhat: str = "yhat") -> Column:
    return F.avg(F.abs(_y(y) - _y(yhat)))


def mape_masked(y: str = "y_true", yhat: str = "yhat", eps: float = MASK_EPS) -> Column:
    """Only truths larger than ``eps`` count."""
    size = F.abs(_y(y))
    return F.avg(F.when(size > eps, F.abs(_y(y) - _y(yhat)) / (size + eps)))


def mape_safe(y: str = "y_true", yhat: str = "yhat", eps: float = MASK_EPS) -> Column:
    """As :func:`mape_masked` without terms that are not finite."""
    size = F.abs(_y(y))
    return F.avg(F.when(size > eps, finite(F.abs(_y(y) - _y(yhat)) / (size + eps))))


def mape_classic(y: str = "y_true", yhat: str = "yhat") -> Column:
    """All truths count; zeros are replaced by the smallest float step."""
    return F.avg(F.abs(_y(y) - _y(yhat)) / F.greatest(F.abs(_y(y)), F.lit(CLASSIC_EPS)))


def mape_eps(y: str = "y_true", yhat: str = "yhat", eps: float = MASK_EPS) -> Column:
    return F.avg(F.abs(_y(y) - _y(yhat)) / (F.abs(_y(y)) + eps))


def mape_stable(y: str = "y_true", yhat: str = "yhat", eps: float = STABLE_EPS) -> Column:
    return F.avg(F.abs(_y(yhat) - _y(y)) / F.greatest(F.abs(_y(y)), F.lit(eps)))


def mape_percent(y: str = "y_true", yhat: str = "yhat") -> Column:
    """In percent, zeros skipped."""
    return F.avg(F.when(_y(y) != 0, F.abs((_y(yhat) - _y(y)) / _y(y)))) * 100.0


METRICS = {
    "rmse": rmse, "mae": mae, "mape_masked": mape_masked, "mape_safe": mape_safe, "mape_classic": mape_classic,
    "mape_eps": mape_eps, "mape_stable": mape_stable, "mape_percent": mape_percent,
}


def evaluate(df: DataFrame, by: list[str], *names: str) -> DataFrame:
    """The named metrics per group; partial aggregation keeps a frequent group cheap."""
    return df.groupBy(*by).agg(*[METRICS[name]().alias(name) for name in names])


def evaluate_pairs(df: DataFrame, by: list[str]) -> DataFrame:
    """RMSE and masked MAPE over rows where both sides are known."""
    pairs = df.where(F.col("y_true").isNotNull() & F.col("yhat").isNotNull())
    return pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_pairs"), rmse().alias("rmse"), mape_masked().alias("mape")
    )


def compare(df: DataFrame, by: list[str], raw: str = "yhat", corrected: str = "corrected") -> DataFrame:
    """Raw against corrected forecast in one aggregation; improvement is raw minus corrected."""
    both = df.groupBy(*by).agg(
        mape_classic(yhat=raw).alias("raw_mape"), rmse(yhat=raw).alias("raw_rmse"),
        mape_classic(yhat=corrected).alias("corrected_mape"), rmse(yhat=corrected).alias("corrected_rmse"),
    )
    return both.withColumns(
        {
            "improvement_mape": F.col("raw_mape") - F.col("corrected_mape"),
            "improvement_rmse": F.col("raw_rmse") - F.col("corrected_rmse"),
        }
    )


def passes(max_rmse: float = 10.0, max_mape: float = 0.05, logic: str = "and") -> Column:
    """Whether ``rmse`` and ``mape`` reach their targets; an unknown metric does not."""
    low_rmse = F.coalesce(F.col("rmse") <= max_rmse, F.lit(False))
    low_mape = F.coalesce(F.col("mape") <= max_mape, F.lit(False))
    return low_rmse & low_mape if logic == "and" else low_rmse | low_mape


def best(df: DataFrame, by: list[str], metric: str, tie: str) -> DataFrame:
    """The row with the smallest metric per group; the smallest ``tie`` wins equal ones."""
    ranked = F.min_by(F.struct("*"), F.struct(F.col(metric).isNull(), F.col(metric), F.col(tie)))
    return df.groupBy(*by).agg(ranked.alias("_best")).select("_best.*") if by else df.agg(ranked.alias("_best")).select("_best.*")


def long_metrics(df: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """One row per group and metric."""
    return df.unpivot(by, names, "metric", "score")


def metric_table(df: DataFrame, by: list[str], phases: tuple[str, ...] = ("val", "test")) -> DataFrame:
    """Metrics as rows, phases as columns."""
    return df.groupBy(*by, "metric").pivot("phase", list(phases)).agg(F.first("score"))


def percent_text(c: Column | str) -> Column:
    return F.format_string("%.2f%%", _y(c) * 100.0)


CHI_STEPS = 400  # terms of the series and of the continued fraction


def chi_square_tail(q: Column, dof: Column) -> Column:
    """P(X > q) for any degrees of freedom: the upper incomplete gamma function over the whole one.

    Below a + 1 the power series of the lower part converges fast, above it the
    continued fraction of the upper part, which keeps small tails exact.
    """
    a, x = dof / 2.0, q / 2.0
    # Gamma(a) by its recurrence from Gamma(1) = 1 or Gamma(1/2) = sqrt(pi).
    odd = F.pmod(dof, F.lit(2)) == 1
    first = F.when(odd, F.lit(0.5)).otherwise(F.lit(1.0))
    steps = F.sequence(F.lit(0), F.greatest(F.floor((dof - 1) / 2).cast("int"), F.lit(0)))
    start = F.when(odd, F.lit(math.log(math.pi) / 2)).otherwise(F.lit(0.0))
    log_gamma = F.aggregate(steps, start, lambda acc, i: acc + F.when(first + i < a, F.log(first + i)).otherwise(F.lit(0.0)))
    scale = F.exp(a * F.log(x) - x - log_gamma)

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] * x / (a + i)
        return F.struct((acc["total"] + term).alias("total"), term.alias("term"))

    one = F.struct((1.0 / a).alias("total"), (1.0 / a).alias("term"))
    lower = F.aggregate(F.sequence(F.lit(1), F.lit(CHI_STEPS)), one, add, lambda acc: acc["total"])

    def fraction(acc: Column, i: Column) -> Column:
        return F.try_divide(i * (i - a), x + 2.0 * i + 1.0 - a - acc)

    rest = F.aggregate(F.sequence(F.lit(CHI_STEPS), F.lit(1)), F.lit(0.0), lambda acc, i: F.coalesce(fraction(acc, i), F.lit(0.0)))
    upper = scale / (x + 1.0 - a - rest)
    return F.when(x <= 0, F.lit(1.0)).when(x < a + 1, F.greatest(1.0 - scale * lower, F.lit(0.0))).otherwise(upper)


def ljung_box(df: DataFrame, spec: SeriesSpec, max_lag: int = 10, alpha: float = 0.05) -> DataFrame:
    """Autocorrelation test of the residuals per series; ``df`` is one phase with ``pos``.

    The lag is a quarter of the rows, at least 1 and at most ``max_lag``. Series
    with fewer than four pairs have no test: NULL.
    """
    keys = list(spec.keys)
    pairs = df.where(F.col("y_true").isNotNull() & F.col("yhat").isNotNull())
    residuals = pairs.select(*keys, "pos", (F.col("y_true") - F.col("yhat")).alias("e"))
    means = residuals.groupBy(*keys).agg(F.avg("e").alias("_mean"), F.count(F.lit(1)).alias("n_rows"))
    centred = join_on(residuals, cut_lineage(means), keys).withColumn("e", F.col("e") - F.col("_mean"))
    lagged = over_blocks(
        centred, spec, lambda w: {f"_e{k}": F.lag("e", k).over(w) for k in range(1, max_lag + 1)}, before=max_lag
    )
    sums = lagged.groupBy(*keys, "n_rows").agg(
        F.sum(F.col("e") * F.col("e")).alias("_var"),
        *[F.sum(F.col("e") * F.col(f"_e{k}")).alias(f"_c{k}") for k in range(1, max_lag + 1)],
    )
    n = F.col("n_rows")
    lag = F.least(F.greatest(F.expr("n_rows div 4"), F.lit(1)), F.lit(max_lag))
    terms = [
        F.when(F.lit(k) <= lag, F.pow(F.try_divide(F.col(f"_c{k}"), F.col("_var")), F.lit(2)) / (n - k)).otherwise(F.lit(0.0))
        for k in range(1, max_lag + 1)
    ]
    q = F.when(n > 3, n * (n + 2) * sum(terms[1:], terms[0]))
    tested = sums.select(*keys, "n_rows", lag.alias("lag"), q.alias("q"))
    return tested.withColumn("p_value", chi_square_tail(F.col("q"), F.col("lag"))).withColumn(
        "uncorrelated", F.col("p_value") > alpha
    )


def first_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows per group; Spark keeps only ``k`` candidates per task before the shuffle."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("_rank") <= k).drop("_rank")
