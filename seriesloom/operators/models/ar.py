"""Autoregressive models: order search, differencing tests, rolling refits."""

from __future__ import annotations

import itertools
import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.functions.columns import dot
from seriesloom.operators.features import lag_names, with_lags
from seriesloom.operators.gram import gram, per_key, regress, running_gram, solved, square
from seriesloom.operators.keys import join_on
from seriesloom.operators.metrics import best
from seriesloom.operators.models import arma
from seriesloom.operators.position import block_of, over_blocks
from seriesloom.session import cut_lineage
from seriesloom.spec import SeriesSpec

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# 5 % point of the unit-root statistic, and the share of seasonal variance that asks for a seasonal difference.
UNIT_ROOT_LIMIT, SEASONAL_LIMIT = -2.86, 0.64
# First search bounds by length: below so many rows, near orders, seasonal orders.
TIERS = ((200, 2, 1), (1000, 5, 2), (None, 7, 3))
SMALL_SAMPLE = 200  # rows below which orders are judged by the small-sample criterion


def lag_rows(df: DataFrame, spec: SeriesSpec, lags: int) -> DataFrame:
    """Rows with ``one`` and complete lags."""
    return with_lags(df, spec, lags).withColumn("one", F.lit(1.0))


def information_criteria(n: int, rss: float, k: int) -> tuple[float, float]:
    """AIC and its small-sample form for ``k`` coefficients."""
    room = n - k - 1
    if room <= 0:  # the fit interpolates
        return float("inf"), float("inf")
    aic = n * np.log(max(rss, 1e-300) / n) + 2 * k
    return float(aic), float(aic + 2 * k * (k + 1) / room)


def order_candidates(train: DataFrame, spec: SeriesSpec, max_p: int = 5) -> DataFrame:
    """Coefficients and criteria of AR(0) ... AR(``max_p``) with intercept, all from one pass.

    Every order uses the same rows, so their criteria are comparable. ``betas``
    is intercept and ``max_p`` lags, unused ones 0.
    """
    columns = ["one", *lag_names(max_p), spec.value]
    grams = gram(lag_rows(train, spec, max_p), list(spec.keys), columns)
    size, target = len(columns), len(columns) - 1

    def solve(cells, n, row):
        g, out = square(cells, size), []
        for p in range(max_p + 1):
            at = list(range(p + 1))
            b = solved(g[np.ix_(at, at)], g[at, target])
            rss = max(g[target, target] - b @ g[at, target], 0.0)
            aic, aicc = information_criteria(n, rss, p + 1)
            out.append({"p": p, "n": n, "rss": float(rss), "aic": aic, "aicc": aicc, "betas": [*b.tolist(), *[0.0] * (max_p - p)]})
        return out

    return per_key(grams, list(spec.keys), "p int, n bigint, rss double, aic double, aicc double, betas array<double>", solve)


def fit_plain(train: DataFrame, spec: SeriesSpec, max_p: int = 5) -> DataFrame:
    """The order with the lowest AIC per series."""
    return cut_lineage(best(order_candidates(train, spec, max_p), list(spec.keys), "aic", "p"))


def one_step(df: DataFrame, params: DataFrame, spec: SeriesSpec, max_p: int = 5) -> DataFrame:
    """One-step forecasts from intercept and lag coefficients."""
    rows = join_on(lag_rows(df, spec, max_p), params.select(*spec.keys, "betas"), spec.keys)
    yhat = dot("betas", ["one", *lag_names(max_p)])
    return rows.withColumn("yhat", yhat).drop("betas", "one", *lag_names(max_p))


def unit_root_statistics(df: DataFrame, spec: SeriesSpec, lags: int = 4) -> DataFrame:
    """t statistics of the lagged level for the series (``level_t``) and its difference (``diff_t``).

    Both regressions are linear maps of the same lag columns, hence one pass.
    """
    width = lags + 3
    columns = ["one", spec.value, *lag_names(width - 1)]
    grams = gram(lag_rows(df, spec, width - 1), list(spec.keys), columns)

    def difference(order: int) -> np.ndarray:
        """Row i: the ``order``-th difference at lag i as weights of the level columns."""
        weights = np.eye(width)
        for _ in range(order):
            weights = weights[:-1] - weights[1:]
        return weights

    def statistic(g, n, d):
        level, change = difference(d), difference(d + 1)
        rows = np.vstack([level[1], change[1 : lags + 1], change[0]])
        t = np.zeros((len(rows) + 1, width + 1))
        t[0, 0] = 1.0
        t[1:, 1:] = rows
        m = t @ g @ t.T
        x, y = m[:-1, :-1], m[:-1, -1]
        try:
            inverse = np.linalg.inv(x)
        except np.linalg.LinAlgError:
            return None
        b = inverse @ y
        rest = n - len(b)
        sigma = (m[-1, -1] - b @ y) / rest if rest > 0 else 0.0
        spread = sigma * inverse[1, 1]
        return float(b[1] / np.sqrt(spread)) if spread > 0 else None

    def solve(cells, n, row):
        g = square(cells, width + 1)
        return [{"n": n, "level_t": statistic(g, n, 0), "diff_t": statistic(g, n, 1)}]

    return per_key(grams, list(spec.keys), "n bigint, level_t double, diff_t double", solve)


def seasonal_strength(df: DataFrame, spec: SeriesSpec, season: int = 7) -> DataFrame:
    """Share of the variance explained by the mean of each place in the season; needs ``pos``."""
    keys = list(spec.keys)
    places = df.groupBy(*keys, (F.col("pos") % season).alias("_place")).agg(
        F.count(spec.value).alias("_n"), F.sum(spec.value).alias("_s"), F.sum(F.col(spec.value) * F.col(spec.value)).alias("_q")
    )
    total = F.sum("_n")
    between = F.sum(F.col("_s") * F.col("_s") / F.col("_n")) - F.sum("_s") * F.sum("_s") / total
    overall = F.sum("_q") - F.sum("_s") * F.sum("_s") / total
    return places.groupBy(*keys).agg(total.alias("n"), F.coalesce(F.try_divide(between, overall), F.lit(0.0)).alias("strength"))


def seasonal_root_limit(season: int) -> float:
    """5 % point of the seasonal-root statistic, a published fit to simulated values (fixed numbers)."""
    x = math.log(season) - 0.7656451
    return -0.2937411 * math.exp(-0.2850853 * x - 0.05983644 * x * x) - 1.652202


def seasonal_root_statistics(df: DataFrame, spec: SeriesSpec, season: int = 7, max_lag: int = 3) -> DataFrame:
    """The seasonal-root regression of every series with 1 ... ``max_lag`` lags: ``statistic`` and ``aic``.

    With y the first difference of the seasonal difference, an autoregression of y
    filters the seasonal difference (z4) and the first difference (z5); y is then
    regressed on its lags, z4 one row and z5 one season before, and the statistic is
    the t value of z5. Every regressor is a linear map of the same lag columns, so
    both regressions come from one pass; all lag counts use the same rows.
    """
    width = season + max_lag + 2
    columns = ["one", spec.value, *lag_names(width - 1)]
    grams = gram(lag_rows(df, spec, width - 1), list(spec.keys), columns)

    def shifted(weights: dict[int, float], by: int) -> np.ndarray:
        row = np.zeros(width + 1)
        for lag, w in weights.items():
            row[1 + lag + by] += w
        return row

    first, seasonal = {0: 1.0, 1: -1.0}, {0: 1.0, season: -1.0}
    both = {0: 1.0, 1: -1.0, season: -1.0, season + 1: 1.0}

    def solve(cells, n, row):
        g, out = square(cells, width + 1), []
        one = np.eye(1, width + 1)[0]
        for p in range(1, max_lag + 1):
            own = [shifted(both, i) for i in range(p + 1)]
            x = np.vstack([one, *own[1:]])
            filtered = solved(x @ g @ x.T, x @ g @ own[0])

            def without_past(weights, by):
                return shifted(weights, by) - filtered[0] * one - sum(f * shifted(weights, by + i) for i, f in enumerate(filtered[1:], 1))

            x = np.vstack([*own[1:], without_past(seasonal, 1), without_past(first, season)])
            m, y = x @ g @ x.T, x @ g @ own[0]
            b = solved(m, y)
            rss, room = max(float(own[0] @ g @ own[0] - b @ y), 0.0), n - len(b)
            spread = rss / room * np.linalg.pinv(m, hermitian=True)[-1, -1] if room > 0 else 0.0
            aic = n * math.log(max(rss, 1e-300) / n) + 2 * len(b) if room > 0 else None
            out.append({"lags": p, "n": n, "statistic": float(b[-1] / math.sqrt(spread)) if spread > 0 else None, "aic": aic})
        return out

    return per_key(grams, list(spec.keys), "lags int, n bigint, statistic double, aic double", solve)


def difference_orders(
    df: DataFrame, spec: SeriesSpec, season: int = 7, max_d: int = 2, max_seasonal: int = 1, lags: int = 4, seasonal_test: str = "root",
) -> DataFrame:
    """``d`` from unit-root tests and ``seasonal_d`` per series.

    ``seasonal_test`` is ``root``, the seasonal-root regression with the lags of the
    least criterion, or ``strength``, the share of the variance that the places in
    the season explain. Series too short for the unit-root test take one difference,
    those shorter than two seasons or than the regression no seasonal one.
    """
    if seasonal_test not in ("root", "strength"):
        raise ValueError(f"unknown seasonal test {seasonal_test!r}")
    keys = list(spec.keys)
    tests = unit_root_statistics(df, spec, lags).select(*keys, "level_t", "diff_t")
    joined = join_on(seasonal_strength(df, spec, season), tests, keys, "left")
    d = (
        F.when(F.col("level_t") < UNIT_ROOT_LIMIT, 0)
        .when(F.col("level_t").isNull() | (F.col("diff_t") < UNIT_ROOT_LIMIT), 1)
        .otherwise(2)
    )
    seasonal, extra = F.col("strength") > SEASONAL_LIMIT, []
    if seasonal_test == "root":
        roots = best(seasonal_root_statistics(df, spec, season).where("aic IS NOT NULL"), keys, "aic", "lags")
        joined = join_on(joined, roots.select(*keys, "statistic"), keys, "left")
        seasonal, extra = F.col("statistic") > seasonal_root_limit(season), ["statistic"]
    seasonal = F.when(seasonal & (F.col("n") >= 2 * season), 1).otherwise(0)
    return joined.select(
        *keys, "n", F.least(d, F.lit(max_d)).alias("d"), F.least(seasonal, F.lit(max_seasonal)).alias("seasonal_d"),
        "level_t", "diff_t", "strength", *extra,
    )


def order_bounds(
    lengths: DataFrame, season: int = 7, max_p: int = 5, max_q: int = 5, max_sp: int = 2, max_sq: int = 2,
    tiers: tuple = TIERS, small_sample: int = SMALL_SAMPLE,
) -> DataFrame:
    """First search bounds per series from its length ``n``: those of its tier, within a coefficient budget."""
    n = F.col("n")

    def tier(place: int, most: int):
        chosen = F.coalesce(*[F.lit(t[place]) if t[0] is None else F.when(n < t[0], t[place]) for t in tiers])
        return F.least(chosen, F.lit(most))

    seasonal = n >= 2 * season
    sp = F.when(seasonal, tier(2, max_sp)).otherwise(0)
    sq = F.when(seasonal, tier(2, max_sq)).otherwise(0)
    budget = F.greatest(F.lit(2), F.least(F.lit(12), F.expr("n div 10"))).cast("int")
    first = lengths.withColumns({"_p": tier(1, max_p), "_q": tier(1, max_q), "max_sp": sp, "max_sq": sq})
    # What is over budget is taken from p and q in turn, p first where both are equal; neither falls below 1.
    start = F.struct(F.col("_p").alias("p"), F.col("_q").alias("q"))

    def shrink(acc, _):
        over = acc["p"] + acc["q"] + F.col("max_sp") + F.col("max_sq") > budget
        from_p = over & (acc["p"] >= acc["q"]) & (acc["p"] > 1)
        from_q = over & ~from_p & (acc["q"] > 1)
        return F.struct((acc["p"] - from_p.cast("int")).alias("p"), (acc["q"] - from_q.cast("int")).alias("q"))

    shrunk = F.aggregate(F.sequence(F.lit(1), F.lit(max_p + max_q)), start, shrink)
    return first.withColumn("_b", shrunk).withColumns(
        {"max_p": F.col("_b.p"), "max_q": F.col("_b.q"), "small_sample": n < small_sample}
    ).drop("_p", "_q", "_b")


def operator_weights(d: int, seasonal_d: int, season: int) -> np.ndarray:
    """Weights of the current and earlier values in the difference."""
    weights = np.array([1.0])
    for lag in [1] * d + [season] * seasonal_d:
        step = np.zeros(lag + 1)
        step[0], step[-1] = 1.0, -1.0
        weights = np.convolve(weights, step)
    return weights


def _differenced(df: DataFrame, orders: DataFrame, spec: SeriesSpec, season: int, max_d: int, max_seasonal: int) -> DataFrame:
    """Add the differenced target ``w``, ``w_rest``, the part of the target that the past already fixes, and the value before as ``last``."""
    reach = max_d + season * max_seasonal
    table = {
        (d, s): [*operator_weights(d, s, season), *[0.0] * (reach - d - season * s)]
        for d, s in itertools.product(range(max_d + 1), range(max_seasonal + 1))
    }
    weights = F.coalesce(
        *[
            F.when((F.col("d") == d) & (F.col("seasonal_d") == s), F.array(*[F.lit(float(x)) for x in row]))
            for (d, s), row in table.items()
        ]
    )
    lagged = with_lags(df, spec, max(reach, 1), drop_incomplete=False).na.drop(subset=lag_names(reach))
    rows = join_on(lagged, orders.select(*spec.keys, weights.alias("_weights")), spec.keys)
    past = dot("_weights", [F.lit(0.0), *lag_names(reach)])
    moved = rows.withColumns({"w_rest": -past, "w": F.col(spec.value) + past, "last": F.col("lag_1")})
    return moved.drop("_weights", *lag_names(max(reach, 1)))


def fit_smart(
    train: DataFrame, spec: SeriesSpec, season: int = 7, max_p: int = 5, max_q: int = 5, max_sp: int = 2, max_sq: int = 2,
    max_d: int = 2, max_seasonal: int = 1, long_order: int = 12, steps: int = 8, tiers: tuple = TIERS,
    small_sample: int = SMALL_SAMPLE, seasonal_test: str = "root",
) -> DataFrame:
    """Differencing, order search and coefficients per series.

    A long autoregression gives residuals; the moving-average part is a
    regression on their lags (Hannan and Rissanen). All orders in the bounds are
    sub-matrices of one matrix per series. Bounds that the best order touches are
    widened by one, twice at most. Series shorter than ``small_sample`` are judged
    by AICc. Up to ``steps`` steps of conditional least squares then refine the
    coefficients of the chosen order (:mod:`seriesloom.operators.models.arma`).
    """
    keys = list(spec.keys)
    orders = cut_lineage(difference_orders(train, spec, season, max_d, max_seasonal, seasonal_test=seasonal_test))
    bounds = cut_lineage(order_bounds(orders, season, max_p, max_q, max_sp, max_sq, tiers, small_sample))
    moved = _differenced(train, orders, spec, season, max_d, max_seasonal)
    wspec = spec.using(value="w", features=())
    long_run = cut_lineage(_long_autoregression(moved, wspec, long_order))
    design, names = arma_design(_with_residuals(moved, long_run, wspec, long_order), wspec, season, max_p, max_q, max_sp, max_sq)
    columns = [*names, "w"]
    grams = join_on(gram(design, keys, columns), bounds.drop("n"), keys)
    size = len(columns)
    hard = (max_p, max_q, max_sp, max_sq)

    def index(p, q, sp, sq, intercept):
        used = ["one"] if intercept else []
        used += [f"w_{i}" for i in range(1, p + 1)] + [f"e_{i}" for i in range(1, q + 1)]
        used += [f"w_{season * j}" for j in range(1, sp + 1)] + [f"e_{season * j}" for j in range(1, sq + 1)]
        return sorted({names.index(c) for c in used})

    def solve(cells, n, row):
        g = square(cells, size)
        intercept = row["d"] >= 1 and row["seasonal_d"] == 0
        tried: dict = {}

        def fitted(order):
            if order not in tried:
                at = index(*order, intercept)
                b = solved(g[np.ix_(at, at)], g[at, -1]) if at else np.zeros(0)
                rss = max(g[-1, -1] - (b @ g[at, -1] if at else 0.0), 0.0)
                aic, aicc = information_criteria(n, rss, len(at))
                tried[order] = (aicc if row["small_sample"] else aic, sum(order), order, at, b, rss)
            return tried[order]

        bound = [int(row[c]) for c in ("max_p", "max_q", "max_sp", "max_sq")]
        seasonal = bound[2] + bound[3] > 0
        for _ in range(3):
            choice = min(fitted(o) for o in itertools.product(*[range(b + 1) for b in bound]))[:3]
            if not any(o >= b for o, b in zip(choice[2], bound)):
                break
            wider = [min(b + 1, h) for b, h in zip(bound, hard)]
            bound = wider if seasonal else [*wider[:2], 0, 0]
        criterion, _, order, at, b, rss = fitted(choice[2])
        betas = np.zeros(size - 1)
        betas[at] = b
        p, q, sp, sq = order
        return [{
            "d": int(row["d"]), "seasonal_d": int(row["seasonal_d"]), "p": p, "q": q, "sp": sp, "sq": sq, "n": n,
            "criterion": criterion, "rss": float(rss), "betas": betas.tolist(), "used": at,
        }]

    fields = "d int, seasonal_d int, p int, q int, sp int, sq int, n bigint, criterion double, rss double, betas array<double>, used array<int>"
    found = per_key(grams, keys, fields, solve, ["d", "seasonal_d", "max_p", "max_q", "max_sp", "max_sq", "small_sample"])
    found = join_on(found, bounds.select(*keys, "small_sample"), keys)
    return arma.refined(moved, found, spec, names, steps=steps)


def _long_autoregression(df: DataFrame, spec: SeriesSpec, order: int) -> DataFrame:
    xs = ["one", *lag_names(order)]
    grams = gram(lag_rows(df, spec, order), list(spec.keys), [*xs, spec.value])
    return regress(grams, list(spec.keys), [*xs, spec.value], xs, spec.value, 1e-8)


def _with_residuals(df: DataFrame, long_run: DataFrame, spec: SeriesSpec, order: int) -> DataFrame:
    rows = join_on(lag_rows(df, spec, order), long_run.select(*spec.keys, "betas"), spec.keys)
    expected = dot("betas", ["one", *lag_names(order)])
    return rows.withColumn("e", F.col(spec.value) - expected).drop("betas", "one", *lag_names(order))


def arma_names(season: int, max_p: int, max_q: int, max_sp: int, max_sq: int) -> list[str]:
    """Intercept, lags of the differenced target and of its residuals, near ones and whole seasons back."""
    w_lags = sorted({*range(1, max_p + 1), *[season * j for j in range(1, max_sp + 1)]})
    e_lags = sorted({*range(1, max_q + 1), *[season * j for j in range(1, max_sq + 1)]})
    return ["one", *[f"w_{i}" for i in w_lags], *[f"e_{i}" for i in e_lags]]


def arma_design(df: DataFrame, spec: SeriesSpec, season: int, max_p: int, max_q: int, max_sp: int, max_sq: int) -> tuple[DataFrame, list[str]]:
    """Rows with the columns of :func:`arma_names`."""
    lagged = {c: (c[0], int(c[2:])) for c in arma_names(season, max_p, max_q, max_sp, max_sq)[1:]}
    rows = over_blocks(
        df, spec, lambda win: {name: F.lag(c, i).over(win) for name, (c, i) in lagged.items()},
        before=max([i for _, i in lagged.values()], default=0),
    )
    return rows.na.drop(subset=list(lagged)).withColumn("one", F.lit(1.0)), ["one", *lagged]


def one_step_smart(
    df: DataFrame, params: DataFrame, spec: SeriesSpec, season: int = 7, max_p: int = 5, max_q: int = 5, max_sp: int = 2,
    max_sq: int = 2, max_d: int = 2, max_seasonal: int = 1, **_,
) -> DataFrame:
    """One-step forecasts with the coefficients of :func:`fit_smart` and the same settings.

    The residuals follow from the start of each series, across blocks of its rows.
    """
    moved = _differenced(df, params, spec, season, max_d, max_seasonal)
    names = arma_names(season, max_p, max_q, max_sp, max_sq)
    made = arma.expectations(moved, params, spec, names)
    scored = join_on(moved, made, [*spec.keys, "pos"]).withColumn("yhat", F.col("expected") + F.col("w_rest"))
    return scored.where("yhat IS NOT NULL").drop("expected", "w", "w_rest", "last")


def rolling_refit(
    df: DataFrame, spec: SeriesSpec, p: int = 3, every: int = 3, penalty: float = 0.0, block: int = 16_384
) -> DataFrame:
    """One-step forecasts of validation and test rows, refitted every ``every`` rows on all history so far.

    Needs ``pos`` and ``phase``. A first pass sums the matrices per block of
    positions; their running sums are the history at each block's start. A second
    pass adds the rows inside a block one after the other, so a long series is
    worked on by many tasks.
    """
    names = ["one", *lag_names(p), spec.value]
    rows = lag_rows(df, spec, p).withColumns({"y_true": F.col(spec.value), "base": F.lit(0.0), "last": F.col("lag_1")})

    def solve(history: np.ndarray, lengths: np.ndarray, first: dict) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        betas = np.zeros((len(history), p + 1))
        enough = history[:, 0, 0] > p + 1
        betas[enough] = all_solved(history[enough, :-1, :-1] + penalty * np.eye(p + 1), history[enough, :-1, -1])
        return betas, {"fallback": ~enough}

    return over_history(df, rows, spec, names, every, block, [], "fallback boolean", solve)


def all_solved(matrices: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """:func:`seriesloom.operators.gram.solved` for many systems at once."""
    if not len(matrices) or not matrices.shape[1]:
        return np.zeros(rhs.shape)
    try:
        np.linalg.cholesky(matrices)
        return np.linalg.solve(matrices, rhs[:, :, None])[:, :, 0]
    except np.linalg.LinAlgError:
        return np.array([solved(m, r) for m, r in zip(matrices, rhs)])


def over_history(
    df: DataFrame, rows: DataFrame, spec: SeriesSpec, names: list[str], every: int, block: int, carried: list[str], reported: str, solve,
) -> DataFrame:
    """One-step forecasts of evaluated rows from coefficients refitted every ``every`` rows on all rows before.

    Refits count from the first row of each phase in ``df``. ``names`` are the inputs and, last, the target of the regression; ``rows`` also
    have ``y_true``, ``base`` (added to the forecast) and ``last`` (the forecast of a
    refit that reports ``fallback``). ``solve`` gets the matrices of the history at
    the refits of a block, the positions of the refits and the block's first row
    with the columns ``carried``; it returns coefficients and the ``reported`` columns.
    """
    keys = list(spec.keys)
    starts = df.where(F.col("phase") != "train").groupBy(*keys, "phase").agg(F.min("pos").alias("_start"))
    rows = join_on(rows, cut_lineage(starts), [*keys, "phase"], "left")
    since = F.col("pos") - F.col("_start")
    rows = rows.withColumn("refit_pos", F.col("pos") - since % every)
    history = gram(rows.withColumn("_block", block_of(block)), [*keys, "_block"], names)
    before = running_gram(history, keys, "_block")
    # A block also gets the rows since the last refit before it.
    fixed = [*keys, spec.time, "pos", "n", "phase", "refit_pos", "y_true"]
    inputs = [F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(names)]
    copies = rows.select(*fixed, "base", "last", *carried, *inputs).withColumn(
        "_block", F.explode(F.sequence(block_of(block), block_of(block, every - 1)))
    )
    size, upper = len(names), np.triu_indices(len(names))
    cell = square(np.arange(len(upper[0]), dtype=float), size).astype(int)
    extra = T.StructType.fromDDL(reported)
    schema = copies.select(*keys, spec.time, "pos", "n", "phase", "y_true", "refit_pos").schema.add("yhat", "double")
    schema = T.StructType([*schema.fields, *extra.fields])

    def run(part: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        pos = part["pos"].to_numpy()
        x = part[[f"_x{i}" for i in range(size)]].to_numpy(dtype=float)
        own = (pos // block) == part["_block"].to_numpy()
        base = np.zeros(len(upper[0])) if start.empty else np.asarray(start["cells"].iloc[0], dtype=float)
        # Rows with a missing value or lag are no history, as in the first pass.
        complete = np.isfinite(x).all(axis=1)
        outer = np.where(complete[:, None], x[:, upper[0]] * x[:, upper[1]], 0.0)
        # The base already holds the copied rows: taking them off gives the history at the first row here.
        base = base - outer[~own].sum(axis=0)
        total = base + np.vstack([np.zeros(outer.shape[1]), np.cumsum(outer, axis=0)])
        todo = own & part["phase"].ne("train").to_numpy()
        out = part[todo][[*keys, spec.time, "pos", "n", "phase", "y_true", "refit_pos"]].copy()
        out["refit_pos"] = out["refit_pos"].astype("int64")
        origins, which = np.unique(out["refit_pos"].to_numpy(), return_inverse=True)
        betas, told = np.zeros((0, size - 1)), {f.name: np.zeros(0) for f in extra}
        if len(origins):
            betas, told = solve(total[np.searchsorted(pos, origins)][:, cell], origins, part.iloc[0].to_dict())
        for name in extra.names:
            out[name] = told[name][which]
        lost = out["fallback"].to_numpy(dtype=bool)
        fitted = part["base"].to_numpy(dtype=float)[todo] + (x[todo][:, :-1] * betas[which]).sum(axis=1)
        out["yhat"] = np.where(lost, part["last"].to_numpy(dtype=float)[todo], fitted)
        return out[schema.names]

    grouped = copies.groupBy(*keys, "_block").cogroup(before.groupBy(*keys, "_block"))
    return grouped.applyInPandas(run, schema)


def bounds_at(n: int, hard: tuple[int, int, int, int], season: int, tiers: tuple) -> tuple[int, int, int, int]:
    """:func:`order_bounds` for one length."""
    near, far = next((t[1], t[2]) for t in tiers if t[0] is None or n < t[0])
    p, q = min(near, hard[0]), min(near, hard[1])
    sp, sq = (min(far, hard[2]), min(far, hard[3])) if n >= 2 * season else (0, 0)
    budget = max(2, min(12, n // 10))
    while p + q + sp + sq > budget and (p > 1 or q > 1):
        if p >= q and p > 1:
            p -= 1
        else:
            q -= 1
    return p, q, sp, sq


def rolling_search(
    df: DataFrame, spec: SeriesSpec, season: int = 7, every: int = 3, max_p: int = 5, max_q: int = 5, max_sp: int = 2, max_sq: int = 2,
    max_d: int = 2, max_seasonal: int = 1, long_order: int = 12, tiers: tuple = TIERS, small_sample: int = SMALL_SAMPLE,
    seasonal_test: str = "root", block: int = 16_384,
) -> DataFrame:
    """One-step forecasts whose orders and coefficients are searched again every ``every`` rows on all history so far.

    Needs ``pos`` and ``phase``. Differencing and the long autoregression, whose
    residuals stand for the moving-average part, are those of the training rows. The
    matrix of all lags is summed over blocks and rows (:func:`over_history`), and
    every order at every refit is a sub-matrix of it, so no row is read twice. Bounds
    follow the length of the history as in :func:`order_bounds` and are widened by
    one, twice at most, where the choice touches them. The chosen order is reported;
    a history of no more rows than inputs falls back to the last value.
    """
    keys = list(spec.keys)
    train = df.where(F.col("phase") == "train")
    orders = cut_lineage(difference_orders(train, spec, season, max_d, max_seasonal, seasonal_test=seasonal_test).select(*keys, "d", "seasonal_d"))
    moved = _differenced(df, orders, spec, season, max_d, max_seasonal)
    wspec = spec.using(value="w", features=())
    long_run = cut_lineage(_long_autoregression(moved.where(F.col("phase") == "train"), wspec, long_order))
    design, names = arma_design(_with_residuals(moved, long_run, wspec, long_order), wspec, season, max_p, max_q, max_sp, max_sq)
    design = join_on(design, orders, keys).withColumns({"y_true": F.col(spec.value), "base": F.col("w_rest")})
    hard = (max_p, max_q, max_sp, max_sq)

    def used(order: tuple[int, ...], intercept: bool) -> list[int]:
        p, q, sp, sq = order
        columns = [f"w_{i}" for i in range(1, p + 1)] + [f"e_{i}" for i in range(1, q + 1)]
        columns += [f"w_{season * j}" for j in range(1, sp + 1)] + [f"e_{season * j}" for j in range(1, sq + 1)]
        return sorted({names.index(c) for c in columns} | ({0} if intercept else set()))

    def solve(history: np.ndarray, lengths: np.ndarray, first: dict) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        intercept = first["d"] >= 1 and first["seasonal_d"] == 0
        n, power = history[:, 0, 0], history[:, -1, -1]
        known: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

        def criterion(order: tuple[int, ...]) -> np.ndarray:
            """The criterion of one order at all refits of the block."""
            if order not in known:
                at = used(order, intercept)
                b = all_solved(history[:, at][:, :, at], history[:, at, -1])
                rss = np.maximum(power - (b * history[:, at, -1]).sum(axis=1), 1e-300)
                k, room = len(at), n - len(at) - 1
                with np.errstate(divide="ignore", invalid="ignore"):
                    aic = n * np.log(rss / n) + 2 * k
                    aic = np.where(lengths < small_sample, aic + 2 * k * (k + 1) / room, aic)
                known[order] = b, np.where(room > 0, aic, np.inf)
            return known[order][1]

        bounds = [bounds_at(int(m), hard, season, tiers) for m in lengths]
        order = np.zeros((len(n), 4), np.int64)
        least = np.full(len(n), np.inf)
        open_at = np.arange(len(n))
        for _ in range(3):
            for bound in set(bounds[i] for i in open_at):
                at = np.array([i for i in open_at if bounds[i] == bound])
                least[at], order[at] = np.inf, 0
                for candidate in sorted(itertools.product(*[range(b + 1) for b in bound]), key=lambda o: (sum(o), o)):
                    value = criterion(candidate)[at]
                    better = at[value < least[at]]
                    least[better], order[better] = value[value < least[at]], candidate
            touched = [i for i in open_at if any(o >= b for o, b in zip(order[i], bounds[i]))]
            for i in touched:
                wider = tuple(min(b + 1, h) for b, h in zip(bounds[i], hard))
                bounds[i] = wider if sum(bounds[i][2:]) else (*wider[:2], 0, 0)
            open_at = np.array(touched, np.int64)
            if not len(open_at):
                break
        betas = np.zeros((len(n), len(names)))
        for chosen in {tuple(o) for o in order.tolist()}:
            at = np.flatnonzero((order == chosen).all(axis=1))
            betas[np.ix_(at, used(chosen, intercept))] = known[chosen][0][at] if chosen in known else 0.0
        told = dict(zip(("p", "q", "sp", "sq"), order.T))
        return betas, {**told, "criterion": least, "fallback": ~np.isfinite(least) | (n <= len(names))}

    reported = "p int, q int, sp int, sq int, criterion double, fallback boolean"
    found = over_history(df, design, spec, [*names, "w"], every, block, ["d", "seasonal_d"], reported, solve)
    return found.withColumn("criterion", F.when(~F.col("fallback"), F.col("criterion")))
