"""Piecewise-linear trend plus seasonality, fitted per series under priors on its coefficients.

The changes of slope have Laplace priors, so most of them are exactly 0, or normal
ones; all other coefficients have normal priors. Both are solved on the matrix of
one pass.
"""

from __future__ import annotations

import itertools
import sys
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.calendar import SEASONALITIES, epoch_days, fourier_terms, hinge_terms
from seriesloom.functions.columns import weighted_sum
from seriesloom.operators.gram import gram_of, per_key, solved, sparse_solved, square
from seriesloom.operators.keys import join_on
from seriesloom.operators.metrics import best, mape_classic
from seriesloom.session import cut_lineage
from seriesloom.sources.resample import step_after
from seriesloom.spec import SeriesSpec

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Settings tried by the search, and the default ones.
GRID = {
    "changepoint_scale": (0.05, 0.1, 0.3, 0.5),
    "n_changepoints": (15, 25, 40),
    "mode": ("additive", "multiplicative"),
    "seasonality_scale": (5.0, 10.0, 20.0),
}
BASE_SCALE, DEFAULT_SEASONALITY_SCALE = 5.0, 10.0
PRIORS = ("laplace", "normal")


@dataclass(frozen=True)
class Shape:
    """Columns of the design: trend terms and seasonal terms."""

    n_changepoints: int = 25
    seasonalities: tuple[str, ...] = ("yearly",)

    @property
    def trend(self) -> list[str]:
        return ["one", "t", *[f"hinge{j}" for j in range(1, self.n_changepoints + 1)]]

    @property
    def season(self) -> list[str]:
        return [
            f"{name}_{f}{k}" for name in self.seasonalities for k in range(1, SEASONALITIES[name][1] + 1) for f in ("sin", "cos")
        ]


def training_span(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """First and last training day and the largest training value per series; needs ``phase``."""
    train = df.where(F.col("phase") == "train")
    peak = F.max(F.abs(spec.value))
    return train.groupBy(*spec.keys).agg(
        F.min(epoch_days(spec.time)).alias("day0"),
        F.max(epoch_days(spec.time)).alias("day1"),
        F.when(peak > 0, peak).otherwise(1.0).alias("peak"),
    )


def with_basis(df: DataFrame, spans: DataFrame, spec: SeriesSpec, shape: Shape) -> DataFrame:
    """Trend and seasonal terms as the arrays ``trend`` and ``season``; time runs from 0 to 1 over the training rows."""
    rows = join_on(df, spans, spec.keys).withColumn("_day", epoch_days(spec.time))
    t = F.coalesce(F.try_divide(F.col("_day") - F.col("day0"), F.col("day1") - F.col("day0")), F.lit(0.0))
    rows = rows.withColumn("_t", t)
    trend = {"one": F.lit(1.0), "t": F.col("_t")} | hinge_terms(F.col("_t"), shape.n_changepoints)
    season = fourier_terms(F.col("_day"), list(shape.seasonalities))
    # Arrays rather than columns: the optimizer reasons about every column it sees.
    arrays = {"trend": F.array(*[trend[c] for c in shape.trend]), "season": F.array(*[season[c] for c in shape.season]).cast("array<double>")}
    return rows.withColumns(arrays).drop("_day", "_t")


def _weights(shape: Shape, names: list[str], changepoint_scale: float, seasonality_scale: float) -> np.ndarray:
    """One over the squared prior scale of each coefficient."""
    scale = {"one": BASE_SCALE, "t": BASE_SCALE}
    season = set(shape.season)
    return np.array([1.0 / scale.get(c, seasonality_scale if c in season else changepoint_scale) ** 2 for c in names])


def _shrunk(g: np.ndarray, n: int, weights: np.ndarray, laplace: np.ndarray) -> np.ndarray:
    """Most likely coefficients, where ``laplace`` under Laplace and else under normal priors; the noise comes from a nearly free fit."""
    x, y = g[:-1, :-1], g[:-1, -1]
    free = solved(x + 1e-6 * np.eye(len(y)), y)
    noise = max(g[-1, -1] - 2 * free @ y + free @ x @ free, 0.0) / max(n - len(y), 1)
    noise = max(noise, 1e-12)
    if not laplace.any():
        return solved(x + np.diag(noise * weights), y)
    return sparse_solved(x, y, np.where(laplace, noise * np.sqrt(weights), 0.0), np.where(laplace, 0.0, noise * weights))


def _solutions(grams: DataFrame, keys: list[str], shape: Shape, names: list[str], scales: list[tuple[float, float]], prior: str) -> DataFrame:
    """Coefficients per key and pair of prior scales, all from one matrix per key."""
    if prior not in PRIORS:
        raise ValueError(f"unknown prior {prior!r}, known are {PRIORS}")
    weights = {s: _weights(shape, names, *s) for s in scales}
    laplace = np.array([prior == "laplace" and c.startswith("hinge") for c in names])

    def solve(cells, n, row):
        g = square(cells, len(names) + 1)
        return [
            {"changepoint_scale": s[0], "seasonality_scale": s[1], "b": _shrunk(g, n, w, laplace).tolist()} for s, w in weights.items()
        ]

    return per_key(grams, keys, "changepoint_scale double, seasonality_scale double, b array<double>", solve)


def _joint(train: DataFrame, keys: list[str], shape: Shape) -> DataFrame:
    """Matrices of trend and seasonal terms together, written for repeated use."""
    vector = F.concat("trend", "season", F.array("_y"))
    return cut_lineage(gram_of(train, keys, vector, len(shape.trend) + len(shape.season) + 1))


def _additive(train: DataFrame, joint: DataFrame, keys: list[str], shape: Shape, scales: list[tuple[float, float]], prior: str) -> DataFrame:
    split = len(shape.trend)
    both = _solutions(joint, keys, shape, [*shape.trend, *shape.season], scales, prior)
    return both.select(
        *keys, "changepoint_scale", "seasonality_scale",
        F.slice("b", 1, split).alias("betas"), F.slice("b", split + 1, len(shape.season)).alias("gammas"),
    ).withColumn("mode", F.lit("additive"))


def _multiplicative(train: DataFrame, joint: DataFrame, keys: list[str], shape: Shape, scales: list[tuple[float, float]], prior: str) -> DataFrame:
    """Trend and seasonality relative to it, fitted in turn; ``scales`` is a full product.

    The additive trend gives a first seasonality, the rows without it a better
    trend, and that the final seasonality.
    """
    by = [*keys, "cs"]
    changes = list(dict.fromkeys(c for c, _ in scales))
    firsts = [(c, DEFAULT_SEASONALITY_SCALE) for c in changes]

    def relative(trends: DataFrame, seasonal: list[float]) -> DataFrame:
        level = weighted_sum("betas", "trend")
        rest = join_on(train, trends, keys).withColumn("_rest", F.try_divide(F.col("_y"), level) - 1.0)
        grams = gram_of(rest, by, F.concat("season", F.array("_rest")), len(shape.season) + 1)
        return _solutions(grams, by, shape, shape.season, [(1.0, s) for s in seasonal], prior).drop("changepoint_scale")

    additive = cut_lineage(_additive(train, joint, keys, shape, firsts, prior).select(*keys, F.col("changepoint_scale").alias("cs"), "betas"))
    seasons = cut_lineage(relative(additive, [DEFAULT_SEASONALITY_SCALE]))
    factor = 1.0 + weighted_sum("b", "season")
    adjusted = join_on(train, seasons.select(*by, "b"), keys).withColumn("_level", F.try_divide(F.col("_y"), factor))
    grams = gram_of(adjusted, by, F.concat("trend", F.array("_level")), len(shape.trend) + 1)
    refits = _solutions(grams, by, shape, shape.trend, firsts, prior)
    trends = cut_lineage(refits.where(F.col("changepoint_scale") == F.col("cs")).select(*by, F.col("b").alias("betas")))
    final = relative(trends, list(dict.fromkeys(s for _, s in scales)))
    return (
        join_on(final, trends, by)
        .select(*keys, F.col("cs").alias("changepoint_scale"), "seasonality_scale", "betas", F.col("b").alias("gammas"))
        .withColumn("mode", F.lit("multiplicative"))
    )


def _training(df: DataFrame, spans: DataFrame, spec: SeriesSpec, shape: Shape) -> DataFrame:
    rows = with_basis(df.where(F.col("phase") == "train"), spans, spec, shape)
    return rows.withColumn("_y", F.col(spec.value) / F.col("peak"))


def fit_trend(
    df: DataFrame, spec: SeriesSpec, shape: Shape = Shape(), changepoint_scale: float = 0.05,
    seasonality_scale: float = DEFAULT_SEASONALITY_SCALE,
    mode: str = "additive", prior: str = "laplace",
) -> DataFrame:
    """Coefficients and training span per series from its training rows; needs ``phase``.

    ``prior`` is that of the changes of slope: ``laplace`` or ``normal``.
    """
    keys = list(spec.keys)
    spans = cut_lineage(training_span(df, spec))
    train = _training(df, spans, spec, shape)
    fit = _additive if mode == "additive" else _multiplicative
    joint = _joint(train, keys, shape)
    return cut_lineage(join_on(fit(train, joint, keys, shape, [(changepoint_scale, seasonality_scale)], prior), spans, keys))


def predict_trend(df: DataFrame, params: DataFrame, spec: SeriesSpec, shape: Shape = Shape(), name: str = "yhat") -> DataFrame:
    """Forecast for the times in ``df``; with several parameter rows per series one forecast for each."""
    keys = list(spec.keys)
    spans = params.select(*keys, "day0", "day1", "peak").distinct()
    rows = join_on(with_basis(df, spans, spec, shape), params.drop("day0", "day1", "peak"), keys)
    level, season = weighted_sum("betas", "trend"), weighted_sum("gammas", "season")
    y = F.when(F.col("mode") == "additive", level + season).otherwise(level * (1.0 + season))
    return rows.withColumn(name, F.col("peak") * y).drop(
        "trend", "season", "betas", "gammas", "day0", "day1", "peak"
    )


def search_trend(
    df: DataFrame, spec: SeriesSpec, seasonalities: tuple[str, ...] = ("yearly",), grid: dict[str, tuple] = GRID, prior: str = "laplace",
) -> DataFrame:
    """Validation error of every setting per series, one row each; needs ``phase``.

    ``config`` numbers the settings in grid order. Settings that share the
    changepoint count share one pass over the rows.
    """
    keys = list(spec.keys)
    numbered = {setting: i for i, setting in enumerate(itertools.product(*[grid[k] for k in GRID]))}
    scales = list(itertools.product(grid["changepoint_scale"], grid["seasonality_scale"]))
    spans = cut_lineage(training_span(df, spec))
    val = df.where(F.col("phase") == "val")
    scores = None
    for count in grid["n_changepoints"]:
        shape = Shape(count, seasonalities)
        train = _training(df, spans, spec, shape)
        joint = _joint(train, keys, shape)
        fits = {"additive": _additive, "multiplicative": _multiplicative}
        parts = [join_on(fits[mode](train, joint, keys, shape, scales, prior), spans, keys) for mode in grid["mode"]]
        params = cut_lineage(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))
        forecast = predict_trend(val, params, spec, shape)
        by = [*keys, "changepoint_scale", "seasonality_scale", "mode"]
        scored = forecast.groupBy(*by).agg(mape_classic(spec.value).alias("mape")).withColumn("n_changepoints", F.lit(count))
        scores = scored if scores is None else scores.unionByName(scored)
    config = F.coalesce(
        *[
            F.when(
                (F.col("changepoint_scale") == c) & (F.col("n_changepoints") == k) & (F.col("mode") == m) & (F.col("seasonality_scale") == s),
                F.lit(i),
            )
            for (c, k, m, s), i in numbered.items()
        ]
    )
    return scores.withColumn("config", config)


def best_trend(scores: DataFrame, spec: SeriesSpec) -> DataFrame:
    """The setting with the smallest validation error per series."""
    return best(scores, list(spec.keys), "mape", "config")


def future_frame(df: DataFrame, spec: SeriesSpec, periods: int, grid: str) -> DataFrame:
    """The next ``periods`` times of each series, numbered by ``step`` from 1."""
    ends = df.groupBy(*spec.keys).agg(F.max(spec.time).alias("_end"))
    steps = ends.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    return steps.select(*spec.keys, step_after("_end", "step", grid).alias(spec.time), "step")
