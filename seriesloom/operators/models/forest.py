"""Random forests on scaled lags, pooled over all series."""

from __future__ import annotations

import random
from collections.abc import Iterator

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.operators import scale
from seriesloom.operators.features import lag_names, with_lags
from seriesloom.operators.keys import join_on
from seriesloom.operators.metrics import best, mape_stable
from seriesloom.operators.post import clamp_positive, smooth
from seriesloom.operators.split import fold_role
from seriesloom.session import cut_lineage
from seriesloom.spec import SeriesSpec

# Settings without a search, and the space of the search.
DEFAULTS = {"n_estimators": 200, "max_depth": 10, "min_samples_leaf": 1, "max_features": "sqrt", "bootstrap": True}
SPACE = {
    "n_estimators": tuple(range(100, 601, 50)),
    "max_depth": tuple(range(4, 31, 2)),
    "min_samples_leaf": tuple(range(1, 9)),
    "max_features": ("sqrt", "log2", "0.5", "0.75", "1.0"),
    "bootstrap": (True, False),
}
# Deepest tree the trainer accepts; the search ends there.
MAX_DEPTH = 30


def lag_design(df: DataFrame, spec: SeriesSpec, n_lags: int = 10) -> DataFrame:
    """Scaled target and lags with the scaler's parameters; needs ``pos`` and ``phase``."""
    params = scale.fit_scaler(df, spec, [spec.value])
    return with_lags(scale.scale(df, params, spec, [spec.value], keep=True), spec, n_lags)


def _stages(features: list[str], label: str, settings: dict, seed: int) -> Pipeline:
    if settings["max_depth"] > MAX_DEPTH:
        raise ValueError(f"trees end at depth {MAX_DEPTH}, not {settings['max_depth']}")
    subset = {"1.0": "all"}.get(settings["max_features"], settings["max_features"])
    trees = RandomForestRegressor(
        featuresCol="_features", labelCol=label, predictionCol="_scaled",
        numTrees=settings["n_estimators"], maxDepth=settings["max_depth"],
        minInstancesPerNode=settings["min_samples_leaf"], featureSubsetStrategy=subset,
        bootstrap=settings["bootstrap"], seed=seed,
    )
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_features"), trees])


def fit_forest(train: DataFrame, spec: SeriesSpec, n_lags: int = 10, seed: int = 42, **settings) -> PipelineModel:
    """One forest for the rows of all series; ``train`` comes from :func:`lag_design`."""
    return _stages(lag_names(n_lags), spec.value, DEFAULTS | settings, seed).fit(train)


def predict_forest(model: PipelineModel, rows: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Forecasts in the units of the target, not below 0."""
    scored = model.transform(rows).withColumn("yhat", scale.unscaled("_scaled", spec.value))
    scored = scored.withColumn("y_true", scale.unscaled(spec.value, spec.value))
    kept = [c for c in ("pos", "n", "phase") if c in rows.columns]
    return scored.select(*spec.keys, spec.time, *kept, "y_true", clamp_positive().alias("yhat"))


def smoothed_forest(model: PipelineModel, rows: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Clamped forecasts smoothed along the evaluated rows of each series."""
    return smooth(predict_forest(model, rows, spec), spec)


def random_settings(trials: int, seed: int = 42, space: dict = SPACE) -> Iterator[dict]:
    draw = random.Random(seed)
    for _ in range(trials):
        yield {name: draw.choice(values) for name, values in space.items()}


def search_forest(
    rows: DataFrame, spec: SeriesSpec, trials: int = 50, folds: int = 5, n_lags: int = 10, seed: int = 42, space: dict = SPACE
) -> DataFrame:
    """Mean error over expanding folds per random setting, one row each.

    ``rows`` comes from :func:`lag_design` with training rows only. Each trial is
    a distributed fit, and only its error comes back.
    """
    sizes = cut_lineage(rows.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("_first")))
    sized = join_on(rows.drop("n"), sizes, spec.keys)
    stored = cut_lineage(sized.withColumn("pos", F.col("pos") - F.col("_first")).drop("_first"))
    results = []
    for trial, settings in enumerate(random_settings(trials, seed, space)):
        errors = []
        for fold in range(1, folds + 1):
            role = fold_role(fold, folds)
            model = fit_forest(stored.where(role == "fit"), spec, n_lags, seed, **settings)
            scored = predict_forest(model, stored.where(role == "eval"), spec)
            errors.append(scored.agg(mape_stable().alias("mape")).first()["mape"])
        known = [e for e in errors if e is not None]
        results.append({"trial": trial, **settings, "mape": sum(known) / len(known) if known else None})
    schema = "trial int, n_estimators int, max_depth int, min_samples_leaf int, max_features string, bootstrap boolean, mape double"
    return rows.sparkSession.createDataFrame(results, schema)


def best_settings(trials: DataFrame) -> dict:
    row = best(trials, [], "mape", "trial").first().asDict()
    return {k: row[k] for k in DEFAULTS}


def fit_boosted(train: DataFrame, spec: SeriesSpec, n_lags: int = 10, seed: int = 42, rounds: int = 20, depth: int = 5) -> PipelineModel:
    """Boosted trees for the change to the previous row; ``train`` comes from :func:`lag_design`."""
    label = train.withColumn("_change", F.col(spec.value) - F.col("lag_1"))
    trees = GBTRegressor(
        featuresCol="_features", labelCol="_change", predictionCol="_scaled", maxIter=rounds, maxDepth=depth, seed=seed
    )
    return Pipeline(stages=[VectorAssembler(inputCols=lag_names(n_lags), outputCol="_features"), trees]).fit(label)


def predict_boosted(model: PipelineModel, rows: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Previous true value plus the expected change."""
    scored = model.transform(rows)
    change = scale.unscaled_difference("_scaled", spec.value)
    return scored.select(
        *spec.keys, spec.time, "pos", "n", "phase",
        scale.unscaled(spec.value, spec.value).alias("y_true"), (scale.unscaled("lag_1", spec.value) + change).alias("yhat"),
    )
