"""Forecasters by name, all with the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.operators import features, scale
from seriesloom.operators.keys import join_on
from seriesloom.operators.models import ar, delta, forest, horizon, trend
from seriesloom.operators.models.naive import naive_forecast
from seriesloom.operators.post import calibrate_bias, calibrate_spread
from seriesloom.operators.quality import eligibility
from seriesloom.operators.split import phase_from_head
from seriesloom.session import cut_lineage
from seriesloom.spec import SeriesSpec

Result = tuple[DataFrame, DataFrame | None]


def _naive(df: DataFrame, spec: SeriesSpec) -> Result:
    return naive_forecast(df, spec, F.col("phase")), None


def _untransformed(out: DataFrame, powers: DataFrame, keys: list[str]) -> DataFrame:
    """Truth and forecast in the units of the series."""
    missed = F.col("y_true") - F.col("yhat")
    variance = out.where(F.col("phase") == "val").groupBy(*keys).agg(F.coalesce(F.var_pop(missed), F.lit(0.0)).alias("_v"))
    rows = join_on(join_on(out, powers, keys), cut_lineage(variance), keys, "left")
    power, v = F.col("power"), F.coalesce("_v", F.lit(0.0))
    back = {"y_true": features.inverse_box_cox(F.col("y_true"), power), "yhat": features.inverse_box_cox(F.col("yhat"), power, v)}
    return rows.withColumns({c: F.when(power.isNull(), F.col(c)).otherwise(x) for c, x in back.items()}).drop("power", "_v")


def _arima(
    df: DataFrame, spec: SeriesSpec, mode: str = "rolling", calibrate: bool = True, season: int = 7, box_cox: bool = False, **settings
) -> Result:
    """``rolling`` searches the orders again while it goes, ``smart`` once, on the training rows; ``plain`` is an autoregression.

    With ``box_cox`` each positive series is transformed by the likeliest power of its
    training rows; forecasts go back as means, with the variance of the validation
    errors.
    """
    keys = list(spec.keys)
    powers = None
    if box_cox:
        powers = features.refined_box_cox_power(df.where(F.col("phase") == "train"), spec).select(*keys, "power")
        # A later value that is not positive has no transform.
        value = F.when(F.col("power").isNull(), F.col(spec.value)).when(F.col(spec.value) > 0, features.box_cox(F.col(spec.value), F.col("power")))
        df = join_on(df, powers, keys).withColumn(spec.value, value).drop("power")
    if mode not in ("rolling", "smart", "plain"):
        raise ValueError(f"unknown mode {mode!r}")
    scaler = scale.fit_scaler(df, spec, [spec.value])
    moved = scale.scale(df, scaler, spec, [spec.value])
    train = moved.where(F.col("phase") == "train")
    params = None
    if mode == "plain":
        params = ar.fit_plain(train, spec, **settings)
        scored = ar.one_step(moved, params, spec, **settings)
    elif mode == "smart":
        params = ar.fit_smart(train, spec, season, **settings)
        scored = ar.one_step_smart(moved, params, spec, season, **settings)
    else:
        made = cut_lineage(ar.rolling_search(moved, spec, season, **settings))
        chosen = ["refit_pos", "p", "q", "sp", "sq", "criterion", "fallback"]
        params = made.select(*keys, *chosen).distinct()
        scored = made.drop(*chosen).withColumnRenamed("y_true", spec.value)
    target = scaler.select(*keys, *scale.parameter_columns([spec.value]))
    scored = scored.withColumnRenamed(spec.value, "y_true")
    out = join_on(scored, target, keys).withColumns({c: scale.unscaled(c, spec.value) for c in ("y_true", "yhat")})
    out = out.select(*keys, spec.time, "pos", "n", "phase", "y_true", "yhat")
    if powers is not None:
        out = _untransformed(cut_lineage(out), powers, keys)
    if calibrate:
        out = calibrate_spread(calibrate_bias(out, spec, season).drop("bias"), spec, season).drop("ratio")
    return out, join_on(params, target, keys)


def _trend(df: DataFrame, spec: SeriesSpec, n_changepoints: int = 25, seasonalities: tuple[str, ...] = ("yearly",), **settings) -> Result:
    shape = trend.Shape(n_changepoints, seasonalities)
    params = trend.fit_trend(df, spec, shape, **settings)
    out = trend.predict_trend(df, params, spec, shape).withColumnRenamed(spec.value, "y_true")
    return out, params


def _forest(df: DataFrame, spec: SeriesSpec, n_lags: int = 10, seed: int = 42, trials: int = 0, space: dict | None = None, **settings) -> Result:
    rows = cut_lineage(forest.lag_design(df, spec, n_lags))
    train = rows.where(F.col("phase") == "train")
    tried = None
    if trials:
        tried = forest.search_forest(train, spec, trials, n_lags=n_lags, seed=seed, space=space or forest.SPACE)
        settings = forest.best_settings(tried) | settings
    model = forest.fit_forest(train, spec, n_lags, seed, **settings)
    return forest.smoothed_forest(model, rows.where(F.col("phase") != "train"), spec), tried


def _delta(df: DataFrame, spec: SeriesSpec, seq_len: int = 10, **settings) -> Result:
    params = delta.fit_delta(df, spec, seq_len, **settings)
    return delta.predict_delta(df, params, spec, seq_len), params


def _horizon(df: DataFrame, spec: SeriesSpec, seq_len: int = 96, pred_len: int = 24, **settings) -> Result:
    params = horizon.fit_horizon(df, spec, seq_len, pred_len, **settings)
    merged = horizon.segment_forecast(df, params, spec, seq_len, pred_len)
    places = df.select(*spec.keys, spec.time, "pos", "n", "phase")
    return join_on(merged, places, [*spec.keys, spec.time]), params


MODELS: dict[str, Callable[..., Result]] = {
    "naive": _naive, "arima": _arima, "prophet": _trend, "randomforest": _forest, "lstm": _delta, "informer": _horizon,
}


def shortfall(df: DataFrame, spec: SeriesSpec, model: str, seq_len: int | None = None, pred_len: int = 24, **_) -> DataFrame:
    """Per series its counts and ``reason``: why the model takes it not, NULL if it does.

    The rules are those of :func:`seriesloom.operators.quality.eligibility`.
    """
    window = seq_len or {"lstm": 10, "informer": 96}.get(model, 10)
    table = eligibility(df, spec, window, window // 2, pred_len, window, 1)
    rule = {"prophet": "eligible_trend", "arima": "eligible_autoregression", "informer": "eligible_horizon", "lstm": "eligible_windows"}.get(model)
    enough = F.col(rule) if rule else F.lit(True)
    too_few = F.concat(F.lit(f"too few rows for {model}: "), F.col("n_finite"), F.lit(" usable of "), F.col("n_rows"))
    if model in ("arima", "randomforest"):  # few rows leave nothing to compare orders or splits on
        enough = enough & ~F.col("few_rows")
    return table.select(*spec.keys, "n_rows", "n_finite", F.when(~enough, too_few).alias("reason"))


def forecast(df: DataFrame, spec: SeriesSpec, model: str, stored: bool = False, **settings) -> Result:
    """Fit the named model on the training phase and forecast validation and test.

    Needs ``pos`` and ``n``; a frame without ``phase`` gets 60/20/20. The rows are
    read several times, so they are written to a table first unless ``stored``
    says that they come from one. Series that :func:`shortfall` gives a reason
    for get no forecast. Returns the forecast rows and the parameter (or trial)
    table.
    """
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}, known are {sorted(MODELS)}")
    phased = df if "phase" in df.columns else df.withColumn("phase", phase_from_head())
    phased = phased if stored else cut_lineage(phased)
    taken = cut_lineage(shortfall(phased, spec, model, **settings).where("reason IS NULL").select(*spec.keys))
    rows, params = MODELS[model](join_on(phased, taken, spec.keys), spec, **settings)
    evaluated = rows.where(F.col("phase") != "train")
    return evaluated.select(*spec.keys, spec.time, "pos", "phase", "y_true", "yhat").withColumn("model", F.lit(model)), params
