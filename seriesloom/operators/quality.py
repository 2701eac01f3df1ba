"""Per-series facts: eligibility, audits, profiles, sampling step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.columns import finite
from seriesloom.operators.position import over_blocks
from seriesloom.spec import SeriesSpec

# Fewest rows a model accepts.
TREND_ROWS, AUTOREGRESSION_ROWS, FEW_ROWS = 30, 5, 10


def eligibility(
    df: DataFrame, spec: SeriesSpec, seq_len: int = 96, label_len: int = 48, pred_len: int = 24,
    input_steps: int = 60, output_steps: int = 1,
) -> DataFrame:
    """One row per series with its counts and which models it is long and clean enough for."""
    usable = F.count(finite(spec.value))
    counts = df.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("n_rows"), usable.alias("n_finite"))
    n, ok = F.col("n_rows"), F.col("n_finite")
    return counts.withColumns(
        {
            "n_unusable": n - ok,
            "few_rows": ok < FEW_ROWS,
            "eligible_trend": (n == ok) & (n >= TREND_ROWS),
            "eligible_autoregression": ok >= AUTOREGRESSION_ROWS,
            "eligible_horizon": n >= seq_len + label_len + pred_len,
            "eligible_windows": n >= input_steps + output_steps,
        }
    )


def nonfinite_audit(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """How many NULL, NaN and infinite values each column has, one row per column."""

    def count_in(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.struct(
            F.lit(c).alias("column"),
            F.count_if(x.isNull()).alias("n_null"),
            F.count_if(F.isnan(x)).alias("n_nan"),
            F.count_if(F.abs(x) == float("inf")).alias("n_inf"),
        )

    audit = F.array(*[count_in(c) for c in columns])
    counted = df.groupBy(*(keys or [])).agg(audit.alias("_audit"))
    return counted.select(*(keys or []), F.inline("_audit"))


def require_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """The same rows; the job fails on the first NaN or infinite value."""
    bad = [F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(c)) for c in columns]
    checked = F.coalesce(*bad)
    return df.where(F.when(checked.isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not finite: "), checked)).isNull()))


def profile(df: DataFrame, spec: SeriesSpec, k: int = 3) -> DataFrame:
    """Rows, extremes, mean and the first and last ``k`` values; needs ``pos`` and ``n``."""

    def edge(inside: Column) -> Column:
        # At most k rows per series pass the condition, so the list is bounded.
        kept = F.collect_list(F.when(inside, F.struct("pos", spec.value)))
        return F.array_sort(kept)[spec.value]

    return df.groupBy(*spec.keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(spec.value).alias("min_value"),
        F.max(spec.value).alias("max_value"),
        F.avg(spec.value).alias("mean_value"),
        edge(F.col("pos") < k).alias("head"),
        edge(F.col("pos") >= F.col("n") - k).alias("tail"),
    )


def sampling_step(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Seconds between rows: the common step of a regular series, and the most frequent one.

    Needs ``pos``; among equally frequent steps the shortest is reported.
    """
    gap = F.unix_micros(F.col(spec.time).cast("timestamp")) - F.unix_micros(
        F.col("_earlier").cast("timestamp")
    )
    gaps = over_blocks(
        df.select(*spec.keys, spec.time, "pos"),
        spec,
        lambda w: {"_earlier": F.lag(spec.time).over(w)},
        before=1,
    ).withColumn("_gap", gap / F.lit(1_000_000.0))
    counted = gaps.groupBy(*spec.keys, "_gap").agg(F.count(F.lit(1)).alias("_times"))
    regular = (F.min("_gap") == F.max("_gap")) & (F.sum("_times") >= 3)
    ranked = F.when(F.col("_gap").isNotNull(), F.struct(F.col("_times"), -F.col("_gap")))
    return counted.groupBy(*spec.keys).agg(
        F.sum("_times").alias("n_rows"),
        F.when(regular, F.min("_gap")).alias("regular_step"),
        F.max_by("_gap", ranked).alias("modal_step"),
    )
