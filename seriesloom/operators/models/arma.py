"""Residuals and conditional least squares of autoregressive moving-average models.

The residual of a row depends on those before it: ``e = w - b'x`` where ``x`` holds
an intercept, earlier values of ``w`` and earlier residuals. This recursion and that
of its derivatives are linear in where they start. A series is therefore cut into
blocks of positions. Each block reports what it adds to its last residuals and how
these follow from the ones before it; a pass over the blocks of a series, not its
rows, gives every block its start. Then all blocks run at once and their matrices
are added up, one Gauss-Newton step for all series per pass.

Residuals before a series are 0. A row without a value or one of its lags has the
residual 0, no forecast, and counts nowhere.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.operators.gram import frame_of, packed, plain, solved, square, summed
from seriesloom.operators.keys import join_on
from seriesloom.operators.position import block_of
from seriesloom.session import cut_lineage
from seriesloom.spec import SeriesSpec

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 16_384  # positions of one block
MODEL = ["betas", "used"]


class Model:
    """Which columns a series uses, and its coefficients for them."""

    def __init__(self, names: list[str], used: list[int], betas: np.ndarray):
        chosen = [names[i] for i in used]
        self.used, self.beta = np.asarray(used, int), np.asarray(betas, float)[list(used)]
        self.values = [int(c[2:]) for c in chosen if c.startswith("w_")]
        self.value_at = [i for i, c in enumerate(chosen) if c.startswith("w_")]
        self.errors = [int(c[2:]) for c in chosen if c.startswith("e_")]
        self.error_at = [i for i, c in enumerate(chosen) if c.startswith("e_")]
        self.one_at = [i for i, c in enumerate(chosen) if c == "one"]
        self.theta = self.beta[self.error_at]
        self.reach = max(self.errors, default=0)


def follow(given: np.ndarray, known: np.ndarray, start: np.ndarray, model: Model) -> np.ndarray:
    """``out[t] = given[t] - sum(theta out[t - lag])`` where ``known``, else 0; ``start`` are the values before, oldest first.

    The first axis is time; any others run side by side.
    """
    if not model.errors:
        return np.where(known.reshape(-1, *[1] * (given.ndim - 1)), given, 0.0)
    reach, lags, theta = model.reach, model.errors, model.theta.tolist()
    if given.ndim == 1:  # plain floats are quicker than arrays of one
        out = [*start.tolist()]
        for t, (value, ok) in enumerate(zip(given.tolist(), known.tolist()), reach):
            if ok:
                for lag, c in zip(lags, theta):
                    value -= c * out[t - lag]
            out.append(value if ok else 0.0)
        return np.array(out[reach:])
    out = np.concatenate([start, np.zeros(given.shape)])
    for t in np.flatnonzero(known):
        value = given[t].copy()
        for lag, c in zip(lags, theta):
            value -= c * out[t + reach - lag]
        out[t + reach] = value
    return out[reach:]


def _lagged(series: np.ndarray, lags: list[int], reach: int, length: int) -> list[np.ndarray]:
    return [series[reach - lag : reach - lag + length] for lag in lags]


class Block:
    """The rows of one block with the values before it, as an unbroken run of positions."""

    def __init__(self, row: dict, names: list[str], block: int):
        self.model = Model(names, list(row["used"]), row["betas"])
        number, first, last = int(row["_block"]), int(row["_first"]), int(row["_last"])
        self.low, high = max(number * block, first), min((number + 1) * block, last + 1)
        before = max([*self.model.values, 0])
        pos, w = np.asarray(row["_pos"], np.int64), np.asarray(row["_w"], float)
        inside = (pos >= self.low - before) & (pos < high)
        whole = np.full(high - self.low + before, np.nan)
        whole[pos[inside] - self.low + before] = w[inside]
        self.n = high - self.low
        self.w = whole[before:]
        self.past = _lagged(whole, self.model.values, before, self.n)
        self.known = np.isfinite(self.w) & np.all([np.isfinite(p) for p in self.past] or [np.ones(self.n, bool)], axis=0)
        values = self.model.beta[self.model.value_at]
        expected = sum((c * p for c, p in zip(values, self.past)), np.zeros(self.n)) + self.model.beta[self.model.one_at].sum()
        self.rest = np.where(self.known, self.w - expected, 0.0)

    def errors(self, start: np.ndarray) -> np.ndarray:
        return follow(self.rest, self.known, start, self.model)

    def slopes(self, errors: np.ndarray, start: np.ndarray, start_slopes: np.ndarray) -> np.ndarray:
        """Derivatives of the residuals by the coefficients."""
        inputs = np.zeros((self.n, len(self.model.used)))
        inputs[:, self.model.one_at] = 1.0
        for i, past in zip(self.model.value_at, self.past):
            inputs[:, i] = np.where(self.known, past, 0.0)
        for i, past in zip(self.model.error_at, _lagged(np.concatenate([start, errors]), self.model.errors, self.model.reach, self.n)):
            inputs[:, i] = past
        return follow(-inputs, self.known, start_slopes, self.model)

    def passed_on(self) -> np.ndarray:
        """What the block adds to the last residuals and slopes, and what becomes of each of those before it, in one flat array."""
        reach, k = self.model.reach, len(self.model.used)
        zero, zero_slopes = np.zeros(reach), np.zeros((reach, k))

        def end(run: np.ndarray, start: np.ndarray) -> np.ndarray:
            return np.concatenate([start, run])[len(run) :]

        errors = self.errors(zero)
        slopes = self.slopes(errors, zero, zero_slopes)
        unit = np.eye(reach)
        own = follow(np.zeros((self.n, reach)), self.known, unit, self.model)
        inputs = np.zeros((self.n, k, reach))
        for i, past in zip(self.model.error_at, _lagged(np.concatenate([unit, own]), self.model.errors, reach, self.n)):
            inputs[:, i] = past
        cross = follow(-inputs, self.known, np.zeros((reach, k, reach)), self.model)
        parts = [end(errors, zero), end(slopes, zero_slopes), end(own, unit), end(cross, np.zeros((reach, k, reach)))]
        return np.concatenate([p.reshape(-1) for p in parts])


def _blocks(df: DataFrame, spec: SeriesSpec, before: int, block: int) -> DataFrame:
    """Positions and values of each block and of the ``before`` rows ahead of it, written for repeated use."""
    keys = list(spec.keys)
    rows = df.select(*keys, "pos", "w").where("w IS NOT NULL")
    ends = rows.groupBy(*keys).agg(F.min("pos").alias("_first"), F.max("pos").alias("_last"))
    copies = rows.withColumn("_block", F.explode(F.sequence(block_of(block), block_of(block, before))))
    pairs = F.array_sort(F.collect_list(F.struct("pos", "w")))
    held = copies.groupBy(*keys, "_block").agg(pairs.alias("_r")).select(*keys, "_block", F.col("_r.pos").alias("_pos"), F.col("_r.w").alias("_w"))
    return cut_lineage(join_on(held, ends, keys).where(F.col("_block") <= F.expr(f"_last div {block}")))


def _starts(blocks: DataFrame, keys: list[str], names: list[str], block: int) -> DataFrame:
    """Residuals and slopes before every block but the first of a series."""
    longer = blocks.where(F.expr(f"_last div {block} > _first div {block}"))
    fields = T.StructType([*[blocks.schema[k] for k in keys], T.StructField("_block", T.LongType()), T.StructField("_passed", T.ArrayType(T.DoubleType()))])

    def report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[[*keys, "_block"]].copy()
            out["_passed"] = [Block(row, names, block).passed_on() for row in batch.to_dict("records")]
            yield out

    reported = join_on(longer.mapInPandas(report, fields), blocks.select(*keys, "_block", "used"), [*keys, "_block"])
    out = T.StructType([*fields.fields[:-1], T.StructField("_start", T.ArrayType(T.DoubleType()))])

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        """One row per block of a series."""
        rows = rows.sort_values("_block")
        model = Model(names, list(rows["used"].iloc[0]), np.zeros(len(names)))
        reach, k = model.reach, len(model.used)
        errors, slopes, starts, last = np.zeros(reach), np.zeros((reach, k)), [], None
        for number, passed in zip(rows["_block"], rows["_passed"]):
            if last is not None and number != last + 1:  # a whole block without rows
                errors, slopes = np.zeros(reach), np.zeros((reach, k))
            starts.append(np.concatenate([errors, slopes.reshape(-1)]))
            v, s, a, c = np.split(np.asarray(passed), np.cumsum([reach, reach * k, reach * reach]))
            a, c = a.reshape(reach, reach), c.reshape(reach, k, reach)
            errors, slopes, last = v + a @ errors, s.reshape(reach, k) + a @ slopes + c @ errors, number
        result = rows[[*keys, "_block"]].copy()
        result["_start"] = starts
        return result[out.names]

    return reported.groupBy(*keys).applyInPandas(chain, out)


def _started(blocks: DataFrame, params: DataFrame, keys: list[str], names: list[str], block: int) -> DataFrame:
    """Blocks with the model of their series and where their residuals start."""
    ready = join_on(blocks, params.select(*keys, *MODEL), keys)
    return join_on(ready, _starts(ready, keys, names, block), [*keys, "_block"], "left")


def _start_of(row: dict, model: Model) -> tuple[np.ndarray, np.ndarray]:
    reach, k = model.reach, len(model.used)
    flat = np.zeros(reach * (k + 1)) if row["_start"] is None else np.asarray(row["_start"], float)
    return flat[:reach], flat[reach:].reshape(reach, k)


def expectations(df: DataFrame, params: DataFrame, spec: SeriesSpec, names: list[str], block: int = BLOCK) -> DataFrame:
    """keys, pos and ``expected``, the forecast of ``w`` from all rows before, of every row that has one."""
    keys = list(spec.keys)
    blocks = _blocks(df, spec, max(int(c[2:]) for c in [*names[1:], "w_0"]), block)
    fields = T.StructType([*[df.schema[k] for k in keys], T.StructField("pos", T.LongType()), T.StructField("expected", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                part = Block(row, names, block)
                errors = part.errors(_start_of(row, part.model)[0])
                at = np.flatnonzero(part.known)
                out = pd.DataFrame({"pos": part.low + at, "expected": part.w[at] - errors[at]})
                for k in keys:
                    out[k] = pd.Series([plain(row[k])] * len(at), dtype=object)
                yield out[fields.names]

    return _started(blocks, params, keys, names, block).mapInPandas(run, fields)


def refined(df: DataFrame, params: DataFrame, spec: SeriesSpec, names: list[str], steps: int = 8, block: int = BLOCK) -> DataFrame:
    """``params`` with coefficients of least squared residuals, ``rss``, ``n`` and ``criterion``.

    Needs ``used`` (the places in ``names`` a series uses), ``betas`` and
    ``small_sample``. A step that does not lower the sum of squares is halved, so the
    result is never worse than the start.
    """
    keys = list(spec.keys)
    blocks = _blocks(df, spec, max(int(c[2:]) for c in [*names[1:], "w_0"]), block)
    rows = T.StructType([*[df.schema[k] for k in keys], T.StructField("n", T.LongType()), T.StructField("cells", T.ArrayType(T.DoubleType()))])

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held: dict = {}
            for row in batch.to_dict("records"):
                part = Block(row, names, block)
                start, start_slopes = _start_of(row, part.model)
                errors = part.errors(start)
                x = np.column_stack([part.slopes(errors, start, start_slopes), errors])[part.known]
                key = tuple(plain(row[k]) for k in keys)
                n, cells = held.get(key, (0, 0.0))
                held[key] = (n + len(x), cells + (x.T @ x)[np.triu_indices(x.shape[1])])
            if held:
                yield packed(held, keys)

    extra = "tried array<double>, best double, size long, done boolean"
    state = cut_lineage(params.withColumns({"tried": F.col("betas"), "best": F.lit(None).cast("double"), "size": F.lit(0).cast("long"), "done": F.lit(False)}))
    fields = T.StructType([*[params.schema[k] for k in keys], *T.StructType.fromDDL("betas array<double>, " + extra).fields])

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                used, betas, tried = np.asarray(row["used"], int), np.array(row["betas"], float), np.array(row["tried"], float)
                g = square(row["cells"], len(used) + 1)
                best, done = row["best"], False
                if best is None or best != best or g[-1, -1] < best:
                    done = best is not None and best == best and g[-1, -1] > best * (1 - 1e-10)
                    betas, best = tried, float(g[-1, -1])
                    tried = betas.copy()
                    if len(used):
                        tried[used] -= solved(g[:-1, :-1], g[:-1, -1])
                    done = done or not len(used) or not np.isfinite(tried).all()
                else:
                    tried = (betas + tried) / 2
                out.append({**{k: row[k] for k in keys}, "betas": betas, "tried": tried, "best": best, "size": int(row["n"]), "done": done})
            yield frame_of(out, fields.names, keys)

    for _ in range(steps + 1):
        now = state.where("NOT done")
        if now.isEmpty():
            break
        ready = _started(blocks, now.drop("betas").withColumnRenamed("tried", "betas"), keys, names, block)
        sums = summed(ready.mapInPandas(products, rows), keys)
        moved = join_on(now.select(*keys, *MODEL, "tried", "best"), sums, keys).mapInPandas(step, fields)
        fresh = join_on(now.drop(*fields.names[len(keys) :]), moved, keys).select(*state.columns)
        # A series without a usable row leaves the search as it came.
        state = cut_lineage(state.where("done").unionByName(fresh))
    k, n, best = F.size("used"), F.col("size"), F.col("best")
    aic = n * F.log(F.greatest(best, F.lit(1e-300)) / n) + 2 * k
    small = aic + 2 * k * (k + 1) / (n - k - 1)
    criterion = F.when(n - k - 1 > 0, F.when(F.col("small_sample"), small).otherwise(aic)).otherwise(F.lit(float("inf")))
    done = state.withColumns({"criterion": criterion, "rss": best, "n": n})
    return cut_lineage(done.drop("tried", "best", "size", "done", "small_sample"))
