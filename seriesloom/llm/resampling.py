"""Quality classifier by importance resampling.

Two generative models of hashed n-grams, one of target text (documents labelled
as good) and one of all raw text, give every document the log of its likelihood
ratio. Documents are then drawn without replacement in proportion to that ratio,
tempered to LENGTH n-grams so that long texts do not magnify small differences: a
Gumbel variate hashed from the document id is added to the log, and the k largest
sums are kept.

N-grams are tokens (runs of word bytes or of punctuation), pairs of tokens, and
pairs of token shapes with a mark for a repeated token; shapes carry what rare
tokens have in common. A token that repeats the one before it counts as a repeat of
its shape, not as the token: a text that says one common word over and over is as
unlike the target as its repeats are.

The raw model counts every document. The target model may be fitted on a bounded
sample of labelled rows (TARGET_ROWS, smallest hashes of the id); their ids are
all that is sent to the tasks besides the models, which have BUCKETS cells.

Defined results: a NULL or empty text, or one without tokens, has no likelihood
and is never drawn; sums equal to the smallest drawn one are all drawn; repeated
rows have equal sums; without target documents the ratio is 0 for all; a document
labelled twice counts once; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.hashing import U64, prefix_sums, scramble, window_hashes
from seriesloom.llm.tables import batch_of, buffer_of, give_back, slices
from seriesloom.session import cut_lineage

BUCKETS = 1 << 14
SMOOTHING = 3  # pseudo-counts per bucket, spread as the raw model
TARGET_ROWS = 20_000
SEED = 7_919
LENGTH = 100  # n-grams a text counts for when drawn
MARGIN = 0.1  # nats per n-gram below the raw model that a fitting text may be
SLICE = 1 << 19  # bytes of text worked on at once
BINS = 1_000  # cells of each step that narrows down the k-th largest sum
CELL = 1 << 10  # buckets in one row while counts are added up

# Classes of bytes: 0 white space, 1 word, 2 other.
KIND = np.full(256, 2, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = 0
KIND[48:58] = KIND[65:91] = KIND[97:123] = KIND[128:] = 1


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text index of every n-gram of the texts in a buffer."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kind = KIND[data]
    change = np.ones(len(data), bool)
    change[1:] = kind[1:] != kind[:-1]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    change |= first[:-1]
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], len(data))
    solid = kind[starts] > 0
    starts, ends = starts[solid], ends[solid]
    owner = np.searchsorted(offsets, starts, "right") - 1
    token = window_hashes(prefix_sums(data), starts, ends)
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    digit = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    capitals, digits, length = upper[ends] - upper[starts], digit[ends] - digit[starts], ends - starts
    shape = np.where(capitals == 0, 1, np.where((capitals == 1) & (length > 1), 2, np.where(2 * capitals > length, 3, 4)))
    shape = np.where(digits > 0, np.where(digits == length, 5, 6), shape)
    shape = np.where(kind[starts] == 2, 16 + data[starts].astype(np.int64) * 4 + np.minimum(length, 3), shape)
    together = owner[1:] == owner[:-1]
    pair = scramble(token[:-1] * U64(3) + token[1:], 2)[together]
    repeated = token[1:] == token[:-1]
    shapes = scramble((shape[:-1] * 4096 + shape[1:] * 2 + repeated).astype(U64), 3)[together]
    single = token.copy()
    single[1:] = np.where(repeated & together, scramble(shape[1:].astype(U64), 5), token[1:])
    bucket = np.concatenate([single, pair, shapes]) & U64(BUCKETS - 1)
    return bucket.astype(np.int64), np.concatenate([owner, owner[1:][together], owner[1:][together]])


COUNT_ROWS = pa.schema([("cell", pa.int32()), ("raw", pa.list_(pa.float64())), ("target", pa.list_(pa.float64()))])


def _count(target_ids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                bucket, owner = ngrams(*buffer_of(part.column("text")))
                raw += np.bincount(bucket, minlength=BUCKETS)
                chosen = is_target(part.column("doc_id"), target_ids)
                if chosen.any():
                    target += np.bincount(bucket[chosen[owner]], minlength=BUCKETS)
            give_back()
        cells = BUCKETS // CELL
        yield batch_of(COUNT_ROWS, np.arange(cells, dtype=np.int32), list(raw.reshape(cells, -1)), list(target.reshape(cells, -1)))

    return run


def _add(cell: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"cell": cell["cell"].iloc[:1], "raw": [np.sum(list(cell["raw"]), 0)], "target": [np.sum(list(cell["target"]), 0)]})


class Models(NamedTuple):
    """N-gram counts per bucket and the ids of the target documents."""

    raw: np.ndarray
    target: np.ndarray
    ids: np.ndarray


def fit_models(docs: DataFrame, labels: DataFrame, target_rows: int = TARGET_ROWS) -> Models:
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    chosen = good.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(target_rows).collect()
    ids = np.array([r[0] for r in chosen], np.int64)
    counted = docs.select("doc_id", "text").mapInArrow(_count(ids), "cell int, raw array<double>, target array<double>")
    cells = counted.groupBy("cell").applyInPandas(_add, "cell int, raw array<double>, target array<double>").orderBy("cell").collect()
    if not cells:
        return Models(np.zeros(BUCKETS), np.zeros(BUCKETS), ids)
    return Models(np.concatenate([np.array(r[1]) for r in cells]), np.concatenate([np.array(r[2]) for r in cells]), ids)


def is_target(doc_id: pa.Array, ids: np.ndarray) -> np.ndarray:
    known = doc_id.is_valid().to_numpy(zero_copy_only=False)
    return known & np.isin(doc_id.fill_null(0).to_numpy(zero_copy_only=False), ids)


def log_ratio(doc_id: Column, text: Column, models: Models) -> Column:
    """The mean of log p_target - log p_raw over the n-grams of a text, each model without the text's own counts; NULL without tokens.

    Leaving out its own counts keeps a text from looking unlike the target only
    because the raw model has seen it. The target is smoothed towards the raw
    model, so n-grams that are rare in both say little.
    """
    raw, target, ids = models
    raw_sum, target_sum, weight = raw.sum(), target.sum(), float(SMOOTHING * BUCKETS)

    def of_slice(part: pa.RecordBatch) -> pa.Array:
        bucket, owner = ngrams(*buffer_of(part.column("text")))
        cells, own = np.unique(owner * BUCKETS + bucket, return_counts=True)
        owner, bucket = cells // BUCKETS, cells % BUCKETS
        n = np.bincount(owner, weights=own, minlength=part.num_rows)
        inside = is_target(part.column("doc_id"), ids)[owner]
        background = (np.maximum(raw[bucket] - own, 0) + 1) / (np.maximum(raw_sum - n[owner], 0) + BUCKETS)
        good = np.maximum(target[bucket] - own * inside, 0) + weight * background
        ratio = np.log(good / (np.maximum(target_sum - n[owner] * inside, 0) + weight) / background)
        if not target_sum:
            ratio[:] = 0
        return pa.array(np.bincount(owner, weights=own * ratio, minlength=part.num_rows) / np.maximum(n, 1), pa.float64(), mask=n == 0)

    @F.arrow_udf("double")
    def score(doc_id: pa.Array, text: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([doc_id, text], ["doc_id", "text"])
        out = [of_slice(part) for part in slices(batch, "text", SLICE)]
        give_back()
        return pa.concat_arrays(out) if out else pa.array([], pa.float64())

    return score(doc_id, text)


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """A standard Gumbel variate fixed by the id."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(-F.log(uniform))


def draw_key(mean_ratio: Column, doc_id: Column) -> Column:
    return mean_ratio * F.lit(float(LENGTH)) + gumbel(doc_id)


def kth_largest(values: DataFrame, k: int) -> float:
    """The k-th largest ``key``: histograms over ever smaller ranges, BINS counts at a time."""
    low, high, above = *values.agg(F.min("key"), F.max("key")).first(), 0
    while low < high:
        width = (high - low) / BINS
        cell = F.least(F.floor((F.col("key") - F.lit(low)) / F.lit(width)), F.lit(BINS - 1))
        inside = values.filter(F.col("key").between(low, high))
        counts = sorted(inside.groupBy(cell.alias("c")).agg(F.count(F.lit(1)), F.min("key"), F.max("key")).collect(), reverse=True)
        for _, n, least, most in counts:
            if above + n >= k:
                low, high = least, most
                break
            above += n
    return high


def drawn(docs: DataFrame, labels: DataFrame, k: int | None = None) -> tuple[DataFrame, Models, float]:
    """The drawn documents (doc_id, log_ratio, key), the models and the smallest drawn key.

    Without ``k`` as many are drawn as there are documents that fit the target
    model no worse than the raw one, but for MARGIN.
    """
    models = fit_models(docs, labels)
    scored = docs.select("doc_id", log_ratio(F.col("doc_id"), F.col("text"), models).alias("log_ratio")).filter("log_ratio IS NOT NULL")
    scored = cut_lineage(scored.withColumn("key", draw_key(F.col("log_ratio"), F.col("doc_id"))))
    n, fitting = scored.agg(F.count(F.lit(1)), F.count_if(F.col("log_ratio") >= F.lit(-MARGIN))).first()
    k = min(n, fitting if k is None else k)
    least = kth_largest(scored, k) if k else float("inf")
    return scored.filter(F.col("key") >= least), models, least


def keep_drawn(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """The rows of ``docs`` that are drawn, with their own columns.

    Scores are computed again beside the rows, so no text is shuffled.
    """
    _, models, least = drawn(docs, labels, k)
    key = draw_key(log_ratio(F.col("doc_id"), F.col("text"), models), F.col("doc_id"))
    return docs.filter(F.coalesce(key >= F.lit(least), F.lit(False)))
