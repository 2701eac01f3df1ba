"""Mix sources to target weights by exact document lengths.

Each source gets a target number of words. Whole copies of the source go in
first; what remains is a subset-sum problem over the histogram of exact document
lengths: every length gives its proportional share, fractions of documents go to
the next shorter length, and bounded-knapsack dynamic programming fits the last
words exactly. So the mix has the length distribution of its source. Which documents of a length are taken depends on a
seeded hash of ``doc_id`` alone.

Defined results: a NULL text has no words; a document without words takes none;
a NULL source is a source of its own, last in order; repeated rows are rows of
their own; an empty table gives an empty mix; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
SEED = 20_240_601
DP_WORDS = 4_096  # words left to the knapsack, or those of DP_DOCS documents
DP_DOCS, DP_MOST = 8, 64  # such documents go back only up to DP_MOST times DP_WORDS
HASH_BITS = 10  # documents of one length are ranked in so many groups of hashes


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """Per source: source_size and target. Shares above ``most`` times the source go back to the others by weight.

    Repeated resharing ends where all sources below their limit have the same
    target per weight. Sources ordered by limit per weight reach their limits one
    after the other, so running sums over that order give this level directly.
    """
    total = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    by_name, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    order = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = total.withColumn("_w", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    rows = rows.withColumn("_most", F.col("source_size") * F.lit(float(most))).withColumn("_ratio", F.col("_most") / F.col("_w"))
    rows = rows.withColumns(
        {
            "_sum": F.sum("source_size").over(everything) * F.lit(float(share)),
            "_filled": F.coalesce(F.sum("_most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "_open": F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    rows = rows.withColumn("_full", F.col("_filled") + F.col("_ratio") * F.col("_open") <= F.col("_sum"))
    rows = rows.withColumns(
        {
            "_rest": F.max("_sum").over(everything) - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_most"))).over(everything), F.lit(0.0)),
            "_free": F.sum(F.when(~F.col("_full"), F.col("_w"))).over(everything),
        }
    )
    target = F.when(F.col("_full"), F.col("_most")).otherwise(F.col("_w") * F.col("_rest") / F.col("_free"))
    return rows.select("source", "source_size", target.alias("target"))


def shares(lengths: np.ndarray, counts: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole documents of each length in proportion, and the further ones that its fractions make.

    The words of a fraction go on to the next shorter length, so that for every
    length the words taken from documents at least that long are proportional but
    for less than one document.
    """
    total = int((lengths * counts).sum())
    whole = np.array([int(n) * budget // total for n in counts], np.int64)
    more, carried = np.zeros(len(lengths), np.int64), 0  # carried words times total
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        if size:
            carried += (int(counts[i]) * budget - int(whole[i]) * total) * size
            more[i] = min(carried // (size * total), int(counts[i] - whole[i]))
            carried -= int(more[i]) * size * total
    return whole, more


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, dp_words: int = DP_WORDS, seed: int = SEED) -> np.ndarray:
    """How many documents of each length to take so that their words come nearest ``budget``.

    Some ``dp_words`` words of the proportional choice are handed back, in a seeded
    order of the lengths, and fitted anew without a preference for a length: bit
    ``s`` of ``reach`` says that some choice of further documents has ``s`` words.
    """
    total = int((lengths * counts).sum())
    if budget <= 0 or total <= 0:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts.astype(np.int64)
    whole, more = shares(lengths, counts, budget)
    take = whole + more
    rest = budget - int((take * lengths).sum())
    order = np.random.default_rng(seed).permutation(np.flatnonzero(lengths > 0))
    handed = 0
    for i in order:
        room = dp_words if handed >= DP_DOCS else DP_MOST * dp_words
        back = min(int(more[i]), max(room - rest, 0) // int(lengths[i]))
        take[i] -= back
        rest += back * int(lengths[i])
        handed += back
    top = min(rest + int(lengths.max()), 2 * rest)
    mask = (1 << (top + 1)) - 1
    reach, items, parent = 1, [], np.full(top + 1, -1, np.int32)
    # One document of each length first, then doubling numbers of those that are left.
    choices = [(i, 1) for i in order if counts[i] > take[i]]
    for i in order:
        left, step = int(counts[i] - take[i]) - 1, 1
        while left > 0:
            choices.append((i, min(step, left)))
            left, step = left - step, step * 2
    for i, copies in choices:
        words = copies * int(lengths[i])
        if reach >> rest & 1:
            break
        if words > top:
            continue
        new = (reach << words) & mask & ~reach
        if new:
            bits = np.frombuffer(new.to_bytes(top // 8 + 1, "little"), np.uint8)
            parent[np.flatnonzero(np.unpackbits(bits, bitorder="little")[: top + 1])] = len(items)
            items.append((i, copies, words))
            reach |= new
    sums = np.flatnonzero(np.unpackbits(np.frombuffer(reach.to_bytes(top // 8 + 1, "little"), np.uint8), bitorder="little")[: top + 1])
    at = int(sums[np.argmin(np.abs(sums - rest))])
    while at:
        i, copies, words = items[parent[at]]
        take[i] += copies
        at -= words
    return take


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    total, target = int((rows["size"] * rows["n"]).sum()), float(rows["target"].iloc[0])
    whole = int(target // total) if total else 0
    budget = int(round(target - whole * total)) if total else 0
    rows = rows.sort_values("size")
    picked = fit_counts(rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), budget)
    return rows.assign(whole=whole, picked=picked)


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken (copies * size).

    Only (doc_id, source, size) leaves the first scan. The histogram, not the
    documents, is grouped by source: one row per distinct length.
    """
    sizes = cut_lineage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    seeded = F.xxhash64(F.lit(seed), "doc_id")
    rows = sizes.withColumns({"_hash": seeded, "_group": F.shiftrightunsigned(seeded, 64 - HASH_BITS).cast("int")})
    groups = rows.groupBy("source", "size", "_group").agg(F.count(F.lit(1)).alias("_n"))
    histogram = groups.groupBy("source", "size").agg(F.sum("_n").alias("n"))
    targets = cut_lineage(source_targets(sizes, weights, share, most))
    wide = histogram.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    fitted = wide.groupBy("source").applyInPandas(
        _fit_source, "source string, size long, n long, source_size long, target double, whole long, picked long"
    )
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("source", "size").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = groups.withColumn("_before", before)
    plan = fitted.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "source_size", "target", "whole", "picked")
    plan = start.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")))
    plan = cut_lineage(plan.select("_s", "_z", F.col("_group").alias("_g"), "_before", "source_size", "target", "whole", "picked"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "_group").orderBy("_hash", "doc_id"))
    ranked = rows.withColumn("_rank", rank)
    out = ranked.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("_group") == F.col("_g")))
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("whole") + (F.col("_before") + F.col("_rank") <= F.col("picked")).cast("bigint")).cast("bigint")
    out = out.withColumn("copies", copies)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
