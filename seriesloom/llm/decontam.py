"""Benchmark decontamination by latent semantic retrieval.

Words weigh by the inverse frequency of passages that hold them, over all
documents. A randomised SVD of the benchmark's TF-IDF matrix, its products summed
over tasks, spans a latent space of RANK dimensions. Every document is read in
overlapping passages of PASSAGE words; a passage whose weight lies mostly outside
the benchmark's words cannot come near an item and is left there, the others are
projected and compared with all items by cosine. Candidates are then decided on
words: the longest common subsequence of the item and the passage with its
surroundings must hold most of the item, and of its answer, the rarest third of its
words, at least half must be there. Inserted, dropped or exchanged words only
shorten the subsequence.

The benchmark is searched in blocks of ITEMS items, so what is sent to the tasks is
bounded; every block meets every document.

Defined results: NULL and empty texts match nothing; an item without words matches
nothing; equal items each match; words are runs of letters and digits, ASCII letters
lower-cased; repeated rows have equal results; other columns are kept as they are by
``decontaminate``; empty tables give no matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm.hashing import U64, lower_ascii, prefix_sums, window_hashes
from seriesloom.llm.resampling import KIND
from seriesloom.llm.tables import batch_of, buffer_of, give_back, slices

BUCKETS = 1 << 18
CELL = 1 << 12
RANK, OVERSAMPLE, POWER_STEPS = 128, 16, 2
PASSAGE, STRIDE = 32, 16  # words
COSINE = 0.4  # in the latent space
COMMON = 0.6  # of the item's words in the longest common subsequence
ANSWER = 0.5  # of the item's rarest third
SLICE = 1 << 19  # bytes of text worked on at once
ITEMS = 20_000


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the texts and where each text's begin."""
    texts = len(offsets) - 1
    if not len(data):
        return np.empty(0, U64), np.zeros(texts + 1, np.int64)
    data = lower_ascii(data)
    inside = KIND[data] == 1
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    end[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return window_hashes(prefix_sums(data), starts, ends), np.searchsorted(starts, offsets)


def bucket_of(word: np.ndarray) -> np.ndarray:
    return (word & U64(BUCKETS - 1)).astype(np.int64)


COUNTS = pa.schema([("cell", pa.int32()), ("n", pa.list_(pa.float64()))])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, passages = np.zeros(BUCKETS), 0
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            word, first = tokens(*buffer_of(part.column("text")))
            n = np.diff(first)
            pieces = -(-n // PASSAGE)
            before = np.cumsum(pieces) - pieces
            owner = np.repeat(np.arange(len(n)), n)
            piece = before[owner] + (np.arange(len(word)) - first[owner]) // PASSAGE
            once = np.unique(piece * BUCKETS + bucket_of(word))
            counts += np.bincount(once % BUCKETS, minlength=BUCKETS)
            passages += int(pieces.sum())
        give_back()
    cells = BUCKETS // CELL
    yield batch_of(COUNTS, np.arange(cells + 1, dtype=np.int32), [*counts.reshape(cells, CELL), np.array([float(passages)])])


def _add_lists(name: str):
    def add(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cell": frame["cell"].iloc[:1], name: [np.sum(list(frame[name]), 0)]})

    return add


def word_weights(docs: DataFrame) -> np.ndarray:
    """log(passages / passages with the bucket), over all documents; positive for every word."""
    counted = docs.select("text").mapInArrow(_frequencies, "cell int, n array<double>")
    cells = counted.groupBy("cell").applyInPandas(_add_lists("n"), "cell int, n array<double>").orderBy("cell").collect()
    if not cells:
        return np.ones(BUCKETS, np.float32)
    counts, passages = np.concatenate([np.array(r[1]) for r in cells[:-1]]), cells[-1][1][0]
    return np.log((passages + 1) / (counts + 0.5)).clip(0.01).astype(np.float32)


def _product(weights: np.ndarray, place: np.ndarray, basis: np.ndarray):
    """Each task's share of A^T (A basis), A being the TF-IDF rows of its items."""
    schema = pa.schema([("cell", pa.int32()), ("row", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(basis.shape)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                word, first = tokens(*buffer_of(part.column("text")))
                if not len(word):
                    continue
                bucket = bucket_of(word)
                at, value = place[bucket], weights[bucket].astype(np.float64)
                owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
                norm = np.sqrt(np.bincount(owner, weights=value**2, minlength=len(first) - 1))
                value /= np.maximum(norm, 1e-9)[owner]
                rows = np.zeros((len(first) - 1, basis.shape[1]))
                np.add.at(rows, owner, basis[at] * value[:, None])
                np.add.at(total, at, rows[owner] * value[:, None])
            give_back()
        used = np.flatnonzero(np.abs(total).sum(1))
        yield batch_of(schema, used.astype(np.int32), list(total[used]))

    return run


def latent_basis(items: DataFrame, weights: np.ndarray, place: np.ndarray, rank: int = RANK) -> np.ndarray:
    """The leading right singular vectors of the benchmark's TF-IDF matrix, one row per bucket in use."""
    size = int(place.max()) + 1
    width = min(rank + OVERSAMPLE, size)
    basis = np.random.default_rng(7).standard_normal((size, width))

    def multiply(basis: np.ndarray) -> np.ndarray:
        made = items.select("text").mapInArrow(_product(weights, place, basis), "cell int, row array<double>")
        rows = made.groupBy("cell").applyInPandas(_add_lists("row"), "cell int, row array<double>").collect()
        out = np.zeros(basis.shape)
        for cell, row in rows:
            out[cell] = row
        return out

    for _ in range(POWER_STEPS):
        basis, _ = np.linalg.qr(multiply(basis))
    values, vectors = np.linalg.eigh(basis.T @ multiply(basis))
    leading = np.argsort(-values)[:rank]
    return (basis @ vectors[:, leading]).astype(np.float32)


class Benchmark(NamedTuple):
    weights: np.ndarray  # per bucket
    place: np.ndarray  # row in basis per bucket; -1 outside the benchmark
    basis: np.ndarray
    latent: np.ndarray  # unit vectors of the items
    ids: np.ndarray
    words: list[np.ndarray]


def index_items(items: DataFrame, weights: np.ndarray) -> Benchmark | None:
    """The search index of one block of items, in the latent space of their TF-IDF matrix."""
    block = items.select("item_id", "text").toPandas()  # ITEMS rows at most
    word, first = tokens(*buffer_of(pa.array(block["text"], pa.string())))
    listed = [word[a:b] for a, b in zip(first[:-1], first[1:])]
    if not len(word):
        return None
    place = np.full(BUCKETS, -1, np.int64)
    used = np.unique(bucket_of(word))
    place[used] = np.arange(len(used))
    basis = latent_basis(items, weights, place)
    latent = np.array([(basis[place[bucket_of(w)]] * weights[bucket_of(w)][:, None]).sum(0) for w in listed], np.float32)
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    return Benchmark(weights, place, basis, latent, block["item_id"].to_numpy(), listed)


def common_length(item: np.ndarray, region: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel: one word of ``region`` per step."""
    masks: dict[int, int] = {}
    for i, word in enumerate(item.tolist()):
        masks[word] = masks.get(word, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for word in region.tolist():
        hit = row & masks.get(word, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


def passages(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every passage; a passage begins every STRIDE words until the text is covered."""
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(-(-(n - PASSAGE) // STRIDE), 0) + 1, 0)
    owner = np.repeat(np.arange(len(n)), count)
    turn = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = first[owner] + turn * STRIDE
    return start, np.minimum(start + PASSAGE, first[owner + 1]), owner


def projected(start: np.ndarray, end: np.ndarray, known: np.ndarray, at: np.ndarray, weight: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Latent vectors of passages; ``known`` are the places of the benchmark's words. Passages share their halves."""
    middle = np.minimum(start + STRIDE, end)
    half, of = np.unique(np.concatenate([start, middle[middle < end]]), return_inverse=True)
    stop = np.empty(len(half), np.int64)
    stop[of] = np.concatenate([middle, end[middle < end]])
    low, high = np.searchsorted(known, half), np.searchsorted(known, stop)
    sums = np.zeros((len(half), basis.shape[1]), np.float32)
    for k in range(STRIDE):
        more = np.flatnonzero(low + k < high)
        place = known[low[more] + k]
        sums[more] += basis[at[place]] * weight[place][:, None]
    out = sums[of[: len(start)]]
    out[middle < end] += sums[of[len(start) :]]
    return out


def search(texts: pa.Array, index: Benchmark) -> dict[int, dict[int, tuple[float, float, float]]]:
    """By row and place of the item: cosine, common share and answer share of the matches."""
    word, first = tokens(*buffer_of(texts))
    found: dict[int, dict[int, tuple[float, float, float]]] = {}
    if not len(word):
        return found
    bucket = bucket_of(word)
    at, weight = index.place[bucket], index.weights[bucket]
    square = weight.astype(np.float64) ** 2
    all_sum = np.concatenate([[0], np.cumsum(square)])
    own_sum = np.concatenate([[0], np.cumsum(square * (at >= 0))])
    start, end, owner = passages(first)
    # The cosine of a passage with any item is at most the root of its share of weight on the benchmark's words.
    near = own_sum[end] - own_sum[start] >= COSINE**2 * (all_sum[end] - all_sum[start])
    start, end, owner = start[near], end[near], owner[near]
    known = np.flatnonzero(at >= 0)
    seen = np.zeros(len(index.basis) + 1, bool)  # the last for words outside the benchmark
    size = np.array([len(w) for w in index.words])
    places: dict[int, np.ndarray] = {}
    for low in range(0, len(start), 2048):
        s, e, o = (x[low : low + 2048] for x in (start, end, owner))
        vector = projected(s, e, known, at, weight, index.basis)
        length = np.linalg.norm(vector, axis=1, keepdims=True)
        cosine = (vector / np.maximum(length, 1e-9)) @ index.latent.T
        p, i = np.nonzero(cosine >= COSINE)
        begin, stop = np.maximum(first[o[p]], s[p] - size[i]), np.minimum(first[o[p] + 1], e[p] + size[i])
        for p, i, text, begin, stop in zip(p.tolist(), i.tolist(), o[p].tolist(), begin.tolist(), stop.tolist()):
            if i in found.get(text, ()):
                continue
            item = index.words[i]
            if i not in places:
                places[i] = index.place[bucket_of(item)]
            # The subsequence is no longer than the number of the item's words in the region.
            seen[at[begin:stop]] = True
            held = np.count_nonzero(seen[places[i]])
            seen[at[begin:stop]] = False
            if not len(item) or held < COMMON * len(item):
                continue
            region = word[begin:stop]
            share = common_length(item, region) / len(item)
            if share < COMMON:
                continue
            rare = item[np.argsort(-index.weights[bucket_of(item)], kind="stable")[: -(-len(item) // 3)]]
            answer = float(np.isin(rare, region).mean())
            if answer >= ANSWER:
                found.setdefault(text, {})[int(i)] = (float(cosine[p, i]), share, answer)
    return found


MATCH = "struct<item_id:bigint,cosine:double,common_share:double,answer_share:double>"


def matches(text: Column, index: Benchmark) -> Column:
    """The items a text matches; NULL if none."""
    held = SparkSession.active().sparkContext.broadcast(index)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("common_share", pa.float64()), ("answer_share", pa.float64())]))

    @F.arrow_udf(f"array<{MATCH}>")
    def find(text: pa.Array) -> pa.Array:
        out = []
        for part in slices(pa.RecordBatch.from_arrays([text], ["text"]), "text", SLICE):
            found = search(part.column(0), held.value)
            for row in range(part.num_rows):
                hits = found.get(row)
                out.append(hits and [dict(zip(("item_id", "cosine", "common_share", "answer_share"), (held.value.ids[i], *v))) for i, v in sorted(hits.items())])
        give_back()
        return pa.array(out, kind)

    return find(text)


def indexes(docs: DataFrame, benchmark: DataFrame) -> list[Benchmark]:
    n = benchmark.count()
    if not n:
        return []
    weights = word_weights(docs)
    blocks = -(-n // ITEMS) if n <= ITEMS else -(-2 * n // ITEMS)  # hashed blocks differ in size
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    made = [index_items(benchmark if blocks == 1 else benchmark.filter(part == b), weights) for b in range(blocks)]
    return [index for index in made if index is not None]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, common_share and answer_share of every match."""
    found = [docs.select("doc_id", F.explode(matches(F.col("text"), index)).alias("m")).select("doc_id", "m.*") for index in indexes(docs, benchmark)]
    empty = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, cosine double, common_share double, answer_share double")
    return found[0] if len(found) == 1 else reduce(DataFrame.union, found, empty)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that match no item, with their own columns."""
    for index in indexes(docs, benchmark):
        docs = docs.filter(matches(F.col("text"), index).isNull())
    return docs
