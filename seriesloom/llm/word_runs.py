"""Periodic runs of words: stretches that repeat with a period at least TIMES times over.

A run is a stretch of consecutive words with smallest period q (words q apart are
equal) and a length of at least ``max(LEAST, TIMES * q)`` that no neighbouring word
extends. Every text is searched whole, many texts at a time.

* Periods up to SHORT are found by comparing all words with those q further on.
* Longer ones are found by scale. At the scale of the periods 2**s ... 2**(s+1) - 1
  every run of 2**(s-2) words (a gram) has a hash, and the least hash of each window
  of 2**(s-1) grams is a minimizer. Inside a run the windows repeat at period
  distance, and so do their minima: three equal minimizers the same distance apart
  seed an extension, word by word, to both sides. Grams that overlap themselves by
  half or more belong to a shorter period and never become minimizers, so equal
  minimizers are more than 2**(s-3) words apart and a seed has a bounded number of
  partners. A run always has other grams, else its period would be a shorter one.
* A stretch found with a multiple of its period is the same stretch as that of the
  period itself, and the least period stays.

Words are compared by numbers that stand for their bytes exactly; hashes only
choose seeds. One pass over the texts, nothing is shuffled. Memory follows the
longest single text, about 150 bytes a word.

Defined results: a NULL, empty or blank text has no words and no runs and collapses
to an empty text; rows with equal or no doc_id stay separate rows; equal words are
equal bytes; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.hashing import U64, is_space, scramble, word_offsets, words
from seriesloom.llm.tables import batch_of, buffer_of, slices

LEAST = 6  # words of a run at least
TIMES = 4  # periods in a run at least
SHORT = 15  # longest period whose lag is compared directly
GATHERED = 1 << 18  # words copied at a time
MIX = U64(0xD1342543DE82EF95)
NONE = U64(0xFFFFFFFFFFFFFFFF)
SPACE = r"[\x20\x09-\x0D]+"

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])


def numbered_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number per word, the same for equal bytes only."""
    bounds = np.concatenate([[0], np.cumsum(ends - starts)])
    bare = data[~is_space(data)]
    column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(bare)])
    return column.dictionary_encode().indices.to_numpy()


def _stretches(same: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """Word ranges in which all words equal the word ``lag`` further on, where long enough for a run."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
    begin, end = edge[::2], edge[1::2] + lag
    enough = end - begin >= max(LEAST, TIMES * lag)
    return begin[enough], end[enough]


def short_periods(number: np.ndarray, owner: np.ndarray) -> list[np.ndarray]:
    """Stretches (start, end, lag) of the lags up to SHORT."""
    found = []
    for lag in range(1, min(SHORT, len(number) - 1) + 1):
        begin, end = _stretches((number[lag:] == number[:-lag]) & (owner[lag:] == owner[:-lag]), lag)
        if len(begin):
            found.append(np.stack([begin, end, np.full(len(begin), lag)], 1))
    return found


def _slid(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """Least or greatest value of each window of ``width`` (a power of two) values."""
    step = 1
    while step < width:
        values = best(values[:-step], values[step:])
        step *= 2
    return values


def seeds(gram: np.ndarray, order: np.ndarray, new: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of minimizers that come three times at the same distance.

    ``order`` sorts the grams (NONE where there is no gram) by hash and place, and
    ``new`` marks the first of each hash in that order.
    """
    apart = np.diff(order, prepend=order[:1])
    group = np.cumsum(new) - 1
    overlaps = np.zeros(int(group[-1]) + 1, bool)
    overlaps[group[~new & (apart <= size // 2)]] = True
    value = gram.copy()
    value[order[overlaps[group]]] = NONE
    width = 2 * size
    least = _slid(value, width, np.minimum)
    edge = np.zeros(width - 1, U64)
    chosen = (value == _slid(np.concatenate([edge, least, edge]), width, np.maximum)) & (value != NONE)
    keep = chosen[order]
    place, group = order[keep], group[keep]
    low, high = 4 * size, 8 * size - 1  # the periods of the scale
    at, by = [], []
    for step in range(1, len(place)):
        distance = place[step:] - place[:-step]
        near = (group[step:] == group[:-step]) & (distance <= high)
        if not near.any():
            break
        near &= distance >= low
        at.append(place[:-step][near])
        by.append(distance[near])
    if not at:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at, by = np.concatenate(at), np.concatenate(by)
    key = by * len(gram) + at
    key.sort()
    key = key[np.isin(key + key // len(gram), key)]
    return key % len(gram), key // len(gram)


def extended(number: np.ndarray, first: int, last: int, at: int, lag: int) -> tuple[int, int]:
    """The stretch around ``at`` in which words equal those ``lag`` further on, inside words first ... last - 1."""
    end, step = at, 64
    while end < last - lag:
        stop = min(end + step, last - lag)
        differ = np.flatnonzero(number[end:stop] != number[end + lag : stop + lag])
        if len(differ):
            end += int(differ[0])
            break
        end, step = stop, 2 * step
    begin, step = at, 64
    while begin > first:
        stop = max(begin - step, first)
        differ = np.flatnonzero(number[stop:begin] != number[stop + lag : begin + lag])
        if len(differ):
            begin = stop + int(differ[-1]) + 1
            break
        begin, step = stop, 2 * step
    return begin, end + lag


def long_periods(number: np.ndarray, owner: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Stretches (start, end, lag) of the lags above SHORT, found by equal minimizers."""
    count = np.diff(first)
    found: list[tuple[int, int, int]] = []
    place = np.arange(len(number))
    gram, size = scramble(number.astype(U64), 3), 1
    while True:
        # Grams of twice the size; those that cross the end of a text are left out below.
        gram = scramble(gram * MIX + np.concatenate([gram[size:], np.zeros(min(size, len(gram)), U64)])[: len(gram)])
        size *= 2
        if 4 * size <= SHORT:
            continue
        kept = count[owner[place]] >= TIMES * 4 * size
        if not kept.any():
            break
        # Only whole texts go, so grams within those that stay are still side by side.
        place, gram = place[kept], gram[kept]
        text = owner[place]
        inside = place + size <= first[text + 1]
        value = np.where(inside, scramble(gram + text.astype(U64) * MIX, 7), NONE)
        order = np.argsort(value, kind="stable")
        order = order[: int(inside.sum())]
        new = np.ones(len(order), bool)
        new[1:] = value[order[1:]] != value[order[:-1]]
        done: dict[int, int] = {}
        for at, lag in zip(*(x.tolist() for x in seeds(value, order, new, size))):
            at = int(place[at])
            if at < done.get(lag, -1):
                continue
            begin, end = extended(number, int(first[owner[at]]), int(first[owner[at] + 1]), at, lag)
            done[lag] = end - lag
            if end - begin >= max(LEAST, TIMES * lag):
                found.append((begin, end, lag))
    return [np.array(found, np.int64)] if found else []


def runs_of(number: np.ndarray, owner: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(start, end, period) of all runs, in word numbers of the whole buffer, by start and period."""
    found = short_periods(number, owner) + long_periods(number, owner, first)
    if not found:
        return np.empty((0, 3), np.int64)
    all_found = np.concatenate(found)
    all_found = all_found[np.lexsort((all_found[:, 2], all_found[:, 1], all_found[:, 0]))]
    single = np.ones(len(all_found), bool)
    single[1:] = (all_found[1:, :2] != all_found[:-1, :2]).any(1)
    all_found = all_found[single]
    return all_found[np.lexsort((all_found[:, 2], all_found[:, 0]))]


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, texts: int) -> pa.Array:
    """Texts of the given words with one space between them."""
    size = ends - starts
    rank = word_offsets(owner, texts)
    holds = np.diff(rank) > 0
    before = np.concatenate([[0], np.cumsum(holds)])  # texts with words, each without a space at its end
    reach = np.concatenate([[0], np.cumsum(size + 1)])
    offsets = reach[rank] - before
    target = reach[:-1] - before[owner]
    out = np.full(int(offsets[-1]), 32, np.uint8)
    for low in range(0, len(size), GATHERED):
        part = slice(low, low + GATHERED)
        step = np.arange(int(size[part].sum())) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
        out[np.repeat(target[part], size[part]) + step] = data[np.repeat(starts[part], size[part]) + step]
    column = pa.Array.from_buffers(pa.large_binary(), texts, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)])
    return column.cast(pa.binary()).cast(pa.string())


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            texts = part.num_rows
            data, offsets = buffer_of(part.column("text"))
            starts, ends, owner = words(data, offsets)
            first = word_offsets(owner, texts)
            number = numbered_words(data, starts, ends)
            runs = runs_of(number, owner, first)
            text = owner[runs[:, 0]] if len(runs) else np.empty(0, np.int64)
            dropped = np.zeros(len(number) + 1, np.int64)
            np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
            np.add.at(dropped, runs[:, 1], -1)
            kept = np.cumsum(dropped[:-1]) == 0
            spans = [runs[:, 0] - first[text], runs[:, 1] - runs[:, 0], runs[:, 2]]
            structs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in spans], fields=list(RUN))
            lists = pa.ListArray.from_arrays(pa.array(word_offsets(text, texts), pa.int32()), structs)
            yield batch_of(FOUND, part.column("doc_id"), lists, joined_words(data, starts[kept], ends[kept], owner[kept], texts))


def word_runs(docs: DataFrame) -> DataFrame:
    """doc_id, all runs (start, length and period in words, by start and period) and the text without the repeats.

    ``collapsed`` keeps the words that no run holds after its first period.
    """
    return docs.select("doc_id", "text").mapInArrow(
        _search, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    )


def strongest(runs: Column) -> Column:
    """The run of the greatest length / period, compared exactly; the first of equals; NULL without runs."""

    def better(best: Column, run: Column) -> Column:
        more = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | more, run).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast("struct<start: long, length: long, period: long>"), better)


def listed(runs: Column) -> Column:
    """One line ``start,length,period`` for each run."""
    return F.concat_ws("", F.transform(runs, lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])))


def with_repeated_tail(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, the end of every text whose hash says so replaced by repeats of one piece of it.

    With h = crc32 of the decimal doc_id, g = h div 10 and n words, texts with
    h % 10 = 0 keep their first a = g % n words, and then repeat the next
    1 + (n - a) div (3 + g % 8) words up to word n. Other texts, those without words
    and those without a doc_id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = F.filter(F.split("text", SPACE), lambda w: w != "")
    rows = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, split).alias("w"))
    rows = rows.select("doc_id", "text", "w", F.floor(F.col("h") / 10).alias("g"), F.size("w").cast("long").alias("n"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    unit = F.expr("slice(w, cast(a + 1 as int), cast(p as int))")
    tail = F.slice(F.flatten(F.array_repeat(unit, F.expr("cast((n - a) div p + 1 as int)"))), F.lit(1), F.expr("cast(n - a as int)"))
    edited = F.array_join(F.concat(F.expr("slice(w, 1, cast(a as int))"), tail), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, edited).otherwise(F.col("text")).alias("text"))
