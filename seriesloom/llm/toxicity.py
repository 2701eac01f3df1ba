"""Toxicity by class-conditional Kneser-Ney models.

Two models give the bytes of a word, from its left boundary to its right one, in
toxic and in ordinary documents. Each conditions on up to ORDER - 1 bytes of the
word and discounts its counts; what it discounts goes to a shared Kneser-Ney model
of byte triples, whose continuation counts (how many bytes precede a triple) come
from the words of all documents. An expression rare in both classes so gets the
same backoff from both and says nothing.

A word's evidence is the log of its likelihood ratio beyond NOISE; a document's
score is the evidence per byte, calibrated to the probability of a toxic label on
labelled rows the models have not seen.

Labels are read only from rows in the training part: crc32(doc_id as text) mod 3 is
not 1. The class models may be fitted on a bounded sample of those (LABELLED rows,
smallest hashes of the id) and keep every gram counted twice or more, so their size
follows the sample, not the corpus; the shared model counts all documents and has a row per
byte triple. Only these go to every task.

Defined results: NULL, empty and blank texts have no evidence and the lowest score;
a NULL doc_id is not held out and never labelled; a document labelled twice counts
as toxic if one label says so; without labels of both kinds every score is 0;
repeated rows have equal scores; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm.hashing import U64, lower_ascii, prefix_sums, scramble, window_hashes, words
from seriesloom.llm.tables import batch_of, buffer_of, slices

ORDER = 8
DISCOUNT = 0.95
NOISE = 2.0  # nats a word's ratio must exceed
THRESHOLD = 0.7
LABELLED = 20_000
SEED = 104_729
SLICE = 1 << 20
LEAST_EVIDENCE = 1e-3


class Words(NamedTuple):
    """Distinct words of a slice, each between boundaries, and where they stand."""

    data: np.ndarray  # bytes; every word has two spaces before and one after it
    starts: np.ndarray  # of the words in data
    lengths: np.ndarray
    word_of: np.ndarray  # for each occurrence
    owner: np.ndarray


def distinct_words(column: pa.Array) -> Words:
    data, offsets = buffer_of(column)
    data = lower_ascii(data)
    starts, ends, owner = words(data, offsets)
    _, lead, word_of = np.unique(window_hashes(prefix_sums(data), starts, ends), return_index=True, return_inverse=True)
    lengths = (ends - starts)[lead]
    begin = np.cumsum(lengths + 3) - lengths - 1
    out = np.full(int((lengths + 3).sum()), 32, np.uint8)
    inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(begin, lengths) + inside] = data[np.repeat(starts[lead], lengths) + inside]
    return Words(out, begin, lengths, word_of, owner)


class Places(NamedTuple):
    """The predicted bytes of distinct words: gram and context keys, byte triple, word."""

    gram: np.ndarray
    context: np.ndarray
    triple: np.ndarray
    word: np.ndarray


def places(found: Words) -> Places:
    n = found.lengths + 1  # the bytes of the word and the boundary after it
    word = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
    at = found.starts[word] + step
    first = at - np.minimum(step + 1, ORDER - 1)
    sums = prefix_sums(found.data)
    wide = found.data.astype(np.int64)
    triple = wide[at - 2] << 16 | wide[at - 1] << 8 | wide[at]
    return Places(window_hashes(sums, first, at + 1), window_hashes(sums, first, at), triple, word)


def _quads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.empty(0, np.int64)
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            found = distinct_words(part.column("text"))
            wide = np.concatenate([[32], found.data]).astype(np.int64)
            if len(found.data):
                at = places(found)
                inside = np.repeat(found.starts, found.lengths + 1)
                step = np.arange(len(inside)) - np.repeat(np.cumsum(found.lengths + 1) - found.lengths - 1, found.lengths + 1)
                seen = np.union1d(seen, wide[inside + step - 2] << 24 | at.triple)
    yield pa.RecordBatch.from_arrays([pa.array(seen)], ["quad"])


def shared_model(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted byte triples with the probability of their last byte, the weight of the rest per pair, and single bytes.

    Counts are continuation counts over all documents: how many bytes precede a triple.
    """
    quads = docs.select("text").mapInArrow(_quads, "quad long").distinct()
    triples = quads.groupBy(F.col("quad").bitwiseAND((1 << 24) - 1).alias("triple")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    triples = triples.sort_values("triple")
    triple, n = triples["triple"].to_numpy(np.int64), triples["n"].to_numpy(np.float64)
    context, last = triple >> 8, triple & 255
    total = np.bincount(context, weights=n, minlength=1 << 16)
    kinds = np.bincount(context, minlength=1 << 16)
    single = (np.bincount(last, minlength=256) + 1) / (len(last) + 256)
    rest = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
    own = (n - DISCOUNT) / total[context] if len(n) else n
    return triple, own.astype(np.float32), rest.astype(np.float32), single.astype(np.float32)


def _counts(ids: np.ndarray, toxic: np.ndarray):
    schema = pa.schema([("gram", pa.int64()), ("context", pa.int64()), ("n0", pa.int64()), ("n1", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(ids, batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False))
            known = ids[np.minimum(at, len(ids) - 1)] == batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            known &= batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            chosen, label = batch.filter(pa.array(known)), toxic[at[known]]
            done = 0
            for part in slices(chosen, "text", SLICE):
                kind = label[done : done + part.num_rows]
                done += part.num_rows
                found = distinct_words(part.column("text"))
                if not len(found.word_of):
                    continue
                once = np.unique(found.owner.astype(np.int64) * len(found.lengths) + found.word_of)  # a document counts a word once
                owner, word = once // len(found.lengths), once % len(found.lengths)
                texts = [np.bincount(word, weights=kind[owner] == c, minlength=len(found.lengths)) for c in (0, 1)]
                at_word = places(found)
                gram, lead, of = np.unique(at_word.gram, return_index=True, return_inverse=True)
                n0, n1 = (np.bincount(of, weights=t[at_word.word], minlength=len(gram)).astype(np.int64) for t in texts)
                yield batch_of(schema, gram.view(np.int64), at_word.context[lead].view(np.int64), n0, n1)

    return run


class Model(NamedTuple):
    shared: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
    gram: np.ndarray  # sorted keys
    gram_n: np.ndarray  # per class
    context: np.ndarray
    context_n: np.ndarray  # counts, then kinds, per class
    slope: float = 1.0
    offset: float = 0.0


def labelled(labels: DataFrame, rows: int = LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Ids and labels of the sample, sorted by id; training rows only."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(~held_out(F.col("doc_id")))
    found = known.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(rows).toPandas().sort_values("doc_id")
    return found["doc_id"].to_numpy(np.int64), found["toxic"].to_numpy(np.int64)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    ids, toxic = labelled(labels)
    apart = scramble(ids.view(U64), 31) % U64(5) == 0  # kept from the models for the calibration
    if len(np.unique(toxic[~apart])) < 2:
        return None
    counted = docs.select("doc_id", "text").mapInArrow(_counts(ids[~apart], toxic[~apart]), "gram long, context long, n0 long, n1 long")
    grams = counted.groupBy("gram", "context").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    # What one document alone has is discounted away.
    gram, context, n0, n1 = (c.to_numpy() for c in grams.filter("n0 + n1 > 1").select("gram", "context", "n0", "n1").toArrow().columns)
    order = np.argsort(gram.view(U64))
    gram_n = np.column_stack([n0, n1]).astype(np.float32)[order]
    keys, of = np.unique(context.view(U64), return_inverse=True)
    context_n = np.column_stack([np.bincount(of, weights=w, minlength=len(keys)).astype(np.float32) for w in (n0, n1, n0 > 0, n1 > 0)])
    model = Model(shared_model(docs), gram.view(U64)[order], gram_n, keys, context_n)
    return calibrated(model, docs, ids[apart], toxic[apart])


def calibrated(model: Model, docs: DataFrame, ids: np.ndarray, toxic: np.ndarray) -> Model:
    """Logistic regression of the label on the log of the evidence; the rows are a bounded sample."""
    only = F.pandas_udf(lambda v: v.isin(ids), "boolean")
    if not len(ids):
        return model
    rows = docs.filter(F.col("doc_id").isNotNull()).filter(only("doc_id"))
    rows = rows.select("doc_id", evidence(F.col("text"), model).alias("e")).toPandas()
    x = np.log(rows["e"].to_numpy() + LEAST_EVIDENCE)
    y = toxic[np.searchsorted(ids, rows["doc_id"].to_numpy())]
    beta, design = np.zeros(2), np.column_stack([x - np.log(LEAST_EVIDENCE), np.ones(len(x))])
    for _ in range(50):  # Newton steps with a weak ridge
        p = 1 / (1 + np.exp(-design @ beta))
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        beta += np.linalg.solve(hessian, design.T @ (y - p) - 1e-3 * beta)
    return model._replace(slope=float(max(beta[0], 1e-6)), offset=float(beta[1]))


def look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Rows of ``values`` for wanted keys; zeros for unknown ones."""
    if not len(keys):
        return np.zeros((len(wanted), values.shape[1]), np.float32)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return values[at] * (keys[at] == wanted)[:, None]


def word_ratios(found: Words, model: Model) -> np.ndarray:
    """log p_toxic - log p_ordinary of each distinct word."""
    at = places(found)
    keys, of = np.unique(at.gram, return_inverse=True)
    n = look_up(model.gram, model.gram_n, keys)[of]
    keys, of = np.unique(at.context, return_inverse=True)
    context = look_up(model.context, model.context_n, keys)[of]
    triple, own, rest, single = model.shared
    low = look_up(triple, own[:, None], at.triple)[:, 0] + rest[at.triple >> 8] * single[at.triple & 255]
    p = []
    for c in (0, 1):
        total = context[:, c]
        seen = total > 0
        total = np.maximum(total, 1)
        p.append(np.where(seen, np.maximum(n[:, c] - DISCOUNT, 0) / total + DISCOUNT * context[:, 2 + c] / total * low, low))
    return np.bincount(at.word, weights=np.log(p[1] / p[0]), minlength=len(found.lengths))


def evidence(text: Column, model: Model) -> Column:
    """Evidence beyond NOISE of all words of a text, per byte."""
    held = SparkSession.active().sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        out = []
        for part in slices(pa.RecordBatch.from_arrays([text], ["text"]), "text", SLICE):
            found = distinct_words(part.column(0))
            ratio = np.maximum(word_ratios(found, held.value) - NOISE, 0) if len(found.word_of) else np.zeros(0)
            total = np.bincount(found.owner, weights=ratio[found.word_of], minlength=part.num_rows)
            size = np.bincount(found.owner, weights=found.lengths[found.word_of] + 1, minlength=part.num_rows)
            out.append(pa.array(total / np.maximum(size, 1)))
        return pa.concat_arrays(out) if out else pa.array([], pa.float64())

    return score(text)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = fit(docs, labels)
    if model is None:
        score = F.lit(0.0)
    else:
        strength = F.log(evidence(F.col("text"), model) + F.lit(LEAST_EVIDENCE)) - F.lit(float(np.log(LEAST_EVIDENCE)))
        score = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(model.slope) * strength + F.lit(model.offset))))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
