"""Repeated substrings by blockwise suffix sorting with a difference cover.

A byte is removed when a string of LENGTH bytes that covers it also starts
anywhere else. Sorting all suffixes would find every such string, but most
suffixes have no long tie with another one and need no place in any order:

* Positions whose offset in their text is in COVER modulo PERIOD are the cover
  sample. COVER is a difference cover: for any two suffixes there is a shift below
  PERIOD that puts both on sample positions, so suffixes tied over LENGTH bytes have
  sample positions tied over the LENGTH - PERIOD + 1 bytes that are left. Sample
  suffixes are sorted first, bucket by bucket; only whether a sample suffix is tied
  is kept, one bit each.
* A suffix is resolved further only if a tied sample position lies within PERIOD
  bytes. These suffixes are sorted bucket by bucket over their LENGTH bytes.

Suffixes are compared by 64-bit hashes of the bytes compared (n suffixes meet by
chance in about n**2 / 2**65 pairs) and buckets are ranges of these hashes, so
that a frequent passage, which every chunk of texts names once, cannot overfill
one. A bucket holds the suffixes of at most about BUCKET_BYTES of text.

Texts are packed into compressed chunks, written once as a table bucketed by
chunk: both passes join their answers to it without moving a text again.

Defined results: a NULL text is empty; a text shorter than LENGTH loses nothing;
of equal texts all are removed whole, if they are long enough; repeated rows and
rows without doc_id are texts of their own; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.hashing import U64, prefix_sums, window_hashes
from seriesloom.llm.tables import batch_of, buffer_of, slices
from seriesloom.session import run_folder

LENGTH = 200
# A perfect difference set; every residue modulo PERIOD is one difference of two members.
PERIOD = 133
COVER = np.array([0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109])

CHUNK_BYTES = 1 << 21
BUCKET_BYTES = 1 << 24

CHUNKS = pa.schema([("chunk", pa.int64()), ("n_bytes", pa.int64()), ("ids", pa.binary()), ("known", pa.binary()), ("lengths", pa.binary()), ("texts", pa.binary())])
BLOBS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), ("keys", pa.binary())])
TIES = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("n", pa.int32()), ("bits", pa.binary())])
SPANS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, chunk = TaskContext.get().partitionId(), 0
    for batch in batches:
        for part in slices(batch, "text", CHUNK_BYTES):
            data, offsets = buffer_of(part.column("text"))
            ids = part.column("doc_id")
            row = (
                [task << 32 | chunk],
                [len(data)],
                [ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()],
                [ids.is_valid().to_numpy(zero_copy_only=False).tobytes()],
                [np.diff(offsets).tobytes()],
                [zstandard.compress(data.tobytes(), 1)],
            )
            yield batch_of(CHUNKS, *row)
            chunk += 1


def pack(docs: DataFrame) -> DataFrame:
    """The texts in chunks of about CHUNK_BYTES, as a table bucketed by chunk in the shared folder."""
    spark = docs.sparkSession
    packed = docs.select("doc_id", "text").mapInArrow(_pack, "chunk long, n_bytes long, ids binary, known binary, lengths binary, texts binary")
    name = f"chunks_{uuid.uuid4().hex}"
    buckets = max(16, 2 * docs.rdd.getNumPartitions())
    packed.write.bucketBy(buckets, "chunk").option("path", run_folder(spark, "chunks")).saveAsTable(name)
    return spark.table(name)


class Chunk:
    """One chunk's texts and the hashes both passes need."""

    def __init__(self, lengths: bytes, texts: bytes):
        self.lengths = np.frombuffer(lengths, np.int64)
        self.ends = np.cumsum(self.lengths)
        self.data = np.frombuffer(zstandard.decompress(texts, max_output_size=int(self.ends[-1]) if len(self.ends) else 0), np.uint8)
        self.sums = prefix_sums(self.data)

    def sample(self) -> np.ndarray:
        """Cover positions of texts that hold a string of LENGTH, with LENGTH - PERIOD + 1 bytes left."""
        size = np.maximum(self.lengths - (LENGTH - PERIOD), 0) * (self.lengths >= LENGTH)
        rounds = -(-size // PERIOD)
        owner = np.repeat(np.arange(len(size)), rounds)
        turn = np.arange(len(owner)) - np.repeat(np.cumsum(rounds) - rounds, rounds)
        offset = (turn[:, None] * PERIOD + COVER[None, :]).reshape(-1)
        owner = np.repeat(owner, len(COVER))
        inside = offset < size[owner]
        return (self.ends - self.lengths)[owner[inside]] + offset[inside]

    def sample_keys(self) -> tuple[np.ndarray, np.ndarray]:
        at = self.sample()
        return at, window_hashes(self.sums, at, at + (LENGTH - PERIOD + 1)) >> U64(16)

    def near_ties(self, tied: np.ndarray) -> np.ndarray:
        """Suffixes of at least LENGTH bytes with a tied sample position less than PERIOD ahead."""
        step = np.zeros(len(self.data) + 1, np.int32)
        begin = (self.ends - self.lengths)[np.searchsorted(self.ends, tied, "right")]
        np.add.at(step, np.maximum(tied - PERIOD + 1, begin), 1)
        np.add.at(step, tied + 1, -1)
        near = np.cumsum(step[:-1]) > 0
        room = np.repeat(np.minimum(self.lengths, LENGTH - 1), self.lengths)
        last = np.repeat(self.ends, self.lengths)
        at = np.flatnonzero(near)
        return at[(at + LENGTH <= last[at]) & (room[at] > 0)]

    def suffix_keys(self, tied: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.near_ties(tied)
        return at, window_hashes(self.sums, at, at + LENGTH)


def twice(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct keys, and whether each occurs more than once here."""
    ordered = np.sort(keys)
    lead = np.ones(len(ordered), bool)
    lead[1:] = ordered[1:] != ordered[:-1]
    first = np.flatnonzero(lead)
    return ordered[first], np.diff(np.append(first, len(ordered))) > 1


def planes(ordered: np.ndarray) -> bytes:
    """Sorted numbers as the byte planes of their differences: the upper planes are mostly zero."""
    steps = np.diff(ordered, prepend=U64(0)).astype("<u8")
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unplaned(blob: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(blob, max_output_size=8 * n), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(raw.T).view("<u8").reshape(-1), dtype=U64)


def _dealt(chunk: int, keys: np.ndarray, bits: int, buckets: int) -> pa.RecordBatch:
    """A blob per bucket; buckets are equal ranges of the keys."""
    ordered, _ = twice(keys)
    edges = np.array([((k << bits) + buckets - 1) // buckets for k in range(1, buckets)], U64)
    cuts = np.concatenate([[0], np.searchsorted(ordered, edges), [len(ordered)]])
    full = np.flatnonzero(np.diff(cuts))
    blobs = [planes(ordered[cuts[b] : cuts[b + 1]]) for b in full]
    return batch_of(BLOBS, full.astype(np.int32), np.full(len(full), chunk), np.diff(cuts)[full].astype(np.int32), blobs)


def _ties_of_bucket(rows: pa.Table) -> pa.Table:
    """Sort one bucket: a bit per key of every chunk, set if another chunk has the key."""
    chunks, counts = rows.column("chunk").to_pylist(), rows.column("n").to_pylist()
    parts = [unplaned(blob, n) for blob, n in zip(rows.column("keys").to_pylist(), counts)]
    ordered = np.sort(np.concatenate(parts))
    tied = ordered[1:][ordered[1:] == ordered[:-1]]
    bits = []
    for part in parts:
        at = np.minimum(np.searchsorted(tied, part), max(len(tied) - 1, 0))
        bits.append(np.packbits(tied[at] == part if len(tied) else np.zeros(len(part), bool)).tobytes())
    return pa.Table.from_batches([batch_of(TIES, chunks, rows.column("bucket").to_pylist(), counts, bits)])


def ties(blobs: DataFrame) -> DataFrame:
    """Per chunk the answers of all buckets in order."""
    answers = blobs.groupBy("bucket").applyInArrow(_ties_of_bucket, "chunk long, bucket int, n int, bits binary")
    return answers.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "bits"))).alias("answers"))


def _tied_positions(at: np.ndarray, keys: np.ndarray, answers: list[dict] | None) -> np.ndarray:
    """The positions whose key is tied, in this chunk or by the answers."""
    ordered, tied = twice(keys)
    bits = [np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=a["n"]) for a in answers or []]
    if bits:
        tied = tied | np.concatenate(bits).astype(bool)
    found = ordered[tied]
    if not len(found):
        return at[:0]
    return at[found[np.minimum(np.searchsorted(found, keys), len(found) - 1)] == keys]


def _sample_blobs(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, keys = Chunk(row["lengths"], row["texts"]).sample_keys()
                yield _dealt(row["chunk"], keys, 48, buckets)

    return run


def _suffix_blobs(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                chunk = Chunk(row["lengths"], row["texts"])
                _, keys = chunk.suffix_keys(_tied_positions(*chunk.sample_keys(), row["answers"]))
                yield _dealt(row["chunk"], keys, 64, buckets)

    return run


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            chunk = Chunk(row["lengths"], row["texts"])
            at, keys = chunk.suffix_keys(_tied_positions(*chunk.sample_keys(), row["answers"]))
            tied = _tied_positions(at, keys, row["suffix_answers"])
            step = np.zeros(len(chunk.data) + 1, np.int32)
            step[tied] += 1  # positions are distinct
            step[np.minimum(tied + LENGTH, len(chunk.data))] -= 1
            gone = np.cumsum(step[:-1]) > 0
            first = np.zeros(len(chunk.data) + 1, bool)
            begins = chunk.ends - chunk.lengths
            first[begins] = True
            starts = gone.copy()
            starts[1:] &= ~gone[:-1] | first[1:-1]
            removed, spans = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, starts))
            digests = []
            for begin, end in zip(begins, chunk.ends):
                text = chunk.data[begin:end]
                cut = removed[end] - removed[begin]
                kept = text if not cut else text[~gone[begin:end]]
                digests.append(hashlib.sha256(kept.tobytes()).hexdigest())
            ids = pa.array(np.frombuffer(row["ids"], np.int64), mask=~np.frombuffer(row["known"], bool))
            yield batch_of(SPANS, ids, chunk.lengths, removed[chunk.ends] - removed[begins], spans[chunk.ends] - spans[begins], digests)


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    chunks = pack(docs)
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    texts = chunks.select("chunk", "lengths", "texts")
    blobs = "bucket int, chunk long, n int, keys binary"
    sample = store(ties(texts.mapInArrow(_sample_blobs(max(1, buckets // 2)), blobs)))
    resolved = with_answers(texts, sample, "answers")
    suffix = store(ties(resolved.mapInArrow(_suffix_blobs(buckets), blobs))).withColumnRenamed("answers", "suffix_answers")
    complete = with_answers(with_answers(chunks, sample, "answers"), suffix, "suffix_answers")
    return complete.mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def store(answers: DataFrame) -> DataFrame:
    path = run_folder(answers.sparkSession, "answers")
    answers.write.parquet(path)
    return answers.sparkSession.read.schema(answers.schema).parquet(path)


def with_answers(chunks: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    """The answers are the built side, so the bucketed texts stay where they are."""
    return chunks.join(answers.select("chunk", name).hint("shuffle_hash"), "chunk", "left")
