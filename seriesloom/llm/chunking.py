"""Substring deduplication by content-defined chunking.

A gear hash rolls over the UTF-8 bytes of a text and cuts it where the leading
bits are zero, so cuts depend on the last WINDOW bytes only: after an insertion or
deletion they fall into step again. Chunks with equal digests are repeats of the
first one (smallest doc_id, then position). Runs of neighbouring repeats of at
least RUN_BYTES are removed; shorter ones are phrases that texts share by chance.

Defined results: a NULL or empty text has no chunks; no cut depends on another
text; a repeat inside one text counts as well; rows without doc_id come last and
rows with equal doc_id are told apart by position only; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.hashing import CODES, prefix_sums, window_hashes
from seriesloom.llm.tables import batch_of, buffer_of, packed, slices, unpacked
from seriesloom.session import cut_lineage

WINDOW = 16  # bytes a cut depends on, a power of two
CUT_BITS = 5  # a cut at one of 32 positions
LEAST_BYTES, MOST_BYTES = 16, 256
RUN_BYTES = 100

GEAR = (CODES >> np.uint64(32)).astype(np.uint32)
CHUNKS = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("length", pa.int32()), ("digest", pa.int64())])


def gear_cuts(data: np.ndarray) -> np.ndarray:
    """Positions after which the leading CUT_BITS of the gear hash of the last WINDOW bytes are zero.

    The hash shifts by one bit per byte. Hashes of twice as many bytes are sums of
    two hashes, one of them shifted.
    """
    value, span = GEAR[data], 1
    while span < WINDOW:
        longer = value.copy()
        longer[span:] += value[:-span] << np.uint32(span)
        value, span = longer, span * 2
    # Of the bits that all WINDOW bytes reach, take the uppermost.
    return np.flatnonzero(value >> np.uint32(32 - CUT_BITS) == 0) + 1


def chunk_ends(cuts: list[int], begin: int, end: int) -> list[int]:
    """Ends of the chunks of one text: the next cut at least LEAST_BYTES on, or MOST_BYTES without one."""
    ends = []
    for cut in cuts:
        while cut - begin > MOST_BYTES:
            begin += MOST_BYTES
            ends.append(begin)
        if cut - begin >= LEAST_BYTES:
            begin = cut
            ends.append(cut)
    while end - begin > MOST_BYTES:
        begin += MOST_BYTES
        ends.append(begin)
    if begin < end:
        ends.append(end)
    return ends


def _chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            data, offsets = buffer_of(part.column("text"))
            if not len(data):
                continue
            cuts = gear_cuts(data)
            # A cut less than LEAST_BYTES into a text is never used, so no used cut has seen another text.
            first = np.searchsorted(cuts, offsets, "right")
            listed = cuts.tolist()
            ends: list[int] = []
            counts = []
            for i, (begin, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                found = chunk_ends(listed[first[i] : first[i + 1]], begin, end)
                counts.append(len(found))
                ends += found
            ends = np.array(ends, np.int64)
            owner = np.repeat(np.arange(part.num_rows), counts)
            starts = np.concatenate([[0], ends[:-1]])
            digest = window_hashes(prefix_sums(data), starts, ends).view(np.int64)
            ids = part.column("doc_id").take(pa.array(owner))
            yield batch_of(CHUNKS, ids, (starts - offsets[owner]).astype(np.int32), (ends - starts).astype(np.int32), digest)


def chunked(docs: DataFrame) -> DataFrame:
    """(doc_id, start, length, digest) of every chunk; positions in bytes."""
    return docs.select("doc_id", "text").mapInArrow(_chunk, "doc_id long, start int, length int, digest long")


def repeated_spans(docs: DataFrame, run_bytes: int = RUN_BYTES) -> DataFrame:
    """Runs of repeated chunks: doc_id, span_start, span_end (bytes), n_chunks and the ids kept instead.

    The first place of a digest is found by a partial aggregation, so a chunk that
    stands in every text arrives once per task; the join back may split it.
    """
    chunks = cut_lineage(chunked(docs))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "start")
    seen = chunks.groupBy("digest", "length").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    seen = seen.select("digest", "length", F.col("place.doc_id").alias("kept_doc_id"), F.col("place.start").alias("kept_start"))
    again = chunks.join(cut_lineage(seen), ["digest", "length"])
    again = again.filter(~(F.col("doc_id").eqNullSafe(F.col("kept_doc_id")) & (F.col("start") == F.col("kept_start"))))
    # Neighbouring chunks of a text follow each other without a gap, so a run is the chunks up to the next gap.
    one = F.struct("start", (F.col("start") + F.col("length")).alias("end"), "kept_doc_id")
    per_text = again.groupBy("doc_id").agg(F.array_sort(F.collect_set(one)).alias("chunks"))
    return per_text.mapInArrow(_runs(run_bytes), "doc_id long, span_start int, span_end int, n_chunks int, kept_doc_ids array<long>")


RUNS = pa.schema([("doc_id", pa.int64()), ("span_start", pa.int32()), ("span_end", pa.int32()), ("n_chunks", pa.int32()), ("kept_doc_ids", pa.list_(pa.int64()))])


def _runs(run_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, chunks in zip(batch.column("doc_id").to_pylist(), batch.column("chunks").to_pylist()):
                open_run: list = []
                for chunk in [*chunks, None]:
                    if open_run and (chunk is None or chunk["start"] > open_run[-1]["end"]):
                        begin, end = open_run[0]["start"], max(c["end"] for c in open_run)
                        if end - begin >= run_bytes:
                            kept = sorted({c["kept_doc_id"] for c in open_run if c["kept_doc_id"] is not None})
                            rows.append((doc_id, begin, end, len(open_run), kept))
                        open_run = []
                    if chunk is not None:
                        open_run.append(chunk)
            if rows:
                yield batch_of(RUNS, *zip(*rows))

    return run


def without_repeats(docs: DataFrame, run_bytes: int = RUN_BYTES) -> DataFrame:
    """``docs`` with the repeated spans cut out of their texts."""
    spans = repeated_spans(docs, run_bytes).filter("doc_id IS NOT NULL")
    spans = cut_lineage(spans.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("span_start", "span_end"))).alias("_spans")))

    @F.arrow_udf("string")
    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for value, gone in zip(text.to_pylist(), spans.to_pylist()):
            if value is not None and gone:
                raw, at, kept = value.encode(), 0, []
                for span in gone:
                    kept.append(raw[at : span["span_start"]])
                    at = max(at, span["span_end"])
                value = b"".join([*kept, raw[at:]]).decode("utf-8", "ignore")
            out.append(value)
        return pa.array(out, pa.string())

    rows = packed(docs, "doc_id", "text").join(spans.withColumnRenamed("doc_id", "_id"), F.col("_doc_id") == F.col("_id"), "left")
    return unpacked(rows, docs.columns, text=cut("_text", "_spans"))
