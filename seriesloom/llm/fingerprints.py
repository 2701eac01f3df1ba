"""Homomorphic multiset fingerprints of documents.

A document is a multiset of paragraphs (lines with visible text, white space
folded). Its fingerprint is the sum of wide vectors hashed from them, so it does
not depend on their order, and inserting or deleting a paragraph adds or
subtracts one vector:

* 8 lanes modulo 2**32, hashed from whole paragraphs, decide equality;
* 128 lanes modulo 2**16 sum a vector of +1 and -1 for every sentence of the
  paragraphs. The squared length of a difference of two such sums, divided by
  128, estimates how many sentences the two do not share.

Defined results: a NULL text is the empty text; all empty texts have the zero
fingerprint and likeness 1 to each other; documents are ordered by doc_id, NULL
first, equal ids by the hash of the text; a table of one row is its own next
document; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.tables import batch_of

WIDE, LANES = 8, 128
RANGE_TEXTS, MOST_RANGES = 2_000, 4_096  # documents of one range of doc_id, about; ranges at most
LEAST = -(1 << 63)

SENTENCE = re.compile(r"(?<=[.!?])\s+")
EMPTY = np.zeros(WIDE + LANES, np.int64)


def fingerprint(text: str | None) -> np.ndarray:
    """The lanes of a text as integers: WIDE modulo 2**32, then LANES modulo 2**16."""
    wide, signs = [], []
    for line in (text or "").split("\n"):
        paragraph = " ".join(line.split())
        if paragraph:
            wide.append(hashlib.blake2b(paragraph.encode("utf-8", "replace"), digest_size=4 * WIDE).digest())
            for sentence in SENTENCE.split(paragraph):
                signs.append(hashlib.blake2b(sentence.encode("utf-8", "replace"), digest_size=LANES // 8, person=b"sentence").digest())
    if not wide:
        return EMPTY
    first = np.frombuffer(b"".join(wide), "<u4").reshape(-1, WIDE).sum(0, dtype=np.uint64) % (1 << 32)
    bits = np.unpackbits(np.frombuffer(b"".join(signs), np.uint8).reshape(-1, LANES // 8), axis=1)
    second = 2 * bits.sum(0, dtype=np.int64) - len(bits)
    return np.concatenate([first.astype(np.int64), second % (1 << 16)])


def combine(a: np.ndarray, b: np.ndarray, sign: int = 1) -> np.ndarray:
    """The fingerprint of both multisets together, or with ``sign=-1`` of the first without the second."""
    out = a + sign * b
    out[:WIDE] %= 1 << 32
    out[WIDE:] %= 1 << 16
    return out


def as_text(lanes: np.ndarray) -> str:
    return lanes[:WIDE].astype(">u4").tobytes().hex() + lanes[WIDE:].astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal fingerprints, else the estimated share of common sentences, in 0 to 1."""
    if (a == b).all():
        return 1.0

    def centred(x: np.ndarray) -> np.ndarray:
        return (x + (1 << 15)) % (1 << 16) - (1 << 15)

    x, y = centred(a[WIDE:]), centred(b[WIDE:])
    both = float((x * x).sum() + (y * y).sum())
    return min(1.0, max(0.0, 1.0 - float((centred(x - y) ** 2).sum()) / both)) if both else 0.0


def range_of(docs: DataFrame, per_range: int = RANGE_TEXTS) -> tuple[Column, int]:
    """The range of ``doc_id`` a row belongs to, and the number of ranges.

    Cuts come from approximate quantiles of the ids alone. Ranges are sorted and
    streamed, never held, so MOST_RANGES bounds the list of cuts, not the data.
    """
    ids = docs.select(F.coalesce("doc_id", F.lit(LEAST)).alias("_id"))
    parts = min(MOST_RANGES, max(1, ids.count() // per_range))
    cuts = ids.approxQuantile("_id", [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 else []
    cuts = np.unique(np.array(cuts, np.float64).astype(np.int64))

    @F.pandas_udf("int")
    def part(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(np.int64), "right").astype(np.int32))

    return part(F.coalesce("doc_id", F.lit(LEAST))), len(cuts) + 1


def _edited_rows(schema: pa.Schema):
    def one(doc_id, text: str, lanes: np.ndarray, other: str, next_lanes: np.ndarray) -> tuple:
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        changed = fingerprint(edited)
        digest = hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest()
        return doc_id, len(text), digest, as_text(lanes), as_text(changed), likeness(lanes, changed), likeness(lanes, next_lanes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []
        for batch in batches:
            names = ("part", "doc_id", "text", "is_next")
            for part, doc_id, text, is_next in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names]):
                text = text or ""
                lanes = fingerprint(text)
                if held is not None and held[0] == part:
                    rows.append(one(*held[1:], text, lanes))
                held = None if is_next else (part, doc_id, text, lanes)
                if len(rows) >= 1000:
                    yield batch_of(schema, *zip(*rows))
                    rows = []
        if rows:
            yield batch_of(schema, *zip(*rows))

    return run


FINGERPRINT_ROWS = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
     ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its text with the second half replaced by the next document's start."""
    docs = docs.select("doc_id", "text")
    part, parts = range_of(docs)
    rows = docs.withColumns({"part": part, "_tie": F.xxhash64("text")})
    # One row opens each range: the least id and, among equal ids, the least hash.
    opening = rows.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id", "_tie")).alias("o"))
    around = Window.orderBy("part")
    last = F.max("part").over(Window.partitionBy())
    opening = opening.select(
        "part", F.col("o.doc_id").alias("_oid"), F.col("o._tie").alias("_otie"), F.coalesce(F.lag("part").over(around), last).alias("_copy")
    )
    openings = F.broadcast(opening.withColumnRenamed("part", "_part"))  # one row per range, MOST_RANGES at most
    hit = (F.col("part") == F.col("_part")) & F.col("doc_id").eqNullSafe(F.col("_oid")) & F.col("_tie").eqNullSafe(F.col("_otie"))
    copies = rows.join(openings, hit).dropDuplicates(["_part"])
    copies = copies.select(F.col("_copy").alias("part"), "doc_id", "text", "_tie", F.lit(True).alias("is_next"))
    every = rows.select("part", "doc_id", "text", "_tie", F.lit(False).alias("is_next")).unionByName(copies)
    dealt = every.repartition(parts, "part").sortWithinPartitions("part", "is_next", F.col("doc_id").asc_nulls_first(), "_tie")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("part", "doc_id", "text", "is_next").mapInArrow(_edited_rows(FINGERPRINT_ROWS), schema)
