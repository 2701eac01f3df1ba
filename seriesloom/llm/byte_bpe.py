"""Byte-level BPE: texts to token ids and back, each distinct word encoded once for the whole corpus.

1. Texts are cut into pre-tokens by the tokenizer's pattern, in blocks of whole
   texts. A block numbers its distinct words, the most frequent first, and keeps
   every text as the sequence of these numbers: its words exploded with positions,
   grouped by block. The blocks are written, bucketed by block.
2. The words of all blocks are shuffled by word and sorted. Equal words follow each
   other, are merged into tokens once, and give a row of ids per block that holds
   them. However frequent a word is, it has one row per block.
3. The ids go back to their block, where every text puts them together by position.
   The written texts are bucketed and stay where they are.

Decoding joins ids with the table of token bytes. The vocabulary is the only thing
sent to all tasks; its size is that of the file.

A piece that is a token is that token; else the neighbouring pair of least rank is
merged, the leftmost of equals, until no pair is in the vocabulary. Long pieces use
a heap, so a text without any break takes n log n steps.

Memory: a block ends with the text that brings it to BLOCK_WORDS distinct words or
BLOCK_PLACES pre-tokens; a longer text is a block of its own.

Defined results: a NULL or empty text has no ids and decodes to no bytes; strings of
special tokens are ordinary text; rows with equal or no doc_id stay separate rows;
ids unknown to the vocabulary do not occur in encoding and fail in decoding; other
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import heapq
import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.tables import batch_of, buffer_of, list_array, slices
from seriesloom.session import run_folder

BLOCK_WORDS = 400_000  # distinct words of a block
BLOCK_PLACES = 8_000_000  # pre-tokens of a block
HELD_WORDS = 500_000  # encoded words a task holds before it passes them on
LONG_PIECE = 200  # bytes from which a heap finds the next merge
PUT_TOGETHER = 500_000  # pre-tokens put together, and ids decoded, at a time

BLOCKS = pa.schema([("block", pa.int64()), ("words", pa.list_(pa.string())), ("doc_id", pa.int64()), ("places", pa.binary())])
CODES = pa.schema([("block", pa.int64()), ("numbers", pa.binary()), ("sizes", pa.binary()), ("ids", pa.binary())])
ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
DECODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ids from a file of lines ``base64 id``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


def _merged_by_heap(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(piece)
    follow = list(range(1, n + 1))  # where the part that begins here ends
    before = list(range(-1, n - 1))
    alive = [True] * n + [False]
    heap = []

    def offer(start: int) -> None:
        middle = follow[start]
        if middle < n:
            rank = ranks.get(piece[start : follow[middle]])
            if rank is not None:
                heapq.heappush(heap, (rank, start, middle, follow[middle]))

    for start in range(n):
        offer(start)
    while heap:
        _, start, middle, end = heapq.heappop(heap)
        if not (alive[start] and alive[middle] and follow[start] == middle and follow[middle] == end):
            continue  # one of the two has been merged since
        alive[middle] = False
        follow[start] = end
        if end < n:
            before[end] = start
        offer(start)
        if before[start] >= 0:
            offer(before[start])
    return [ranks[piece[start : follow[start]]] for start in range(n) if alive[start]]


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) >= LONG_PIECE:
        return _merged_by_heap(piece, ranks)
    never = 1 << 62
    get = ranks.get
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [get(piece[i : i + 2], never) for i in range(len(piece) - 1)]
    while pairs:
        least = min(pairs)
        if least == never:
            break
        i = pairs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], never)
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], never)
    return [ranks[part] for part in parts]


def packed_numbers(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in as many bytes of seven bits as they need, and where each begins (one more entry)."""
    size = np.ones(len(numbers), np.int8)
    for k in range(1, 4):
        size += numbers >= 1 << 7 * k
    begin = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    out = np.empty(int(begin[-1]), np.uint8)
    for k in range(4):
        has = size > k
        out[begin[:-1][has] + k] = (numbers[has] >> 7 * k & 127) | np.where(size[has] > k + 1, 128, 0)
    return out, begin


def unpacked_numbers(data: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(data < 128)
    begin = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    value = np.zeros(len(last), np.int64)
    for k in range(4):
        has = begin + k <= last
        value[has] |= (data[begin[has] + k].astype(np.int64) & 127) << 7 * k
    return value


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Pieces of a buffer of bytes as a binary column."""
    data = np.ascontiguousarray(data).view(np.uint8)
    column = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    return column.cast(pa.binary())


def packed_lists(numbers: np.ndarray, edge: np.ndarray) -> pa.Array:
    """Lists of numbers, between ``edge``, packed."""
    data, begin = packed_numbers(numbers)
    return binary_array(data, begin[edge])


def together(texts: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Runs of texts with about PUT_TOGETHER numbers each; a longer text stands alone."""
    some, total = [], 0
    for text in texts:
        if some and total + len(text) > PUT_TOGETHER:
            yield some
            some, total = [], 0
        some.append(text)
        total += len(text)
    if some:
        yield some


def unpacked_lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [unpacked_numbers(np.frombuffer(x.as_buffer(), np.uint8)) for x in column]


def _in_blocks(pattern: str, most_words: int, most_places: int):
    """Rows of blocks: one with the words, most frequent first, and one per text with their numbers."""

    def block_rows(block: int, known: dict[str, int], ids: list[int | None], texts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(known), np.int64)
        for some in together(texts):
            counts += np.bincount(np.concatenate(some), minlength=len(known))
        order = np.argsort(-counts, kind="stable").astype(np.int32)
        rank = np.empty(len(known), np.int32)
        rank[order] = np.arange(len(known), dtype=np.int32)
        names = pa.array(known, pa.string()).take(pa.array(order))
        yield batch_of(BLOCKS, [block], list_array(names, np.array([0, len(known)])), [None], [None])
        row = 0
        for some in together(texts):
            n = len(some)
            column = packed_lists(rank[np.concatenate(some)], np.cumsum([0] + [len(t) for t in some]))
            yield batch_of(BLOCKS, [block] * n, [None] * n, ids[row : row + n], column)
            row += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = regex.compile(pattern).findall
        block, places = TaskContext.get().partitionId() << 32, 0
        known: defaultdict[str, int] = defaultdict(count().__next__)
        ids, texts = [], []
        for batch in batches:
            for part in slices(batch, "text"):
                for doc_id, text in zip(part.column("doc_id"), part.column("text")):
                    numbers = np.array([known[piece] for piece in cut(text.as_py() or "")], np.int32)
                    ids.append(doc_id.as_py())
                    texts.append(numbers)
                    places += len(numbers)
                    if len(known) >= most_words or places >= most_places:
                        yield from block_rows(block, known, ids, texts)
                        block, places, ids, texts = block + 1, 0, [], []
                        known = defaultdict(count().__next__)
        if ids:
            yield from block_rows(block, known, ids, texts)

    return run


def in_blocks(docs: DataFrame, pattern: str, most_words: int = BLOCK_WORDS, most_places: int = BLOCK_PLACES) -> DataFrame:
    """The written blocks, bucketed by block in the shared folder; their name in the catalog is given up again."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text").mapInArrow(_in_blocks(pattern, most_words, most_places), "block long, words array<string>, doc_id long, places binary")
    name = f"blocks_{uuid.uuid4().hex}"
    buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows.write.bucketBy(buckets, "block").option("path", run_folder(spark, "blocks")).option("compression", "zstd").saveAsTable(name)
    written = spark.table(name)  # from here on the plan knows the files and their buckets
    spark.sql(f"DROP TABLE {name}")
    return written


def _encode_sorted(ranks: Broadcast):
    """Sorted (word, block, number) rows to the ids of words, many words of one block in a row."""

    def passed_on(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        block, number, size, ids = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort([number, block])
        begin = np.cumsum(size) - size
        sizes = size[order]
        flat = ids[np.repeat(begin[order], sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
        blocks, first = np.unique(block[order], return_index=True)
        edge = np.append(first, len(order))
        ends = np.concatenate([[0], np.cumsum(sizes)])[edge]
        step = np.diff(number[order], prepend=0)
        step[first] = number[order][first]
        return batch_of(CODES, blocks, packed_lists(step, edge), packed_lists(sizes, edge), packed_lists(flat, ends))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks.value
        last: tuple[str | None, list[int]] = (None, [])
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column("word").dictionary_encode()
            words = coded.dictionary.to_pylist()
            found = [last[1] if w == last[0] else encode_piece(w.encode(), table) for w in words]
            last = (words[-1], found[-1])  # the order is by word, so the last one may go on
            size = np.array([len(x) for x in found], np.int64)
            begin = np.cumsum(size) - size
            flat = np.array([i for x in found for i in x], np.int32)
            at = coded.indices.to_numpy()
            sizes = size[at]
            ids = flat[np.repeat(begin[at], sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
            held.append((batch.column("block").to_numpy(), batch.column("number").to_numpy(), sizes, ids))
            n += batch.num_rows
            if n >= HELD_WORDS:
                yield passed_on(held)
                held, n = [], 0
        if held:
            yield passed_on(held)

    return run


def _put_together(codes: pa.Table, texts: pa.Table) -> pa.Table:
    """The ids of each text of one block."""

    empty = np.empty(0, np.int64)
    number = np.concatenate([empty, *[np.cumsum(x) for x in unpacked_lists(codes.column("numbers"))]])
    size = np.concatenate([empty, *unpacked_lists(codes.column("sizes"))])
    ids = np.concatenate([empty, *unpacked_lists(codes.column("ids"))]).astype("<u4")
    begin, length = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
    begin[number], length[number] = np.cumsum(size) - size, size
    out, row = [], 0
    texts = texts.combine_chunks()
    places = [np.frombuffer(p.as_buffer(), np.uint8) for p in texts.column("places").combine_chunks()]
    while row < len(places):
        some, total = [], 0
        while row + len(some) < len(places) and (not some or total < PUT_TOGETHER):
            some.append(unpacked_numbers(places[row + len(some)]))
            total += len(some[-1])
        numbers = np.concatenate(some)
        sizes = length[numbers]
        reach = np.concatenate([[0], np.cumsum(sizes)])
        step = np.arange(int(reach[-1])) - np.repeat(reach[:-1], sizes)
        edge = np.cumsum([0] + [len(x) for x in some])
        values = ids[np.repeat(begin[numbers], sizes) + step]
        out.append(batch_of(ENCODED, texts.column("doc_id").slice(row, len(some)).combine_chunks(), binary_array(values, 4 * reach[edge])))
        row += len(some)
    return pa.Table.from_batches(out, ENCODED)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, most_words: int = BLOCK_WORDS, most_places: int = BLOCK_PLACES) -> DataFrame:
    """doc_id and ids of every row of ``docs`` (doc_id, text); ids are little-endian unsigned 32-bit numbers, as `id_list` shows."""
    blocks = in_blocks(docs, pattern, most_words, most_places)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    words = blocks.where("places IS NULL").select("block", F.posexplode("words").alias("number", "word"))
    # One shuffle: rows of a word arrive next to each other, however many blocks hold it.
    routed = words.repartition("word").sortWithinPartitions("word")
    codes = routed.mapInArrow(_encode_sorted(shared), "block long, numbers binary, sizes binary, ids binary")
    texts = blocks.where("places IS NOT NULL").select("block", "doc_id", "places")
    return codes.groupBy("block").cogroup(texts.groupBy("block")).applyInArrow(_put_together, "doc_id long, ids binary")


class TokenBytes:
    """The bytes of all tokens in one buffer, with the place of each id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = np.full(max(ranks.values(), default=-1) + 1, -1, np.int64)
        for token, i in ranks.items():
            self.size[i] = len(token)
        by_id = sorted(ranks, key=ranks.get)
        self.data = np.frombuffer(b"".join(by_id), np.uint8)
        self.begin = np.cumsum(np.maximum(self.size, 0)) - np.maximum(self.size, 0)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The bytes of lists of ids that lie between ``offsets``."""
        known = ids < len(self.size)
        size = self.size[np.where(known, ids, 0)]
        if not known.all() or (size < 0).any():
            raise ValueError("an id is not in the vocabulary")
        reach = np.concatenate([[0], np.cumsum(size)])
        data = self.data[np.repeat(self.begin[ids] - reach[:-1], size) + np.arange(int(reach[-1]))]
        return binary_array(data, reach[offsets])


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``encoded`` (doc_id, ids) with the bytes the ids stand for, as ``decoded``."""
    table = encoded.sparkSession.sparkContext.broadcast(TokenBytes(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "ids", 4 * PUT_TOGETHER):
                data, offsets = buffer_of(part.column("ids"))
                yield batch_of(DECODED, part.column("doc_id"), part.column("ids"), table.value.decode(data.view("<u4"), offsets // 4))

    return encoded.select("doc_id", F.coalesce("ids", F.lit(b"")).alias("ids")).mapInArrow(run, "doc_id long, ids binary, decoded binary")


def id_list(ids: Column) -> Column:
    """The ids of a text as an array."""

    @F.arrow_udf("array<long>")
    def listed(column: pa.Array) -> pa.Array:
        data, offsets = buffer_of(column)
        return list_array(data.view("<u4").astype(np.int64), offsets // 4)

    return listed(ids)


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[dict[bytes, int], str]:
    """Ranks and pattern of a public tokenizer; read on the driver, its files need not be on the executors."""
    import public_tokenizers

    return read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN
