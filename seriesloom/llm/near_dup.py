"""Near-duplicate documents by one-permutation MinHash.

A document's distinct word shingles are hashed once; the least hash in each of
BANDS * ROWS bins is its signature, and empty bins take the value of a filled bin
chosen by hashing (bin, attempt), the optimal densification. Documents that agree
in a band share a bucket. Each bucket gives a star: its smallest member against
the others, so a bucket of n members has n - 1 candidate pairs. Candidates are
confirmed on full sets. Members that a star leaves outside its centre's component
are then compared, in blocks, with all members of the star, so no link between
members of a bucket is lost and no pairs are listed but links.

Documents with equal sets are one node from the start and are never paired.

Defined results: ASCII letters are lower-cased; a document with fewer words than a
shingle has one shingle, the whole sequence; NULL, empty and blank texts have no
shingles and are linked with nothing; rows with equal doc_id are one document; a
row without doc_id is in no component; other columns are not read; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.hashing import U64, lower_ascii, prefix_sums, scramble, window_hashes, word_offsets, words
from seriesloom.llm.links import IdFilter, components
from seriesloom.llm.tables import batch_of, buffer_of, give_back, list_array, packed, slices, unpacked
from seriesloom.session import cut_lineage

SHINGLE_WORDS = 5
SIMILAR = 80  # percent of the union that two documents share at least
BANDS, ROWS = 32, 4  # a pair of similarity 0.8 is missed with probability 5e-8
BIN_BITS = 7  # log2(BANDS * ROWS)
BLOCK_SHINGLES = 500_000  # shingles of the sets compared with each other in one task
SLICE = 1 << 19  # bytes of text worked on at once
KEPT_BYTES = 6  # of a shingle hash when sets are compared


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and where each text's begin."""
    texts = len(offsets) - 1
    data = lower_ascii(data)
    starts, ends, owner = words(data, offsets)
    if not len(starts):
        return np.empty(0, U64), np.zeros(texts + 1, np.int64)
    word = window_hashes(prefix_sums(data), starts, ends)
    first = word_offsets(owner, texts)
    n = np.diff(first)
    value = np.zeros(len(word), U64)
    for k in range(size):  # shorter runs at the end of a text are masked below
        value = value * U64(0xD1342543DE82EF95) + np.concatenate([word[k:], np.zeros(min(k, len(word)), U64)])[: len(word)]
    place = np.arange(len(word)) - first[owner]
    whole = place + size <= n[owner]
    few = np.flatnonzero((n > 0) & (n < size))
    short = np.zeros(len(few), U64)
    for k in range(size - 1):
        there = n[few] > k
        short[there] = short[there] * U64(0xD1342543DE82EF95) + word[first[few[there]] + k]
    value = scramble(np.concatenate([value[whole], short + U64(1)]), 5)
    owner = np.concatenate([owner[whole], few])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, word_offsets(owner, texts)


def signatures(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One row of BANDS * ROWS least hashes per text; rows of texts without shingles are zero."""
    bins = 1 << BIN_BITS
    texts = len(first) - 1
    owner = np.repeat(np.arange(texts), np.diff(first))
    cell = owner * bins + (value >> U64(64 - BIN_BITS)).astype(np.int64)
    lead = np.ones(len(cell), bool)
    lead[1:] = cell[1:] != cell[:-1]
    table, filled = np.zeros(texts * bins, U64), np.zeros(texts * bins, bool)
    table[cell[lead]], filled[cell[lead]] = value[lead], True
    table, filled = table.reshape(texts, bins), filled.reshape(texts, bins)
    row, column = np.nonzero(~filled & (np.diff(first) > 0)[:, None])
    attempt = 1
    while len(row):
        donor = (scramble(np.arange(bins, dtype=U64) * U64(1 << 20) + U64(attempt), 11) >> U64(64 - BIN_BITS)).astype(np.int64)[column]
        hit = filled[row, donor]
        table[row[hit], column[hit]] = table[row[hit], donor[hit]]
        row, column, attempt = row[~hit], column[~hit], attempt + 1
    return table


def band_keys(table: np.ndarray) -> np.ndarray:
    rows = table.reshape(len(table), BANDS, ROWS)
    key = np.arange(BANDS, dtype=U64)[None, :] * U64(0x2545F4914F6CDD1D)
    for k in range(ROWS):
        key = scramble(key + rows[:, :, k], 13)
    return key.view(np.int64)


SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", pa.list_(pa.int64()))])
SETS = pa.schema([("node", pa.int64()), ("set", pa.binary())])


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                value, first = shingle_sets(*buffer_of(part.column("text")), size)
                n = np.diff(first)
                digests = []
                for seed in (17, 19):  # sums of scrambled hashes stand for the set
                    sums = np.concatenate([np.zeros(1, U64), np.cumsum(scramble(value, seed), dtype=U64)])
                    digests.append((sums[first[1:]] - sums[first[:-1]]).view(np.int64))
                keys = band_keys(signatures(value, first))[n > 0]
                lists = list_array(keys.reshape(-1), np.concatenate([[0], np.cumsum((n > 0) * BANDS)]))
                yield batch_of(SIGNED, part.column("doc_id"), n, *digests, lists)
            give_back()

    return run


def _sets_of(admitted: IdFilter, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = admitted.admits(batch.column("slot").to_numpy(zero_copy_only=False)) & batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(chosen))
            for part in slices(batch, "text", SLICE):
                value, first = shingle_sets(*buffer_of(part.column("text")), size)
                kept = value.byteswap().view(np.uint8).reshape(-1, 8)[:, :KEPT_BYTES]
                offsets = pa.py_buffer((first * KEPT_BYTES).astype(np.int32))
                column = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, offsets, pa.py_buffer(np.ascontiguousarray(kept).tobytes())])
                yield batch_of(SETS, part.column("doc_id"), column)
            give_back()

    return run


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def unpack(raw) -> np.ndarray:
    six = np.frombuffer(raw, np.uint8).reshape(-1, KEPT_BYTES)
    wide = np.zeros((len(six), 8), np.uint8)
    wide[:, 8 - KEPT_BYTES :] = six
    return wide.view(">u8").reshape(-1).astype(U64)


def _similar(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"))):
                x, y = unpack(x.as_buffer()), unpack(y.as_buffer())
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                linked[i] = 100 * shared >= percent * (len(x) + len(y) - shared)
            found = batch.filter(pa.array(linked))
            if found.num_rows:
                yield batch_of(PAIRS, found.column("a"), found.column("b"))
            give_back()

    return run


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    at_b = pairs.join(sets.withColumnsRenamed({"node": "b", "set": "set_b"}), "b")
    both = at_b.join(sets.withColumnsRenamed({"node": "a", "set": "set_a"}), "a")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(_similar(percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words_each: int = SHINGLE_WORDS, percent: int = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (whether it is the smallest id of its component) of every document."""
    signed = cut_lineage(docs.select("doc_id", "text").mapInArrow(_sign(words_each), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"))
    known = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = known.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    buckets = classes.select("node", "n", F.explode("bands").alias("key"))
    whole = Window.partitionBy("key")
    buckets = buckets.withColumns({"first": F.min("node").over(whole), "_n": F.count(F.lit(1)).over(whole)}).filter("_n > 1")
    members = cut_lineage(buckets.groupBy("first", "node").agg(F.max("n").alias("n")))
    admitted = IdFilter(members.select("node"), "node")
    sets = cut_lineage(
        docs.select("doc_id", IdFilter.slot("doc_id"), "text").mapInArrow(_sets_of(admitted, words_each), "node long, set binary").dropDuplicates(["node"])
    )
    stars = members.filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    links = cut_lineage(confirm(stars, sets, percent))
    comps = cut_lineage(components(links))
    more = cut_lineage(outside_links(members, comps, sets, percent))
    if not more.isEmpty():
        comps = cut_lineage(components(links.union(more)))
    return placed_documents(signed, classes, comps)


def outside_links(members: DataFrame, comps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of members that their star left outside the centre's component, to any member of the star.

    These few are a query set against all members of the star. Both sides are cut
    into blocks of BLOCK_SHINGLES, and a block of queries meets a block of members
    on full sets in one task, which gives confirmed links only.
    """
    place = comps.select(F.col("node").alias("_n"), "component")
    rows = members.join(place, F.col("node") == F.col("_n"), "left").select("first", "node", "n", F.coalesce("component", "node").alias("component"))
    centre = comps.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    rows = rows.join(centre, F.col("first") == F.col("_n"), "left")
    rows = cut_lineage(rows.select("first", "node", "n", "component", (F.col("component") != F.coalesce("_c", "first")).alias("query")))

    def blocks(total: Column) -> Column:
        return F.ceil(total / F.lit(BLOCK_SHINGLES)).cast("int")

    size = rows.groupBy("first").agg(blocks(F.sum("n")).alias("all_blocks"), blocks(F.sum(F.when(F.col("query"), F.col("n")))).alias("query_blocks"))
    rows = rows.join(size.filter("query_blocks > 0"), "first")
    hashed = F.xxhash64("node")
    queries = rows.filter("query").withColumn("i", F.pmod(hashed, "query_blocks").cast("int"))
    queries = queries.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1))).withColumn("asks", F.lit(True))
    others = rows.withColumn("j", F.pmod(hashed, "all_blocks").cast("int"))
    others = others.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1))).withColumn("asks", F.lit(False))
    both = queries.unionByName(others).select("first", "i", "j", "asks", "node", "component")
    both = both.join(sets, "node").select("first", "i", "j", "asks", "node", "component", "set")
    return both.groupBy("first", "i", "j").applyInArrow(_block_links(percent), "a long, b long").distinct()


def _block_links(percent: int):
    def run(rows: pa.Table) -> pa.Table:
        asks = rows.column("asks").to_numpy()
        sets = [unpack(x.as_buffer()) for x in rows.column("set").combine_chunks()]
        node, component = rows.column("node").to_numpy(), rows.column("component").to_numpy()
        others, queries = np.flatnonzero(~asks), np.flatnonzero(asks)
        found: list[tuple[int, int]] = []
        if len(others) and len(queries):
            sizes = np.array([len(sets[i]) for i in others])
            known, at = np.unique(np.concatenate([sets[i] for i in others]), return_inverse=True)
            begin = np.cumsum(sizes) - sizes
            for q in queries:
                place = np.searchsorted(known, sets[q])
                place = place[place < len(known)]
                mark = np.zeros(len(known), np.int32)
                mark[place] = np.isin(known[place], sets[q])
                shared = np.add.reduceat(mark[at], begin)
                linked = 100 * shared >= percent * (len(sets[q]) + sizes - shared)
                linked &= component[others] != component[q]
                found += [tuple(sorted((int(node[q]), int(node[o])))) for o in others[linked]]
        give_back()
        return pa.Table.from_batches([batch_of(PAIRS, [a for a, _ in found], [b for _, b in found])])

    return run


def placed_documents(signed: DataFrame, classes: DataFrame, comps: DataFrame) -> DataFrame:
    nodes = classes.select("d1", "d2", "node").join(comps, "node", "left")
    nodes = nodes.select("d1", "d2", F.coalesce("component", "node").alias("component"))
    rows = signed.select("doc_id", "n_shingles", "d1", "d2").join(nodes, ["d1", "d2"], "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    rows = rows.withColumn("component_id", own)
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each_group(docs: DataFrame, words_each: int = SHINGLE_WORDS, percent: int = SIMILAR) -> DataFrame:
    """The rows of ``docs``, with their own columns, whose document is kept; one row of repeated ids.

    Rows without doc_id stay. Only ids of removed documents meet the texts, and
    repeated ids, which are few, are set apart before their rows are compared.
    """
    found = near_duplicates(docs, words_each, percent).filter("doc_id IS NOT NULL")
    ids = found.groupBy("doc_id").agg(F.bool_and("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
    ids = cut_lineage(ids.filter("NOT kept OR rows > 1"))
    rows = packed(docs, "doc_id").join(ids.withColumnRenamed("doc_id", "_id"), F.col("_doc_id") == F.col("_id"), "left")
    rows = rows.filter("_id IS NULL OR kept")
    once = rows.filter("rows > 1").dropDuplicates(["_id"])
    return unpacked(rows.filter("rows IS NULL OR rows = 1").unionByName(once), docs.columns)
