"""Prefix trie of conversations as a burst trie.

A turn is known by two 64-bit hashes of its role and text; a prefix by the
exclusive or of the hashes of (depth, turn), again 128 bits. Texts are read once and
never shuffled.

1. Equal conversations become one sequence with a weight; the sequences make the trie.
2. All sequences start in one container under the root. A container whose suffixes
   have more than CONTAINER turns is burst: its prefix becomes a head of the trie and
   its suffixes go on to containers by their next turn id. As a prefix holds all the
   turns below it, the sizes of all containers that bursting can ever make come from
   one aggregation over prefixes; no round per depth is needed, however long a
   conversation is.
3. The remaining containers are dealt out, sorted, and swept: sequences in the order
   of their turn ids share with their predecessor the nodes they have in common with
   any earlier one. A sweep holds one container.
4. Heads add up what is below them, with pointers that double their reach, in as many
   rounds as the deepest head has binary digits.

The ids of the conversations that end in a node are sorted in ranges and written in
pieces; only the digest over the pieces of one node is sequential.

Defined results: rows without conv_id belong to no conversation; a NULL role or text
is empty; turns of a conversation follow their number, NULL first, and equal numbers
a fixed hash of role and text; repeated rows are repeated turns; other columns are
not read; an empty table gives no rows, and a table has a root otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.tables import batch_of
from seriesloom.operators.position import with_pos
from seriesloom.session import cut_lineage
from seriesloom.spec import SeriesSpec

CONTAINER = 2_048  # turns of the suffixes that one container holds at most
SWEPT = 50_000  # turns gathered before their containers are swept
BLOCK = 1_024  # turns of one conversation in one window
PIECE = 50_000  # conversation ids in one piece of the list of a node
GROUP = 100  # conversations that share the openings of the first one
OPENINGS = 6  # opening lengths are below this


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv, pos (from 0), n (turns of the conversation), t1 and t2 (the turn's hashes) and chars of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.xxhash64(F.lit(1), role, text).alias("t1"),
        F.xxhash64(F.lit(2), text, role).alias("t2"), F.length(text).cast("long").alias("chars"),
    )
    return with_pos(turns, SeriesSpec(keys=("conv",), time="turn", ties=("t1", "t2", "chars"))).drop("turn")


def with_shared_openings(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, depth, t1, t2, chars) of conversations rebuilt on shared openings, and all conversation ids.

    The first h turns of conversation c are those of the first conversation of its
    group of GROUP, where h is crc32 of the decimal c modulo OPENINGS; its own turns
    from number h on follow.
    """
    leader = F.col("conv") - F.col("conv") % GROUP
    opening = F.crc32(F.col("conv").cast("string").cast("binary")) % OPENINGS
    convs = turns.where("pos = 0").select("conv", leader.alias("leader"), opening.alias("h"))
    lead = turns.where((F.col("conv") == leader) & (F.col("pos") < OPENINGS)).withColumnsRenamed({"conv": "leader", "n": "leader_n"})
    opened = convs.join(lead, "leader").where("pos < h").select("conv", (F.col("pos") + 1).alias("depth"), "t1", "t2", "chars")
    known = lead.where("pos = 0").select("leader", "leader_n")
    own = turns.select("conv", leader.alias("leader"), opening.alias("h"), "pos", "t1", "t2", "chars").where("pos >= h")
    taken = F.least(F.col("h"), F.coalesce("leader_n", F.lit(0)))
    own = own.join(known, "leader", "left").select("conv", (F.col("pos") - F.col("h") + taken + 1).alias("depth"), "t1", "t2", "chars")
    return opened.unionByName(own), convs.select("conv")


def _codes() -> tuple[Column, Column]:
    return F.xxhash64(F.lit(3), "depth", "t1", "t2"), F.xxhash64(F.lit(4), "t2", "t1", "depth")


def sequences(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of every distinct sequence with the ids of their prefixes, and the whole sequence of each conversation.

    Turns: conv (the least with this sequence), weight, n, depth, t1, t2, chars, p1 and
    p2 (the prefix down to this turn), q1 and q2 (the one before). Conversations:
    conv, s1, s2 and n; a conversation without turns has the empty sequence 0, 0.
    """
    one, two = _codes()
    coded = cut_lineage(turns.withColumns({"c1": one, "c2": two}))
    whole = coded.groupBy("conv").agg(F.bit_xor("c1").alias("s1"), F.bit_xor("c2").alias("s2"), F.count(F.lit(1)).alias("n"))
    ends = convs.join(whole, "conv", "left").select("conv", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("s1", "s2", "n")])
    ends = cut_lineage(ends)
    distinct = ends.groupBy("s1", "s2").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("weight"), F.max("n").alias("n"))
    rows = coded.join(distinct.select("conv", "weight", "n"), "conv").withColumn("block", F.expr(f"depth div {BLOCK}"))
    # Exclusive ors inside blocks of a conversation, joined to those of the blocks before.
    edge = rows.groupBy("conv", "block").agg(F.bit_xor("c1").alias("b1"), F.bit_xor("c2").alias("b2"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.select("conv", "block", F.bit_xor("b1").over(earlier).alias("b1"), F.bit_xor("b2").over(earlier).alias("b2")).where("block > 0")
    inside = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"i1": F.bit_xor("c1").over(inside), "i2": F.bit_xor("c2").over(inside)})
    rows = rows.join(edge, ["conv", "block"], "left")
    for k in ("1", "2"):
        rows = rows.withColumn(f"p{k}", F.col(f"i{k}").bitwiseXOR(F.coalesce(f"b{k}", F.lit(0))))
        rows = rows.withColumn(f"q{k}", F.col(f"p{k}").bitwiseXOR(F.col(f"c{k}")))
    kept = "conv weight n depth t1 t2 chars p1 p2 q1 q2".split()
    return cut_lineage(rows.select(*kept)), ends


NODES = pa.schema([(c, pa.int64()) for c in "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens p1 p2 q1 q2".split()])
NODE_TYPE = ", ".join(f"{f.name} long" for f in NODES)


def _sweep(rows: pa.Table) -> pa.RecordBatch:
    """Nodes of whole containers; the parent of a container's top is left out.

    Every sequence is written as the bytes of its container and turns, so sorted
    sequences are sorted bytes and what neighbours share is their common prefix.
    """
    column = {c: rows.column(c).to_numpy() for c in rows.column_names}
    order = np.lexsort([column["depth"], column["conv"]])
    column = {c: v[order] for c, v in column.items()}
    first = np.flatnonzero(np.diff(column["conv"], prepend=column["conv"][0] - 1) != 0)
    last = np.append(first[1:], len(order))
    turn = np.stack([column["t1"], column["t2"]], 1).astype(">i8")
    container = np.stack([column["k1"], column["k2"]], 1).astype(">i8")
    key = [container[a].tobytes() + turn[a:b].tobytes() for a, b in zip(first, last)]
    out: list[list[int | None]] = []
    up: list[int] = []  # node above, -1 at the top
    path: list[int] = []
    before, gain = b"", []
    conv, weight, chars = (column[c].tolist() for c in ("conv", "weight", "chars"))
    depth, prefix = column["depth"].tolist(), [column[c].tolist() for c in ("p1", "p2", "q1", "q2")]
    for s in sorted(range(len(key)), key=key.__getitem__):
        a, b = int(first[s]), int(last[s])
        shared = 0
        if before[:16] == key[s][:16]:
            most = min(len(path), b - a)
            while shared < most and before[16 * shared + 16 : 16 * shared + 32] == key[s][16 * shared + 16 : 16 * shared + 32]:
                shared += 1
        del path[shared:]
        for row in range(a + shared, b):
            up.append(path[-1] if path else -1)
            path.append(len(out))
            out.append([conv[row], depth[row], None, 0, 0, 0, 0, *[p[row] for p in prefix]])
            gain.append(chars[row])
        for node in path:
            out[node][0] = min(out[node][0], conv[a])
            out[node][3] += weight[a]
        before = key[s]
    for node in range(len(out) - 1, -1, -1):  # nodes stand after those above them
        row = out[node]
        row[5] = row[5] or 1
        row[6] += (row[3] - 1) * gain[node]
        if up[node] >= 0:
            above = out[up[node]]
            above[4] += 1
            above[5] += row[5]
            above[6] += row[6]
            row[2] = above[0]
    return batch_of(NODES, *zip(*out))


def _sweep_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sweep rows that arrive by container, several small containers at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= SWEPT:
            rows = pa.Table.from_batches(held).combine_chunks()
            keys = [rows.column(c).to_numpy() for c in ("k1", "k2")]
            starts = np.flatnonzero((np.diff(keys[0]) != 0) | (np.diff(keys[1]) != 0)) + 1
            if len(starts):
                yield _sweep(rows.slice(0, int(starts[-1])))
                held = rows.slice(int(starts[-1])).to_batches()
    if held:
        yield _sweep(pa.Table.from_batches(held).combine_chunks())


def burst(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The heads below the root, and the turns of the remaining containers with the container's prefix (k1, k2)."""
    size = F.sum(F.col("n") - F.col("depth") + 1)
    heads = rows.groupBy("p1", "p2").agg(
        size.alias("size"), F.min("conv").alias("conv_id"), F.max("depth").alias("depth"), F.sum("weight").alias("n_convs"),
        F.max("chars").alias("chars"), F.max("q1").alias("q1"), F.max("q2").alias("q2"),
    )
    heads = cut_lineage(heads.where(F.col("size") > most).drop("size"))
    rest = rows.join(heads.select("p1", "p2"), ["p1", "p2"], "left_anti")
    # A suffix begins with the turn after its last head.
    top = rest.groupBy("conv").agg(F.min_by(F.struct("p1", "p2"), "depth").alias("top"))
    rest = rest.join(top, "conv").withColumns({"k1": F.col("top.p1"), "k2": F.col("top.p2")}).drop("top")
    return heads, rest


def _headed(heads: DataFrame, tops: DataFrame) -> DataFrame:
    """Heads with what is below them added up."""
    below = tops.groupBy("q1", "q2").agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"), F.count(F.lit(1)).alias("c"))
    inner = heads.where("depth > 0").groupBy("q1", "q2").agg(F.count(F.lit(1)).alias("hc"))
    counts = heads.join(below.withColumnsRenamed({"q1": "p1", "q2": "p2"}), ["p1", "p2"], "left")
    counts = counts.join(inner.withColumnsRenamed({"q1": "p1", "q2": "p2"}), ["p1", "p2"], "left").na.fill(0, ["l", "s", "c", "hc"])
    own = F.when((F.col("c") == 0) & (F.col("hc") == 0), 1).otherwise(F.col("l"))
    state = cut_lineage(
        counts.select(
            "p1", "p2", "conv_id", "depth", "n_convs", "q1", "q2", (F.col("c") + F.col("hc")).alias("n_children"), own.cast("long").alias("n_leaves"),
            (F.col("s") + (F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"), F.when(F.col("depth") > 0, F.struct("q1", "q2")).alias("far"),
        )
    )
    while not state.where("far IS NOT NULL").isEmpty():
        more = state.where("far IS NOT NULL").groupBy(F.col("far.q1").alias("p1"), F.col("far.q2").alias("p2"))
        more = more.agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        ahead = state.select(F.struct(F.col("p1").alias("q1"), F.col("p2").alias("q2")).alias("far"), F.col("far").alias("farther"))
        state = state.join(more, ["p1", "p2"], "left").join(ahead, "far", "left")
        sums = {"n_leaves": F.col("n_leaves") + F.coalesce("l", F.lit(0)), "saved_tokens": F.col("saved_tokens") + F.coalesce("s", F.lit(0))}
        state = cut_lineage(state.withColumns({**sums, "far": F.col("farther")}).drop("l", "s", "farther"))
    return state.drop("far")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (s1, s2, conv) rows to pieces of comma-joined ids."""
    schema = pa.schema([("s1", pa.int64()), ("s2", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
    for batch in batches:
        s1, s2, conv = (batch.column(c).to_numpy() for c in ("s1", "s2", "conv"))
        cut = np.ones(len(conv), bool)
        cut[1:] = (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])
        starts = np.flatnonzero(cut)
        starts = np.concatenate([np.arange(a, b, PIECE) for a, b in zip(starts, np.append(starts[1:], len(conv)))]) if len(starts) else starts
        ids = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(starts, np.append(starts[1:], len(conv)))]
        yield batch_of(schema, s1[starts], s2[starts], conv[starts], ids)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per run of pieces of the same sequence, the pieces in order."""
    schema = pa.schema([("s1", pa.int64()), ("s2", pa.int64()), ("digest", pa.string())])
    current, state = None, None
    for batch in batches:
        out = []
        for s1, s2, ids in zip(*(batch.column(c).to_pylist() for c in ("s1", "s2", "ids"))):
            if (s1, s2) == current:
                state.update(b"," + ids.encode())
                continue
            if current:
                out.append((*current, state.hexdigest()))
            current, state = (s1, s2), hashlib.sha256(ids.encode())
        if out:
            yield batch_of(schema, *zip(*out))
    if current:
        yield batch_of(schema, *[[x] for x in (*current, state.hexdigest())])


def end_digests(ends: DataFrame) -> DataFrame:
    """s1, s2 and the digest of the ascending, comma-joined ids of the conversations with this sequence."""
    ranged = ends.select("s1", "s2", "conv").repartitionByRange("s1", "s2", "conv").sortWithinPartitions("s1", "s2", "conv")
    pieces = ranged.mapInArrow(_pieces, "s1 long, s2 long, first long, ids string")
    pieces = pieces.repartition("s1", "s2").sortWithinPartitions("s1", "s2", "first")
    return pieces.mapInArrow(_digests, "s1 long, s2 long, digest string")


def prefix_trie(turns: DataFrame, convs: DataFrame, most: int = CONTAINER) -> DataFrame:
    """The nodes of the trie over ``turns`` (conv, depth from 1, t1, t2, chars) of all conversations ``convs`` (conv)."""
    rows, ends = sequences(turns, convs)
    heads, rest = burst(rows, most)
    dealt = rest.repartition("k1", "k2").sortWithinPartitions("k1", "k2")
    swept = cut_lineage(dealt.mapInArrow(_sweep_sorted, NODE_TYPE))
    zero = F.lit(0).cast("long")
    root = ends.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(*[zero.alias(c) for c in ("p1", "p2")], "conv_id", zero.alias("depth"), "n_convs", *[zero.alias(c) for c in ("chars", "q1", "q2")])
    headed = cut_lineage(_headed(heads.unionByName(root), swept.where("parent_conv_id IS NULL")))
    above = headed.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("above"))
    columns = [f.name for f in NODES]
    tops = swept.where("parent_conv_id IS NULL").unionByName(headed.withColumn("parent_conv_id", F.lit(None).cast("long")))
    tops = tops.join(above, ["q1", "q2"], "left").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("above"))).select(*columns)
    nodes = tops.unionByName(swept.where("parent_conv_id IS NOT NULL").select(*columns))
    digests = end_digests(ends).withColumnsRenamed({"s1": "p1", "s2": "p2"})
    nodes = nodes.join(digests, ["p1", "p2"], "left")
    return nodes.withColumn("ends_sha256", F.coalesce("digest", F.sha2(F.lit("").cast("binary"), 256))).drop("p1", "p2", "q1", "q2", "digest")


def conversation_trie(conversations: DataFrame, most: int = CONTAINER) -> DataFrame:
    """The trie of the conversations rebuilt on shared openings."""
    turns, convs = with_shared_openings(cut_lineage(ordered_turns(conversations)))
    return prefix_trie(turns, convs, most)
