"""Conversation trie, periodic word runs and byte-level BPE against brute force and the public library."""

import hashlib
import random
import re
import struct
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from seriesloom.llm import byte_bpe, prefix_trie, queries, word_runs

EXTRA = "block words conv pos n key k1 p1 t1 depth weight number word runs ids h g w a p".split()


def sha(data):
    return hashlib.sha256(data).hexdigest()


# Trie


def trie_by_hand(rows):
    """{(smallest member, depth): other columns} of the trie over rebuilt conversations."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v, key=lambda t: t[:2])] for c, v in turns.items()}
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(turns.get(c - c % 100, [])[:h] + turns[c][h:])
    members, children = defaultdict(list), defaultdict(set)
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
            if d:
                children[s[: d - 1]].add(s[:d])
    leaves, saved, out = {}, {}, {}
    for s in sorted(members, key=len, reverse=True):
        leaves[s] = sum(leaves[k] for k in children[s]) or 1
        saved[s] = sum(saved[k] for k in children[s]) + ((len(members[s]) - 1) * len(s[-1][1]) if s else 0)
        ends = sha(",".join(map(str, sorted(c for c in members[s] if rebuilt[c] == s))).encode())
        above = min(members[s[:-1]]) if s else None
        out[min(members[s]), len(s)] = (above, len(members[s]), len(children[s]), leaves[s], saved[s], ends)
    return out


def trie_of(df, **parameters):
    columns = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    got = prefix_trie.conversation_trie(df, **parameters).select(*columns).collect()
    found = {(r.conv_id, r.depth): tuple(r)[2:] for r in got}
    assert len(found) == len(got)
    return found


def conversations(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.withColumns({c: F.lit(c) for c in EXTRA})


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(3)
    rows = [(None, 0, "user", "nobody"), (7, None, None, "first"), (7, 0, "user", None), (300, 4, "user", ""), (301, 0, None, None)]
    for c in [*range(0, 60), *range(100, 140), *range(205, 240)]:
        size = rng.choice([1, 1, 2, 3, 5, 7, 9])
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "é", "bb", "same"]) * (t + 1)) for t in range(size)]
    for c in range(400, 440):  # a group of copies
        rows += [(c, t, "user", f"copy {t}") for t in range(8)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("most", [1, 7, 10**6])
def test_trie_equals_brute_force(spark, talks, most):
    assert trie_of(conversations(spark, talks), most=most) == trie_by_hand(talks)


def test_trie_of_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rows = [(c, t, "user", str(t if t < 90 - c % 4 else -t)) for c in range(8) for t in range(120)] + [(100, t, None, "x") for t in range(200)]
    for most in (50, 500):
        assert trie_of(conversations(spark, rows), most=most) == trie_by_hand(rows)


def test_trie_of_repeated_turns_and_nothing(spark):
    rows = [(100, 0, "u", "x"), (100, 0, "u", "x"), (100, 0, "u", "x")]
    assert trie_of(conversations(spark, rows)) == trie_by_hand(rows)
    assert trie_of(conversations(spark, rows).limit(0)) == {}
    assert trie_of(conversations(spark, [(None, 1, "u", "x")])) == {}


# Runs


def runs_by_hand(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((b, e - b, q) for (b, e), q in found.items())


def periodic_words(rng):
    letters, words = [str(x) for x in range(rng.choice([1, 2, 3, 50]))], []
    for _ in range(rng.randint(0, 6)):
        unit = [rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 5, 14, 15, 16, 17, 23, 31, 32, 33, 63, 64, 65, 90]))]
        size = rng.randint(1, int(len(unit) * rng.choice([1, 4.2, 5, 9])) + 3)
        words += (unit * (size // len(unit) + 1))[:size] + [rng.choice([*letters, "é", "y"]) for _ in range(rng.choice([0, 0, 9, 30]))]
    return words[:60] * 6 if rng.random() < 0.2 else words


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = [periodic_words(rng) for _ in range(150)]
    rows = [(i, rng.choice([" ", "\n", " \t "]).join(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in EXTRA})
    for r in word_runs.word_runs(docs).collect():
        runs = runs_by_hand(texts[r.doc_id])
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert [tuple(x) for x in r.runs] == runs
        assert r.collapsed == " ".join(w for i, w in enumerate(texts[r.doc_id]) if i not in gone)


def test_a_word_ends_only_at_ascii_space(spark):
    docs = spark.createDataFrame([(1, "a b " * 6), (2, "a a " * 5), (3, "x " * 200_000), (4, "\x00 " * 7)], "doc_id long, text string")
    found = {r.doc_id: ([tuple(x) for x in r.runs], r.collapsed) for r in word_runs.word_runs(docs).collect()}
    assert found == {1: ([(0, 6, 1)], "a b"), 2: ([], " ".join(["a a"] * 5)), 3: ([(0, 200_000, 1)], "x"), 4: ([(0, 7, 1)], "\x00")}


def test_runs_query(spark, tmp_path):
    rng = random.Random(8)
    texts = [" ".join(periodic_words(rng)) for _ in range(120)] + [None, "", " \n ", "x", "a b a b a b a b c c c c c c"]
    rows = [*enumerate(texts), (None, "n n n n n n n"), (3, texts[3])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(i).encode()), len(words)
        if i is not None and h % 10 == 0 and n:
            a, p = h // 10 % n, 1 + (n - h // 10 % n) // (3 + h // 10 % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = runs_by_hand(words)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        milli = 1000 * best[1] // best[2] if runs else None
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        want.append((i, len(runs), *best, milli, sha(lines.encode()), sha(" ".join(w for k, w in enumerate(words) if k not in gone).encode())))
    got = [tuple(r) for r in queries.QUERIES["op12_word_runs"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_runs_of_nothing(spark):
    assert word_runs.word_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# Byte-level BPE


@pytest.fixture(scope="module")
def coder():
    ranks, pattern = byte_bpe.vocabulary()
    return ranks, pattern, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    None, "", " ", "word", "It's 12345 o'clock, they'LL say  'sdog ... \n\n\t  end  ", "a" * 5_000, " " * 3_000 + "x", "é" * 900 + "語" * 400 + "🙂👩‍👩‍👧" * 30,
    "<|endoftext|> and <|endoftext|>", "\x00\x01\r\n ", "abcdefghij" * 100, "the the the of of and",
]


def test_encoding_equals_the_library(spark, coder):
    ranks, pattern, library = coder
    rng = np.random.default_rng(2)
    mixed = ["".join(rng.choice([*"aeinrst' .,\n0é語", "tion", " the", "'s"], int(rng.integers(1, 300)))) for _ in range(200)]
    rows = [*enumerate(TEXTS + mixed), (None, "no id"), (3, "word")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in EXTRA}).repartition(3)
    want = sorted(((i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows), key=repr)
    for limits in ({}, {"most_words": 20, "most_places": 300}):
        back = byte_bpe.decode(byte_bpe.encode(docs, ranks, pattern, **limits), ranks)
        got = [(r.doc_id, list(r.l), bytes(r.decoded)) for r in back.withColumn("l", byte_bpe.id_list(F.col("ids"))).collect()]
        assert sorted(got, key=repr) == want
    left = {r.name for r in spark.catalog.listTables()}
    assert not [name for name in left if name.startswith("blocks_")]


def test_both_ways_of_merging_agree(coder):
    ranks, _, library = coder
    rng = random.Random(5)
    for _ in range(300):
        piece = "".join(rng.choice("abeinrst0é") for _ in range(rng.randint(2, 190))).encode()
        assert byte_bpe.encode_piece(piece, ranks) == (byte_bpe._merged_by_heap(piece, ranks) if piece not in ranks else [ranks[piece]])


def test_query_digests_and_empty_table(spark, coder, tmp_path):
    ranks, pattern, library = coder
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op13_byte_bpe"](spark, str(tmp_path)).collect()}
    for i, text in enumerate(TEXTS):
        ids = library.encode_ordinary(text or "")
        assert got[i] == (len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha((text or "").encode()))
    none = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.decode(byte_bpe.encode(none, ranks, pattern), ranks).count() == 0


def test_numbers_survive_packing():
    numbers = np.array([0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28 - 1])
    assert (byte_bpe.unpacked_numbers(byte_bpe.packed_numbers(numbers)[0]) == numbers).all()


def test_unknown_ids_fail(coder):
    with pytest.raises(ValueError, match="vocabulary"):
        byte_bpe.TokenBytes(coder[0]).decode(np.array([70_000]), np.array([0, 1]))
