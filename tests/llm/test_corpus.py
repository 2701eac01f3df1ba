"""Operators on the corpus against brute force and on rows that break things easily."""

import hashlib
import itertools
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seriesloom.llm import chunking, decontam, fingerprints, html_text, links, mixing, near_dup, pii, resampling, suffixes, toxicity
from seriesloom.llm.hashing import BASE, INVERSE

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RNG = np.random.default_rng(11)
LEXICON = ["".join(RNG.choice(list("abdeilmnorstuz"), RNG.integers(3, 9))) for _ in range(900)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(LEXICON, n)) + "."


def documents(spark, texts, first=0, source="s"):
    rows = [(first + i, t, "en", source, None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def odd(spark):
    """NULLs in every column, empty, blank, short and long texts, repeated rows, equal ids, clashing column names."""
    long = prose(30_000, 1)
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 4), (4, "word", "en", "a", 4), (5, long, "en", "b", len(long)),
        (6, prose(80, 2), "en", "b", 1), (6, prose(80, 2), "en", "b", 1), (7, prose(80, 3), "en", "b", 1), (7, prose(80, 4), "en", "c", 1),
        (None, prose(60, 5), "en", "c", 1), (None, None, None, None, None), (8, "é" * 5000, "fr", "ß", 5000), (9, "9" * 9000 + "@" + "+1" * 500, "fr", "", 1),
        (10, prose(80, 2) + " end", "en", "b", 1),
    ]
    df = spark.createDataFrame(rows, DOCS)
    extra = "node part key size start end digest kept rows component base proposed spans m bands n _row _id _text target".split()
    return df.withColumns({c: F.lit(c) for c in extra})


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def marks(spark):
    rows = [(6, 1, 0), (7, 1, 1), (7, 0, 0), (5, 1, 0), (8, 0, 1), (None, 1, 1), (4, None, None), (99, 1, 1), (99, 1, 1)]
    return labels(spark, rows)


def test_every_operator_takes_odd_rows(spark, odd, marks):
    bench = spark.createDataFrame([(1, prose(80, 3)[:120]), (2, None), (3, ""), (None, prose(30, 77))], "item_id long, text string")
    n = odd.count()
    mixed = mixing.mix(odd).toPandas()
    assert len(mixed) == n and (mixed.taken <= 2 * mixed["size"]).all() and (mixed[mixed["size"] == 0].taken == 0).all()
    assert pii.personal_data(odd).count() == n and pii.redact(odd).columns == odd.columns
    assert {r.doc_id for r in decontam.contaminated(odd, bench).collect()} == {7}
    assert decontam.decontaminate(odd, bench).columns == odd.columns
    assert chunking.repeated_spans(odd).count() > 0 and chunking.without_repeats(odd).count() == n
    cut = suffixes.repeated_bytes(odd).toPandas()
    assert len(cut) == n and (cut[cut.doc_id == 6].n_removed == cut[cut.doc_id == 6].n_bytes).all()
    scores = toxicity.toxicity(odd, marks).toPandas()
    assert len(scores) == n and scores.score.between(0, 1).all() and scores.held_out.notna().all()
    near = near_dup.near_duplicates(odd).toPandas()
    assert len(near) == n and set(near[near.doc_id.isin([6, 10])].component_id) == {6}
    assert near[near.doc_id.isna()].component_id.isna().all() and near.kept[near.doc_id != 10].all()
    kept = near_dup.one_of_each_group(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, -1, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    prints = fingerprints.compare_with_next(odd).toPandas()
    assert len(prints) == n and prints[["near_edited", "near_next"]].stack().between(0, 1).all()
    drawn = resampling.drawn(odd, marks)[0].toPandas()
    assert not set(drawn.doc_id) & {1, 2, 3}
    assert resampling.keep_drawn(odd, marks).columns == odd.columns


def test_every_operator_takes_empty_tables(spark, odd, none, marks):
    bench = spark.createDataFrame([], "item_id long, text string")
    unlabelled = marks.limit(0)
    empty = [
        mixing.mix(none), pii.personal_data(none), pii.redact(none), decontam.contaminated(none, bench), decontam.contaminated(odd, bench),
        chunking.repeated_spans(none), suffixes.repeated_bytes(none), toxicity.toxicity(none, unlabelled), near_dup.near_duplicates(none),
        near_dup.one_of_each_group(none), fingerprints.compare_with_next(none), resampling.drawn(none, unlabelled)[0],
        html_text.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")),
    ]
    assert [df.count() for df in empty] == [0] * len(empty)
    assert resampling.drawn(odd, unlabelled)[0].count() > 0
    assert toxicity.toxicity(odd, unlabelled).filter("score <> 0").count() == 0


def test_mix_targets_and_words(spark):
    rng = np.random.default_rng(4)
    rows = [(i, prose(int(rng.integers(0, 60)), i) if i % 9 else None, "en", s, 0) for i, s in enumerate(rng.choice(["a", "b", "c", None], 300, p=[0.7, 0.15, 0.1, 0.05]))]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs).toPandas()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    assert dict(zip(got.doc_id, got["size"])) == size
    sources = sorted({r[3] for r in rows if r[3]}) + [None]
    total = {s: sum(size[r[0]] for r in rows if r[3] == s) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    target, left, free = {}, 1.5 * sum(total.values()), set(sources)
    while True:  # share out, stop those above their limit, share the excess again
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * total[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
        free -= over
    for s in sources:
        part = got[got.source.isna() if s is None else got.source == s]
        assert (part.source_size == total[s]).all() and np.allclose(part.target, target[s])
        assert abs(part.taken.sum() - target[s]) <= 3
    assert (got.taken <= 2 * got["size"]).all()
    again = mixing.mix(docs.repartition(7)).toPandas()
    assert dict(zip(got.doc_id, got.taken)) == dict(zip(again.doc_id, again.taken))


@pytest.mark.parametrize("seed", range(20))
def test_knapsack_comes_as_near_as_possible(seed):
    rng = np.random.default_rng(seed)
    lengths = np.sort(rng.choice(np.arange(1, 40), 4, replace=False))
    counts = rng.integers(1, 4, 4)
    budget = int(rng.integers(0, (lengths * counts).sum() + 1))
    take = mixing.fit_counts(lengths, counts, budget, dp_words=10**6)
    assert ((0 <= take) & (take <= counts)).all()
    floor = np.array([int(n) * budget // int((lengths * counts).sum()) for n in counts])
    sums = {int((np.array(c) * lengths).sum()) for c in itertools.product(*[range(f, n + 1) for f, n in zip(floor, counts)])}
    assert abs(int((take * lengths).sum()) - budget) == min(abs(s - budget) for s in sums)


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    spans = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True,
                    "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                spans.append(f"{kind}:{m.start()}:{m.end()}")
    return spans


def test_base_spans_equal_the_expressions(spark):
    rng = np.random.default_rng(8)
    made = ["".join(rng.choice(list("01239 .-+()@aé_b%"), rng.integers(1, 70))) for _ in range(400)]
    made += ["1-2.3.4.5.6.7", "a@b.c_x@d.e x@y@d.e", "300.1.2.3.4 1.2.3.4.5.6.7.8", "001.002.003.0255", "4111 1111 1111 1111-4111-1111-1111-1111",
             "x +1 (017) 555-7713 y", "+12+34 567 890 12 3(", "", None, "é a.b@c.de 4111111111111111 ü 10.0.0.1"]
    got = pii.personal_data(documents(spark, made)).toPandas().set_index("doc_id")
    for i, text in enumerate(made):
        spans = base_spans(text)
        assert got.base_sha256[i] == hashlib.sha256(",".join(spans).encode()).hexdigest(), (text, spans, got.spans[i])
        assert set(spans) <= set(got.spans[i].split(",")) | {""}
        assert [got[f"n_{k}"][i] for k in PATTERNS] == [sum(s.startswith(k) for s in spans) for k in PATTERNS]


def test_votes_add_spans_and_spans_are_masked(spark):
    texts = [f"{prose(9, i)} call +49 30 5550{i:04d} or mail a{i}@site.org today" for i in range(40)]
    texts += ["please call 030 555 0199 today", "my mail: jo [at] site [dot] org", "version 3.0 of 2020", prose(20, 99)]
    docs = documents(spark, texts)
    got = pii.personal_data(docs).toPandas().set_index("doc_id")
    assert got.spans[40] == "phone:12:24" and got.spans[41].startswith("email:9:") and got.spans[42] == got.spans[43] == ""
    clean = pii.redact(docs).toPandas().set_index("doc_id")
    assert "@" not in " ".join(clean.text) and "555" not in " ".join(clean.text)
    assert clean.text[40] == "please call <PHONE> today" and clean.n_chars[40] == len(clean.text[40])
    assert clean.text[43] == texts[43] and clean.n_chars[43] == len(texts[43])


def test_benchmark_passages_and_paraphrases_are_found(spark, monkeypatch):
    items = [prose(30, 1000 + i) for i in range(12)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [prose(300, i) for i in range(60)]
    for i in range(0, 24, 2):
        words = items[i // 2].rstrip(".").split()
        if i % 4:  # a paraphrase: every sixth word exchanged, one dropped, one inserted
            words = ["other" if k % 6 == 3 else w for k, w in enumerate(words)]
            words = words[:10] + ["new"] + words[11:]
        texts[i] = prose(100, 500 + i) + " " + " ".join(words).upper() + ", " + prose(100, 700 + i)
    docs = documents(spark, texts)
    expected = {(i, i // 2) for i in range(0, 24, 2)}
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()} == expected
    assert {r.doc_id for r in decontam.decontaminate(docs, bench).collect()} == set(range(60)) - {i for i, _ in expected}
    monkeypatch.setattr(decontam, "ITEMS", 5)
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()} == expected


@pytest.mark.parametrize("size", [12, 300])
def test_an_item_copied_into_a_third_of_the_documents_is_found(spark, size):
    items = [prose(30, 1100 + i) for i in range(6)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [prose(size, i) + (" " + items[2] if i % 3 == 0 else "") for i in range(180)]
    got = decontam.contaminated(documents(spark, texts), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, 2) for i in range(0, 180, 3)}


def test_projected_passages_equal_sums_of_their_words():
    rng = np.random.default_rng(8)
    first = np.concatenate([[0], np.cumsum([5, 0, 16, 17, 32, 33, 48, 70, 1])])
    at, weight = rng.integers(-1, 9, first[-1]), rng.random(first[-1], np.float32)
    basis = rng.standard_normal((9, 4)).astype(np.float32)
    start, end, _ = decontam.passages(first)
    got = decontam.projected(start, end, np.flatnonzero(at >= 0), at, weight, basis)
    for vector, a, b in zip(got, start, end):
        assert np.allclose(vector, sum(weight[k] * basis[at[k]] for k in range(a, b) if at[k] >= 0), atol=1e-5)


def test_common_subsequence():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = rng.integers(0, 6, rng.integers(1, 30)), rng.integers(0, 6, rng.integers(1, 40))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert decontam.common_length(a, b) == table[-1, -1]


def test_shifted_passages_are_repeats(spark):
    passage = prose(60, 42)
    texts = [prose(200, i) for i in range(30)]
    for i in (3, 9, 17):
        texts[i] = prose(50 + i, 900 + i) + " " + passage + " " + prose(40, 950 + i)
    docs = documents(spark, texts)
    spans = chunking.repeated_spans(docs).toPandas()
    assert set(spans.doc_id) == {9, 17} and all(list(k) == [3] for k in spans.kept_doc_ids)
    for r in spans.itertuples():
        assert texts[r.doc_id].encode()[r.span_start : r.span_end] in passage.encode()
        assert r.span_end - r.span_start > 0.6 * len(passage)
    left = {r.doc_id: r.text for r in chunking.without_repeats(docs).collect()}
    assert left[3] == texts[3] and len(left[9]) < len(texts[9]) - 200


def test_gear_cuts_depend_on_the_window_only():
    data = RNG.integers(0, 256, 5000).astype(np.uint8)
    value = 0
    cuts = []
    for i, byte in enumerate(data):
        value = sum(int(chunking.GEAR[data[i - k]]) << k for k in range(min(i + 1, chunking.WINDOW))) % 2**32
        if value >> (32 - chunking.CUT_BITS) == 0:
            cuts.append(i + 1)
    assert cuts == chunking.gear_cuts(data).tolist()
    ends = chunking.chunk_ends(cuts, 0, 5000)
    sizes = np.diff([0, *ends])
    assert ends[-1] == 5000 and sizes.max() <= chunking.MOST_BYTES and sizes[:-1].min() >= chunking.LEAST_BYTES


def test_repeated_bytes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 4000)
    shared, rng = prose(80, 7), np.random.default_rng(2)
    texts = [prose(60, i) for i in range(20)] + ["ab" * 300, "x" * 199, "y" * 200, "y" * 200, shared[:199], "é" * 150, None, ""]
    texts += [prose(int(rng.integers(5, 40)), 100 + i) + shared[int(rng.integers(0, 90)) : int(rng.integers(260, 400))] + prose(9, 200 + i) for i in range(25)]
    texts += [texts[3], texts[4][:-7] + "changed", texts[5] + texts[5]]
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for t, i in ((t, i) for t in raw for i in range(len(t) - 199)):
        seen[t[i : i + 200]] = seen.get(t[i : i + 200], 0) + 1
    got = suffixes.repeated_bytes(documents(spark, texts)).toPandas().set_index("doc_id")
    for d, t in enumerate(raw):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(t) else 0
        kept = bytes(b for b, g in zip(t, gone) if not g)
        assert tuple(got.loc[d]) == (len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()), d


def test_cover_has_every_difference():
    differences = {(int(a) - int(b)) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER}
    assert differences == set(range(suffixes.PERIOD))
    assert BASE * INVERSE % 2**64 == 1


def test_toxicity_on_held_out_rows(spark):
    import zlib

    rng = np.random.default_rng(6)
    insults = ["grobba", "grobbo", "grobbix", "snarfel", "snarfix", "snarfo"]
    texts, toxic = [], []
    for i in range(600):
        words = prose(60, 3000 + i).split()
        toxic.append(int(rng.random() < 0.3))
        for _ in range(4 * toxic[-1]):
            words[int(rng.integers(0, len(words)))] = str(rng.choice(insults))
        texts.append(" ".join(words))
    docs = documents(spark, texts)
    got = toxicity.toxicity(docs, labels(spark, [(i, 1, t) for i, t in enumerate(toxic)])).toPandas().set_index("doc_id").sort_index()
    held = np.array([zlib.crc32(str(i).encode()) % 3 == 1 for i in range(600)])
    assert (got.held_out.to_numpy() == held).all()
    assert (got.predicted.to_numpy()[held] == np.array(toxic)[held]).mean() > 0.97
    flipped = labels(spark, [(i, 1, 1 - t if held[i] else t) for i, t in enumerate(toxic)])
    again = toxicity.toxicity(docs, flipped).toPandas().set_index("doc_id").sort_index()
    assert np.allclose(again.score, got.score)


def test_toxicity_models_keep_every_counted_gram(spark):
    import zlib
    from collections import Counter

    ids = np.arange(400)
    ids = ids[toxicity.scramble(ids.view(np.uint64), 31) % np.uint64(5) != 0]
    ids = [int(i) for i in ids if zlib.crc32(str(i).encode()) % 3 != 1][:60]
    letters = np.random.default_rng(12).choice(list("abcdefghijklmnopqrstuvwxyz"), (30, 1500, 10))
    texts = [" ".join(map("".join, part)) for part in letters] * 2
    toxic = [k % 3 == 0 for k in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in zip(ids, texts)], DOCS)
    model = toxicity.fit(docs, labels(spark, [(i, 1, int(t)) for i, t in zip(ids, toxic)]))
    counts = Counter()
    for text, kind in zip(texts, toxic):
        for word in set(text.split()):
            edged = f" {word} "
            counts.update((edged[max(0, k - toxicity.ORDER + 1) : k], edged[k], kind) for k in range(1, len(edged)))
    both = Counter()
    for (context, byte, _), n in counts.items():
        both[context, byte] += n
    kept = {key: n for key, n in both.items() if n > 1}
    assert len(model.gram) == len(kept) > 1 << 18
    assert model.gram_n.sum(0).tolist() == [sum(n for (c, b, k), n in counts.items() if k == kind and (c, b) in kept) for kind in (0, 1)]
    assert len(model.context) == len({context for context, _ in kept}) and (np.diff(model.gram.astype(object)) > 0).all()
    assert np.allclose(model.context_n[:, :2].sum(0), model.gram_n.sum(0)) and (model.context_n[:, 2:].sum(0) == (model.gram_n > 0).sum(0)).all()


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_brute_force(spark, size):
    rng = np.random.default_rng(9)
    texts = [prose(int(n), i) for i, n in enumerate(rng.integers(1, 90, 40))]
    for base in range(12):
        for _ in range(8):
            words = texts[base].split()
            for k in rng.integers(0, len(words), rng.integers(0, 1 + len(words) // 12)):
                words[k] = str(rng.choice(LEXICON))
            texts.append(" ".join(words).upper() if rng.random() < 0.3 else " ".join(words))
    texts += ["É x", "é x", "one", "ONE", "one two", "", None, "   "]
    sets = [shingles(t, size) for t in texts]
    parent = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            low, high = sorted((min(parent[a], parent[b]), max(parent[a], parent[b])))
            parent = [low if p == high else p for p in parent]
    got = near_dup.near_duplicates(documents(spark, texts), size).toPandas().set_index("doc_id").sort_index()
    assert got.n_shingles.tolist() == [len(s) for s in sets]
    assert got.component_id.tolist() == parent
    assert got.kept.tolist() == [p == i for i, p in enumerate(parent)]


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 1), (20, 21), (5, 5), *[(100 + i, 101 + i) for i in range(40)]]
    found = {r.node: r.component for r in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {n for n, c in found.items() if c == 1} == {1, 2, 3, 6, 7, 8, 9} and found[21] == 20
    assert all(found[100 + i] == 100 for i in range(41))


def test_fingerprints_and_edits(spark):
    texts = ["\n".join(prose(12, 50 * i + k) for k in range(1 + i % 9)) for i in range(30)] + [None, "", "éß\nx", "éß\nx"]
    docs = documents(spark, texts)
    got = fingerprints.compare_with_next(docs.repartition(5)).toPandas().set_index("doc_id").sort_index()
    for i, text in enumerate(texts):
        text, other = text or "", texts[(i + 1) % len(texts)] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        assert got.n_chars[i] == len(text) and got.edited_sha256[i] == hashlib.sha256(edited.encode()).hexdigest()
        assert got.fingerprint[i] == fingerprints.as_text(fingerprints.fingerprint(text))
        assert got.edited_fingerprint[i] == fingerprints.as_text(fingerprints.fingerprint(edited))
    many = got[got.n_chars > 300]
    assert (many.near_edited > many.near_next).mean() > 0.95
    one, two = prose(9, 1) + "\n" + prose(9, 2), prose(9, 3)
    whole = fingerprints.fingerprint(one + "\n" + two)
    assert (fingerprints.fingerprint(two + "\n" + "\n".join(reversed(one.split("\n")))) == whole).all()
    assert (fingerprints.combine(whole, fingerprints.fingerprint(two), -1) == fingerprints.fingerprint(one)).all()


def test_resampling_keeps_prose_and_drops_junk(spark):
    good = [prose(80, i) for i in range(300)]
    junk = [" ".join(w + "%%%" for w in prose(80, 400 + i).split()) for i in range(40)]
    junk += [" | ".join(prose(80, 500 + i).split()) for i in range(40)] + [(LEXICON[i] + " ") * 90 for i in range(40)]
    docs = documents(spark, good + junk)
    marked = labels(spark, [(i, int(i < 300), 0) for i in range(0, 420, 2)])
    found, _, _ = resampling.drawn(docs, marked)
    ids = {r.doc_id for r in found.collect()}
    assert len(ids & set(range(300))) >= 297 and len(ids - set(range(300))) <= 3
    assert {r.doc_id for r in resampling.keep_drawn(docs, marked).collect()} == ids
    assert resampling.drawn(docs, marked, k=50)[0].count() == 50


def test_kth_largest(spark):
    values = np.round(np.random.default_rng(1).normal(size=3000), 2)
    df = spark.createDataFrame([(float(v),) for v in values], "key double")
    for k in (1, 2, 777, 3000):
        assert resampling.kth_largest(df, k) == np.sort(values)[-k]


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("<nav>a</nav>", ""), ("plain &lt;b", "plain <b"), ("<p>a<b>c</b>d</p", "acd"),
        ("<body><nav><li>m<li>n</nav><article><h1>T &amp; U</h1><p>a  b\n<p>c</article><footer>f</footer>", "T & U a b c"),
        ("<article><p>one<aside>side</aside><form>f<input></form><p>two<script>if(a<b){'</p>'}</script></article><div id=comments><p>" + "x " * 99 + "</div>", "one two"),
        ("<ul class='menu'><li>1<li>2<li>3</ul><div><h1>T</h1><p>long text here</p><div class=ad><p>x<p>x<p>x<p>x</div><p>more long text</p></div>", "T long text here more long text"),
        ("<div class='cookie-notice'>We use</div><style>p{}</style><!-- <p>no</p> --><p>yes &#233;&nbsp;&#x41;</p>", "yes é A"),
        ("<header>Site</header><main><article><header><h1>Head</h1></header><p>body</p><div class='share-buttons'>s</div></article></main>", "Head body"),
        ("<div class='content has-sidebar'><h1>T</h1><p>body</p></div><footer><p>f f f f f f f f f f</footer>", "T body"),
        ("<form action=x><nav>m</nav><h1>T</h1><p>body</p><div class=comments>" + "c " * 99 + "</div></form>", "T body"),
        ("<div class='sidebar-layout'><article><p>body</p></article></div><div class=related><article>" + "r " * 9 + "</article></div>", "body"),
        ("<div class='menu-page'><h1>T</h1><p>body</p><div class=footer>f</div></div>", "T body"),
        ("<body><h1>Head</h1><div class=ad>x</div><div class=ad>y</div><div class=ad>z</div><p>" + "b " * 99 + "</p><p>c</p>", "Head " + "b " * 99 + "c"),
        ("<div><div><a>Home</a></div><div><a>You</a></div><div><a>We</a></div></div><div><h1>T</h1><div>body <a>link</a> on</div></div>", "T body link on"),
        ("<footer><p>only</footer><aside>these</aside>", ""), ("<div class=sidebar>" + "s " * 99 + "</div><p>body</p>", "body"),
        ("<div class=menu><b>" * 20_000 + "x" * 50, ""), ("<div>" * 50_000 + "body" + "</div>" * 50_000, "body"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_pages_keep_their_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a é</p>"), (None, None, None), (1, "u", "<p>a é</p>")], "page_id long, url string, html string")
    rows = html_text.extract_pages(pages.withColumn("text", F.lit("clash"))).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in rows) == [(0, "", 0), (1, "a é", 3), (1, "a é", 3)]


def test_pipeline_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "MinHash near-dedup", "benchmark decontamination", "PII", "mixing sources to target weights",
    ]
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, folder))
        assert docs.columns == columns
        seen.append(docs.count())
    assert seen[0] > seen[1] > seen[2] >= seen[3] == seen[4]
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert 0 < mixed.count() <= seen[-1] and mixed.filter("copies < 1").count() == 0
