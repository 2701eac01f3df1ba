"""Personal data by weak supervision, in DataFrame functions only.

Base spans come from four fixed expressions (email, ip, card, phone) and always
count. Wider expressions propose further spans of these kinds. Five labelers vote
yes, no or nothing on every proposal and every base span: the strict expression, a
structure check, a gazetteer, the words before it and the characters beside it.
Expectation-maximisation over the counts of vote patterns estimates how reliable
each labeler is. The resulting probabilities train the span classifier, a naive
Bayes model of the span's own features, and spans it finds likely are added unless
they overlap a base span or a likelier one.

Only counts leave the tasks: of vote patterns (at most 4 * 3**5) and of feature
values (hashed to FEATURE_VALUES). Positions are code points, ends exclusive.

Defined results: a NULL text is empty and has no spans; repeated rows have their own
equal rows; without proposals nothing is learned or added; other columns are not
read, or kept as they are by ``redact``; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.tables import packed, unpacked
from seriesloom.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")

# Base expressions, written with possessive repetition: no repeated part can give back what its successor could use, so
# matches are the same and time stays linear. An email or address that does not start its run of letters or digits, and
# does not follow a match, would have matched earlier.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PROPOSED = {
    "email": r"[A-Za-z0-9._%+-]++\x20?(?:@|\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\[dot\]|\(dot\))\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?:[0-9]{4}[\x20-]?){3}[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?:[\x20.-][0-9]{2,4})?(?![0-9])",
}
# Top-level domains, address blocks of documentation and private use, issuer prefixes, calling codes.
GAZETTEER = {
    "email": r"(?i)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|us|ch|at|it|nl|pl|br|in|cn|jp)$",
    "ip": r"^(?:(?!0\.|127\.|255\.)[0-9]+\..*|[0-9A-Fa-f]+:.*)$",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^(?:\+\s?(?:1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|0|\()",
}
# Words before a span that speak for its kind, and words that speak against personal data.
CONTEXT = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|address|correo|courriel)\W*$",
    "ip": r"(?i)(?:\bip|address|server|host|from|adresse|servidor)\W*$",
    "card": r"(?i)(?:card|visa|master\w*|credit|karte|carte|tarjeta|payment)\W*$",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|telefon|telephone|tel\w*fono)\W*$",
}
AGAINST = r"(?i)(?:version|release|license|token|key|order|invoice|isbn|issn|build|hash|=|#)\W*$"

LABELERS = 5
FEATURE_VALUES = 64
STEPS = 10  # of expectation-maximisation
LIKELY = 0.5
NEAR = 24  # characters of context


def digits_of(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    both = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.try_cast("int") + 1)),
    )
    return F.aggregate(both, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def passes(kind: str, span: Column) -> Column:
    """The further condition on a match of a base expression."""
    n = F.length(digits_of(span))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(span, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(
            F.split(span, r"\."), lambda p: F.coalesce(F.substring(F.regexp_replace(p, "^0+", ""), 1, 3).try_cast("int"), F.lit(0)) <= 255
        )
    if kind == "card":
        return n.between(13, 19) & luhn(digits_of(span))
    return n.between(9, 15)


def located(df: DataFrame, text: str, pattern: str, name: str, kind: int) -> DataFrame:
    """Add ``name``: every match with kind, start, end, the text before it and the character after it.

    What the expression splits off lies between the matches, so running lengths
    give the positions. Texts without a match are not split.
    """
    found, between = f"_{name}_m", f"_{name}_b"
    # Both columns are used twice, which keeps them from being computed inside the lambda.
    df = df.withColumn(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    df = df.withColumn(between, F.when(F.size(found) > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>")))
    zipped = F.zip_with(
        F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, b: F.struct(m.alias("m"), b.alias("b"))),
        F.slice(between, 2, F.size(found)),
        lambda mb, a: F.struct(mb["m"].alias("m"), mb["b"].alias("b"), a.alias("a")),
    )
    element = "struct<kind:int,start:bigint,end:bigint,span:string,before:string,after:string>"
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{element}>").alias("out"))

    def step(acc: Column, z: Column) -> Column:
        m, b, a = z["m"], z["b"], z["a"]
        begin = acc["at"] + F.length(b)
        end = begin + F.length(m)
        one = F.struct(
            F.lit(kind).alias("kind"), begin.cast("bigint").alias("start"), end.cast("bigint").alias("end"), m.alias("span"),
            F.right(b, F.lit(NEAR)).alias("before"), F.left(a, F.lit(1)).alias("after"),
        )
        return F.struct(end.cast("bigint").alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    spans = F.aggregate(zipped, start, step, lambda acc: acc["out"])
    return df.withColumn(name, F.when(F.size(found) > 0, spans).otherwise(F.array().cast(f"array<{element}>"))).drop(found, between)


def with_candidates(docs: DataFrame) -> DataFrame:
    """Add ``base`` and ``proposed``: arrays of spans by kind, then start; proposals do not overlap base spans."""
    rows = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    for k, kind in enumerate(KINDS):
        rows = located(rows, "_text", BASE[kind], f"_base{k}", k)
        rows = located(rows, "_text", PROPOSED[kind], f"_more{k}", k)

    def good(k: int) -> Column:
        return F.filter(f"_base{k}", lambda s: passes(KINDS[k], s["span"]))

    rows = rows.withColumn("base", F.concat(*map(good, range(len(KINDS)))))
    more = F.concat(*[F.col(f"_more{k}") for k in range(len(KINDS))])
    apart = F.filter(more, lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    rows = rows.withColumn("proposed", apart)
    return rows.drop("_text", *[f"_{n}{k}" for n in ("base", "more") for k in range(len(KINDS))])


def by_kind(kind: Column, choose: Callable[[str], Column]) -> Column:
    return F.coalesce(*[F.when(kind == k, choose(name)) for k, name in enumerate(KINDS)])


def votes(span: Column, strict: Column) -> Column:
    """The labelers' votes: 1 yes, 2 no, 0 nothing."""
    digits = digits_of(span["span"])

    def vote(yes: Column, no: Column) -> Column:
        return F.when(yes, 1).when(no, 2).otherwise(0)

    structure = {
        "email": F.when(span["span"].rlike(r"[A-Za-z0-9]\x20?(?:@|\[at\]|\(at\))\x20?[A-Za-z0-9]"), 1).otherwise(2),
        "ip": vote(span["span"].rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$|:"), F.lit(True)),
        "card": vote(luhn(digits), F.lit(True)),
        "phone": vote(F.length(digits).between(9, 15), F.lit(True)),
    }
    beside = F.concat(F.right(span["before"], F.lit(1)), F.lit("|"), span["after"])
    return F.array(
        F.when(strict, 1).otherwise(0),
        by_kind(span["kind"], lambda name: structure[name]),
        by_kind(span["kind"], lambda name: F.when(span["span"].rlike(GAZETTEER[name]), 1).otherwise(2)),
        vote(by_kind(span["kind"], lambda name: span["before"].rlike(CONTEXT[name])), span["before"].rlike(AGAINST)),
        vote(~beside.rlike(r"[\p{L}\p{N}_]"), F.lit(True)),
    )


def features(span: Column) -> Column:
    """The span's own features, one hashed value each."""
    shape = F.regexp_replace(F.regexp_replace(span["span"], "[0-9]", "9"), "[A-Za-z]+", "w")
    word = F.regexp_extract(span["before"], r"(\S+)\s*$", 1)
    values = (
        shape,
        F.length(digits_of(span["span"])).cast("string"),
        F.concat(F.right(span["before"], F.lit(1)), F.lit("|"), span["after"]),
        F.regexp_replace(F.regexp_replace(F.lower(word), r"\p{L}", "a"), "a+", "a"),
        F.left(digits_of(span["span"]), F.lit(1)),
    )
    hashed = [F.pmod(F.xxhash64(v), F.lit(FEATURE_VALUES)).cast("int") + F.lit(i * FEATURE_VALUES) for i, v in enumerate(values)]
    return F.array(*hashed)


def reliabilities(spans: DataFrame) -> DataFrame:
    """Vote patterns with the probability that a span with them is personal data, per kind.

    Each step re-estimates, from the counts, the share of true spans and how often
    every labeler gives each vote on true and on other spans. Three pseudo-counts
    say that labelers are more often right than wrong.
    """
    patterns = cut_lineage(spans.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n"))).coalesce(1)  # at most 4 * 3**5 rows
    yes = F.aggregate("votes", F.lit(0), lambda a, v: a + (v == 1).cast("int"))
    no = F.aggregate("votes", F.lit(0), lambda a, v: a + (v == 2).cast("int"))
    p = (yes + 1) / (yes + no + 2)
    for _ in range(STEPS):
        judged, p = patterns.withColumn("p", p), F.col("p")
        sums = {"m": F.sum(F.col("n") * p), "r": F.sum(F.col("n") * (1 - p))}
        for j in range(LABELERS):
            for v in (0, 1, 2):
                hit = (F.element_at("votes", j + 1) == v).cast("int") * F.col("n")
                sums[f"t{j}{v}"], sums[f"f{j}{v}"] = F.sum(hit * p), F.sum(hit * (1 - p))
        rows = judged.groupBy("kind").agg(*[c.alias(a) for a, c in sums.items()]).collect()  # a row per kind
        right, wrong = (1.0, 2.0, 0.3), (1.0, 0.3, 2.0)
        tables = {}
        for row in rows:
            odds = [math.log((row["m"] + 1) / (row["r"] + 1))]
            for j in range(LABELERS):
                for v in (0, 1, 2):
                    t = (row[f"t{j}{v}"] + right[v]) / (row["m"] + sum(right))
                    f = (row[f"f{j}{v}"] + wrong[v]) / (row["r"] + sum(wrong))
                    odds.append(math.log(t / f))
            tables[row["kind"]] = odds
        p = posterior(tables)
    return patterns.withColumn("p", p) if rows else patterns.withColumn("p", F.lit(0.5))


def posterior(tables: dict[int, list[float]]) -> Column:
    odds = F.lit(0.0)
    for kind, table in tables.items():
        cells = F.array(*[F.lit(x) for x in table])
        terms = [F.element_at(cells, F.element_at("votes", j + 1) + 2 + 3 * j) for j in range(LABELERS)]
        odds = F.when(F.col("kind") == kind, reduce(lambda a, b: a + b, terms, F.lit(table[0]))).otherwise(odds)
    return 1 / (1 + F.exp(-odds))


Classifier = dict[int, list[float]]


def train(spans: DataFrame) -> Classifier:
    """Log odds per kind: the prior, then every feature value's; fitted to the probabilities of all spans."""
    judged = spans.join(reliabilities(spans).select("kind", "votes", "p"), ["kind", "votes"])
    prior = {r["kind"]: (r["t"], r["f"]) for r in judged.groupBy("kind").agg(F.sum("p").alias("t"), F.sum(1 - F.col("p")).alias("f")).collect()}
    cells = judged.select("kind", "p", F.explode("features").alias("x")).groupBy("kind", "x").agg(F.sum("p").alias("t"), F.sum(1 - F.col("p")).alias("f"))
    size = LABELERS * FEATURE_VALUES
    model = {k: [math.log((t + 1) / (f + 1))] + [0.0] * size for k, (t, f) in prior.items()}
    for row in cells.collect():  # at most kinds * features * FEATURE_VALUES
        t, f = prior[row["kind"]]
        model[row["kind"]][1 + row["x"]] = math.log((row["t"] + 1) / (t + FEATURE_VALUES) * (f + FEATURE_VALUES) / (row["f"] + 1))
    return model


def learn(candidates: DataFrame) -> Classifier:
    """The classifier from all base and proposed spans of a table with candidates."""
    both = F.concat(
        F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), votes(s, F.lit(True)).alias("votes"), features(s).alias("features"))),
        F.transform("proposed", lambda s: F.struct(s["kind"].alias("kind"), votes(s, F.lit(False)).alias("votes"), features(s).alias("features"))),
    )
    spans = candidates.filter("size(base) + size(proposed) > 0").select(F.explode(both).alias("s"))
    return train(cut_lineage(spans.select("s.kind", "s.votes", "s.features")))


def probability(span: Column, model: Classifier) -> Column:
    def of_kind(name: str) -> Column:
        table = model.get(KINDS.index(name))
        if table is None:
            return F.lit(0.0)
        cells = F.array(*[F.lit(x) for x in table])
        odds = F.aggregate(features(span), F.lit(table[0]), lambda a, x: a + F.element_at(cells, x + 2))
        return 1 / (1 + F.exp(-odds))

    return by_kind(span["kind"], of_kind)


def with_spans(candidates: DataFrame, model: Classifier) -> DataFrame:
    """Add ``spans``: base spans and likely proposals by kind, then start."""
    plain = "array<struct<kind:int,start:bigint,end:bigint>>"
    likely = F.transform(
        "proposed", lambda s: F.struct(probability(s, model).alias("p"), s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    )
    rows = candidates.withColumn("_likely", F.when(F.size("proposed") > 0, F.filter(likely, lambda s: s["p"] >= LIKELY)))
    # Of overlapping proposals the likelier stays, of equal ones the first.
    better = F.filter(
        "_likely",
        lambda s: ~F.exists(
            "_likely",
            lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"])
            & ((o["p"] > s["p"]) | ((o["p"] == s["p"]) & (F.struct(o["start"], o["kind"]) < F.struct(s["start"], s["kind"])))),
        ),
    )
    bare = lambda spans: F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    added = F.coalesce(bare(better), F.array().cast(plain))
    return rows.withColumn("spans", F.array_sort(F.concat(bare(F.col("base")), added))).drop("_likely")


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans, of every document."""
    found = cut_lineage(with_candidates(docs.select("doc_id", "text")).drop("text"))
    rows = with_spans(found, learn(found))

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{KINDS[k]}")

    return rows.select("doc_id", *map(count, range(len(KINDS))), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; n_chars follows a changed text."""
    candidates = with_candidates(packed(docs, "text").withColumnRenamed("_text", "text"))
    rows = with_spans(candidates, learn(candidates.select("base", "proposed")))
    marks = F.array(*[F.lit(f"<{name.upper()}>") for name in KINDS])
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        begin = F.greatest(s["start"], acc["at"])
        piece = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (begin - acc["at"]).cast("int"))
        mark = F.when(s["end"] > acc["at"], F.element_at(marks, s["kind"] + 1)).otherwise("")
        return F.struct(F.concat(acc["out"], piece, mark).alias("out"), F.greatest(s["end"], acc["at"]).alias("at"))

    ordered = F.array_sort("spans", lambda a, b: (a["start"] - b["start"]).cast("int"))
    done = F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    some = F.size("spans") > 0
    rows = rows.withColumn("_new", F.when(some, done).otherwise(F.col("text")))
    changed = {"text": F.col("_new")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(some, F.length("_new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return unpacked(rows, docs.columns, **changed)
