"""Grounding by look-ups, candidates by an inverted index, themes by stored rules: against plain versions."""

from __future__ import annotations

import math
import random
import time
from collections import Counter

from pyspark.sql import functions as F

from tidemark.operators import grounding

CATALOG = [
    (1, "Red Ring Small", 5.0, None, False), (2, "red ring large", 9.0, 2.0, False), (3, "Blue  bolt\tsmall", 1.0, None, True), (4, "blue bolt LARGE", 1.0, 3.0, True),
    (5, "", 7.0, None, False), (6, None, 7.0, None, False), (7, "red ring small", 5.0, None, False),
]
DDL = "id long, title string, popularity double, leverage double, is_inverse boolean"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return low.replace("\t", " ").replace("\n", " ").split(" ")


def plain_candidates(concepts, k):
    sets = {i: {w for w in words(t) if w} for i, t, *_ in CATALOG}
    df = Counter(w for s in sets.values() for w in s)
    out = []
    for c in {c for c in concepts if c is not None}:
        scored = [(-round(sum(math.log(len(CATALOG) / df[w]) + 1 for w in set(words(c)) & s if w), 9), -p, i) for (i, s), p in zip(sets.items(), [x[2] for x in CATALOG], strict=True) if set(words(c)) & s - {""}]
        out += [(c, i, -score, n) for n, (score, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def test_candidates(spark):
    concepts = ["red ring", "RED  bolt", "small", "nothing known", "", None, "red red ring small"]
    index = grounding.word_index(spark.createDataFrame(CATALOG, DDL))
    got = grounding.candidates(spark.createDataFrame([(c,) for c in concepts * 3], "concept string"), index, 3).collect()
    assert sorted((r["concept"], r["id"], r["score"], r["rank"]) for r in got) == plain_candidates(concepts, 3)


def test_ground(spark):
    items = [
        ("known", 1, "red ring", "red ring"), ("known, wrong claim, nothing like it", 1, "red ring small", "red ring 3x"), ("not known", 99, "red ring small", "red ring"),
        ("null", None, "blue bolt large", "inverse 3x bolt"), ("direction", 1, "blue bolt", "inverse bolt"), ("more leverage", 1, "red ring large", "red ring 2x"),
        ("states no leverage", 4, "blue bolt small", "inverse bolt"), ("no words", 99, "", "x"), ("no concept", 99, None, None), ("shares too little", 99, "red large unknownword bolt small", "red"),
        ("says less than it is", 2, "red ring small", "red ring"),
    ]
    df = spark.createDataFrame(items, "item string, proposed long, concept string, claim string").repartition(3)
    got = {r["item"]: (r["grounding"], r["id"], r["refusal"]) for r in grounding.ground(df, spark.createDataFrame(CATALOG, DDL)).collect()}
    assert got == {
        "known": ("verified", 1, None), "known, wrong claim, nothing like it": ("discarded", None, "not_leveraged"), "not known": ("repaired", 1, None),
        "null": ("repaired", 4, None), "direction": ("discarded", None, "direction"), "more leverage": ("discarded", None, "leverage"),
        "states no leverage": ("verified", 4, None), "no words": ("discarded", None, "no candidate"), "no concept": ("discarded", None, "no candidate"),
        "shares too little": got["shares too little"], "says less than it is": ("verified", 2, None),
    }
    assert got["shares too little"][0] in ("repaired", "discarded")


def plain_theme(text, rules):
    w = [x for x in words(text) if x]
    runs = {" ".join(w[i:j]) for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
    hits = sorted((p, " ".join(x for x in words(phrase) if x), t) for p, t, phrase in rules if phrase and " ".join(x for x in words(phrase) if x) in runs)
    return hits[0][2] if hits else "general"


def test_themes(spark):
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(40)]
    rules = [(k, f"t{k % 9}", " ".join(r.choice(vocabulary).upper() for _ in range(r.choice((1, 2, 2, 3))))) for k in range(12)] + [(3, "tie", "w1 w2"), (0, "empty", ""), (None, "none", "w1"), (1, "none", None)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randrange(12))) for _ in range(200)] + [None, "", "  w1\tw2 ", "W1  W2", "xw1 w2x"]
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "key long, text string, phrase string").repartition(3)
    got = {x["key"]: x["theme"] for x in grounding.themes(df, spark.createDataFrame(rules, "priority int, theme string, phrase string")).collect()}
    own = [x for x in rules if x[0] is not None and x[2]]
    assert got == {i: plain_theme(t, own) for i, t in enumerate(texts)}


def test_five_hundred_rules_cost_what_five_do(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("key"), "text").cache()
    docs.count()

    def took(n):
        rules = spark.createDataFrame([(k, "t", f"phrase{k} number{k}") for k in range(n)], "priority int, theme string, phrase string")
        began = time.perf_counter()
        grounding.themes(docs, rules).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    took(5)
    assert took(500) < 3 * took(5) + 1


def test_without_rules_or_items(spark):
    none = spark.createDataFrame([], "priority int, theme string, phrase string")
    assert grounding.themes(spark.createDataFrame([(1, "a")], "key long, text string"), none).first()["theme"] == "general"
    items = spark.createDataFrame([], "item string, proposed long, concept string, claim string")
    assert grounding.ground(items, spark.createDataFrame(CATALOG, DDL)).collect() == []
    one = spark.createDataFrame([("a", 1, "red", "red")], "item string, proposed long, concept string, claim string")
    assert grounding.ground(one, spark.createDataFrame([], DDL)).first()["grounding"] == "discarded"


def test_copies_of_titles_meet_a_concept_once(spark):
    rows = [(i, f"{'red' if i % 2 else 'blue'} ring n{i % 5}", float(i % 7)) for i in range(5_000)]
    index = grounding.word_index(spark.createDataFrame(rows, "id long, title string, popularity double"))
    kinds = grounding.title_kinds(index, 4).collect()
    assert len(kinds) == 40 and len({r["kind"] for r in kinds}) == 10 and all(any(r["id"] == r["kind"] for r in kinds if r["kind"] == x["kind"]) for x in kinds)
    got = grounding.candidates(spark.createDataFrame([("Red n1",), ("ring",), ("n0 blue blue",)], "concept string"), index, 4).collect()
    for concept, fits in (("Red n1", lambda i: i % 2 == 1 and i % 5 == 1), ("ring", lambda i: True), ("n0 blue blue", lambda i: i % 2 == 0 and i % 5 == 0)):
        want = sorted((i for i, *_ in rows if fits(i)), key=lambda i: (-(i % 7), i))[:4]
        assert [r["id"] for r in sorted((r for r in got if r["concept"] == concept), key=lambda r: r["rank"])] == want
