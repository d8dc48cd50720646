"""The interaction audit against a plain walk through every order."""

from __future__ import annotations

import itertools
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import interactions, queries

COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def fails(text, smaller):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = ""
    if len(ws) < 200:
        out += "A"
    if 100 * len(set(ws)) < 50 * len(ws):
        out += "B"
    if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text):
        out += "C"
    if re.search(r"[#$%&*|]", text):
        out += "D"
    return set(out + ("E" if smaller else ""))


def plain(docs, labels):
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    least = {}
    for i, _, text in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    parts = defaultdict(list)
    for i, lang, text in docs:
        smaller = i is not None and i > least[text or ""]
        parts[lang or ""].append((fails(text or "", smaller), i in good, i in toxic))
    out = []
    for part, rows in parts.items():
        by_order, total = {}, defaultdict(int)
        for order in itertools.permutations("ABCDE"):
            here = rows
            for f in order:
                gone = [r for r in here if f in r[0]]
                here = [r for r in here if f not in r[0]]
                by_order[order, f] = (len(here), gone)
                total[f] += len(gone)
        for (order, f), (kept, gone) in by_order.items():
            out.append((
                part, "".join(order), order.index(f) + 1, kept, len(gone), sum(f in r[0] for r in rows) - len(gone), sum(r[0] == {f} for r in rows),
                sum(r[1] for r in gone), sum(r[2] for r in gone), total[f],
            ))
    return sorted(out)


def rows(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_awkward_rows(spark):
    many = " ".join(f"w{i}" for i in range(300))
    texts = [None, "", " \n", many, many + " # here", "the same " * 150, "ABC def", "LOUD " * 250, "é" * 40 + "\x0b\x0cX", many + "\x00\x1c\x85", "a|b", many.upper()]
    docs = [(i, ("en", "de", None, "", "日本")[i % 5], texts[i % len(texts)]) for i in range(120)]
    docs += [(3, "en", many)] * 4 + [(None, "en", many), (None, None, None), (-5, "fr", "the same " * 150)] + [(1 << 60, "en", "x " * 70_000)]
    labels = [(i, i % 2, (i + 1) % 2) for i in range(0, 90)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1), (7, None, None), (500, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, lang string, text string").withColumns({c: F.lit("own") for c in ("part", "mask", "print", "n", "good")})
    m = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("own"))
    assert rows(interactions.audit(d.repartition(4), m)) == plain(docs, labels)


def test_a_hot_text_and_a_hot_id(spark):
    docs = [(i, "en", "one text on a third of the rows") for i in range(1500)] + [(1, "en", f"text {i}") for i in range(1500)] + [(i, "de", f"w{i}") for i in range(1500)]
    labels = [(1, 1, 1), (2, 0, 1)]
    d, m = spark.createDataFrame(docs, "doc_id long, lang string, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert rows(interactions.audit(d, m)) == plain(docs, labels)


def test_no_rows(spark):
    d, m = spark.createDataFrame([], "doc_id long, lang string, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interactions.audit(d, m).collect() == []
    one = spark.createDataFrame([(1, None, None)], "doc_id long, lang string, text string")
    assert rows(interactions.audit(one, m)) == plain([(1, None, None)], [])


def test_more_parts_than_a_task_holds(spark):
    d = [(f"p{i % 40}", i % 32, i % 3 == 0, i % 5 == 0) for i in range(800)]
    df = spark.createDataFrame(d, "part string, mask int, good boolean, toxic boolean").repartition(2)
    few, many = (sorted(map(tuple, interactions.counted(df, n).collect())) for n in (3, 256))
    assert few == many
    assert sum(r[3] for r in few if r[1] == "mask") == 800


def test_the_table_of_first_failures():
    assert interactions.FIRST.shape == (32, 120)
    assert (interactions.FIRST[0] == 5).all()
    for mask, o in itertools.product(range(32), range(0, 120, 7)):
        order = interactions.ORDERS[o]
        failing = [f for f in order if mask >> "ABCDE".index(f) & 1]
        assert interactions.FIRST[mask, o] == (order.index(failing[0]) if failing else 5)


def test_words_of_long_texts_come_in_pieces():
    raw = (" " * 30 + "word\tanother\x0bé " * 50 + "x" * 500).encode()
    for size in (1, 7, 64, 10_000):
        assert [w for ws in interactions.word_lists(raw, size) for w in ws] == raw.split()
    assert np.array_equal(list(interactions.word_lists(b"")), [])


def test_600_rows_a_part(spark, sf_dir):
    out = queries.op12_filter_interactions(spark, sf_dir)
    assert {r["count"] for r in out.groupBy("part").count().collect()} == {600}
