"""Periodic runs against a search of all periods and places."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import queries, runs


def plain_runs(c):
    n, out = len(c), []
    for p in range(1, n // 4 + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and c[j] == c[j + p]:
                j += 1
            s, e = i, j + p
            if j > i and e - s >= max(6, 4 * p) and not any(all(c[k] == c[k + q] for k in range(s, e - q)) for q in range(1, p)):
                out.append((s, e - s, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    drop = {i for s, m, p in found for i in range(s + p, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(found), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
        sha("".join(f"{s},{m},{p}\n" for s, m, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)),
    )


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=90), st.lists(st.tuples(st.integers(0, 80), st.integers(1, 20), st.integers(1, 80)), max_size=3))
def test_random_words(words, repeats):
    c = np.array(words, dtype=np.int32)
    for a, p, m in repeats:
        if a < len(c):
            m = min(m, len(c) - a)
            c[a:a + m] = c[a + np.arange(m) % p % m]
    assert runs.find_runs(c) == plain_runs(c.tolist())


def test_every_length_about_the_least():
    for p in range(1, 12):
        for extra in range(-3, 4):
            m = max(6, 4 * p) + extra
            c = np.r_[np.arange(100, 117), np.arange(m) % p, np.arange(200, 230)].astype(np.int32)
            assert runs.find_runs(c) == ([(17, m, p)] if extra >= 0 else [])


def test_large_periods_multiples_and_nested_runs():
    unit = np.repeat(np.arange(30), 9)
    c = np.r_[np.arange(1000, 1100), np.tile(unit, 9), np.arange(2000, 2100)].astype(np.int32)
    found = runs.find_runs(c)
    assert (100, 2430, 270) in found
    assert sum(p == 1 for _, _, p in found) == 270
    assert len(found) == 271


def test_two_million_words_of_one_kind():
    assert runs.find_runs(np.zeros(2_000_000, dtype=np.int32)) == [(0, 2_000_000, 1)]


def test_awkward_rows(spark):
    texts = [None, "", " \n", "a", "a " * 5, "a " * 6, "a b " * 4, "x a b a b a b a b y", "é ù " * 30, "no run\x00 in\x1c here\x85 at all", "A a " * 9 + "b " * 9, "one two three " * 400, "w" * 90_000]
    rows = [(i, texts[i % len(texts)]) for i in range(130)] + [(None, "z " * 20), (7, "a " * 6), (7, "a " * 6), ((1 << 60) + 1, "q r " * 11)]
    rows += [(1000 + i, " ".join(f"w{(i * k * k) % 31}" for k in range(i * 3))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("runs", "n_words", "collapsed", "start")})
    out = df.repartition(3).transform(runs.planted)
    assert sorted(out.columns) == ["collapsed", "doc_id", "n_words", "runs"]
    want = sorted((plain(i, t) for i, t in rows), key=repr)
    df.select("doc_id", "text").createOrReplaceTempView("rows")

    class Reads:
        class read:
            parquet = staticmethod(lambda path: df)

    got = sorted((tuple(r) for r in queries.op13_periodic_runs(Reads, "").collect()), key=repr)
    assert got == want


def test_other_columns_stay(spark):
    df = spark.createDataFrame([(1, "b " * 8, (1 << 60) + 1, None)], "doc_id long, text string, start long, runs string")
    r = runs.periodic_runs(df).first()
    assert (r["start"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) == ((1 << 60) + 1, 8, [(0, 8, 1)], "b")


def test_no_rows(spark):
    assert runs.planted(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_the_table(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    short = {i: t for i, t in docs if len((t or "").split()) < 700}
    got = {r["doc_id"]: tuple(r) for r in queries.op13_periodic_runs(spark, sf_dir).collect()}
    assert set(got) == {i for i, _ in docs}
    assert all(got[i] == plain(i, t) for i, t in short.items())
    assert sum(r[1] > 0 for r in got.values()) > len(docs) // 20
