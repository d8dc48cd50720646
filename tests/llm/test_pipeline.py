"""The pipeline: each stage alone against a plain version, and the whole run."""

from __future__ import annotations

import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_operators import awkward, check_packed

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def odd(spark):
    extra = ["row", "n", "node", "keys", "rest", "print", "spans", "toxic_score", "_hit", "_key", "_doc", "_kinds", "_column_0", "n_words"]
    df = spark.createDataFrame(awkward(), "doc_id long, text string")
    return df.withColumns({c: F.lit(f"own {c}") for c in extra}).repartition(3)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stage_keeps_columns_of_awkward_rows(spark, odd, name):
    out = dict(corpus_pipeline.STAGES)[name](spark, odd, DIR)
    assert out.columns == odd.columns
    kept, given = {r["doc_id"]: r for r in out.collect()}, {r["doc_id"]: r for r in odd.collect()}
    assert {1, 2, 3} <= set(kept) or name == "toxicity"
    for d, r in kept.items():
        assert [v for c, v in r.asDict().items() if c != "text"] == [v for c, v in given[d].asDict().items() if c != "text"]
    assert dict(corpus_pipeline.STAGES)[name](spark, odd.limit(0), DIR).count() == 0


def test_contaminated_rows_go_and_clean_ones_with_their_id_stay(spark):
    item = spark.read.parquet(f"{DIR}/benchmark.parquet").where("length(text) > 80").first()["text"]
    docs = spark.createDataFrame([(1, item), (1, "clean"), (None, f"a {item} b"), (None, "clean"), (None, None)], "doc_id long, text string")
    assert rows(corpus_pipeline.drop_contaminated(spark, docs, DIR)) == sorted([(1, "clean"), (None, "clean"), (None, None)], key=repr)


def test_run_against_the_stages_in_plain_form(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_toxic(spark, docs, DIR).collect()]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    ids = {d for d, _ in left}
    assert sum(d in ids for d, t in labels.items() if t == 0) >= 0.97 * sum(t == 0 for t in labels.values())
    assert sum(d in ids for d, t in labels.items() if t == 1) <= 0.1 * sum(t == 1 for t in labels.values())
    root = brute.jaccard(left)
    left = [(d, t) for d, t in left if root[d][1] == d]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    hit = {r[0] for r in brute.contamination(left, items) if r[-1]}
    left = [(d, t) for d, t in left if d not in hit]
    masked = []
    for d, t in left:
        spans = sorted((int(a), int(b)) for _, a, b in (x.split(":") for x in brute.secrets([(d, t)])[0][-1].split(",") if x))
        out, end = [], 0
        for a, b in spans:
            if a >= end:
                out += [t[end:a], "[SECRET]"]
            end = max(end, b)
        masked.append((d, "".join(out) + (t or "")[end:]))
    check_packed(corpus_pipeline.run(spark, DIR).collect(), masked)
