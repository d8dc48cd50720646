"""Roots of trees, level by level."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import registry
from tidemark.operators import trees


def test_roots_of_more_rows_than_a_recursive_query_may_have(spark, tmp_path):
    spark.range(250_000).withColumnRenamed("id", "c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    out = registry.QUERIES["src_13_root"](spark, str(tmp_path))
    wrong = F.col("root") != F.substring(F.col("id").cast("string"), 1, 1).cast("long")
    assert out.agg(F.count("*"), F.countDistinct("id"), F.count(F.when(wrong, 1))).first()[:] == (250_000, 250_000, 0)


def test_roots_of_odd_trees(spark):
    rows = [(1, None), (2, 1), (2, 1), (3, 2), (4, 99), (5, 4), (6, 7), (7, 6), (None, None), (8, 8), (9, None)]
    got = trees.roots(spark.createDataFrame(rows, "id long, parent long")).collect()
    assert sorted(((r["id"], r["root"]) for r in got), key=str) == sorted([(1, 1), (2, 1), (2, 1), (3, 1), (3, 1), (None, None), (9, 9)], key=str)
