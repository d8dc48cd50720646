"""Documents and tables on disk: damage is named, a failed write changes nothing."""

from __future__ import annotations

import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.sources import documents, tables


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def write(spark, folder):
    rows = [(str(k), ("a", "b", None)[k % 3], f'{{"id": {k}, "name": "n{k}", "text": "line one\\nline two é"}}' if k else '{\n"id": 0}') for k in range(40)]
    rows += [("null", "a", None), ("list", "a", "[1, 2]"), ("text", "b", "no json"), ("wrong", "a", '{"id": "x"}')]
    documents.write_documents(spark.createDataFrame(rows, "key string, part string, document string").repartition(3), f"{folder}/d")
    return f"{folder}/d"


def read(spark, path):
    good, damaged = documents.read_documents(spark, path, "id long, name string")
    return {r["key"]: r["document"] for r in good.collect()}, {r["key"]: r["reason"] for r in damaged.collect()}


def test_documents_come_back(spark, folder):
    good, damaged = read(spark, write(spark, folder))
    assert set(good) == {str(k) for k in range(40)} and good["7"]["name"] == "n7" and good["0"]["id"] == 0
    assert set(damaged) == {"list", "text", "wrong"} and set(damaged.values()) == {"not of the schema"}


def test_a_changed_byte_drops_that_document_and_names_it(spark, folder):
    path = write(spark, folder)
    hit = 0
    for f in Path(path).glob("data/*/part-*"):
        raw = f.read_bytes()
        if b'"n7"' in raw:
            f.write_bytes(raw.replace(b'"n7"', b'"n8"'))
            (f.parent / f".{f.name}.crc").unlink()
            hit += 1
    assert hit == 1
    good, damaged = read(spark, path)
    assert "7" not in good and len(good) == 39 and damaged["7"] == "changed or missing"


def test_lines_that_nobody_wrote_are_not_read(spark, folder):
    path = write(spark, folder)
    extra = Path(path) / "data" / "part=a" / "part-extra.txt"
    extra.write_text('{"id": 99, "name": "other"}\n')
    assert read(spark, path)[0].keys() == {str(k) for k in range(40)}


def test_a_lost_file_names_its_documents(spark, folder):
    path = write(spark, folder)
    for f in Path(path).glob("data/part=b/part-*"):
        f.unlink()
    good, damaged = read(spark, path)
    assert all(int(k) % 3 != 1 for k in good) and damaged["1"] == damaged["text"] == "changed or missing"


def rows(spark, path, **kw):
    return sorted((tuple(r) for r in tables.read(spark, path, **kw).collect()), key=repr)


def test_appended_columns_and_defaults(spark, folder):
    path = f"{folder}/t"
    with pytest.raises(FileNotFoundError):
        tables.read(spark, path)
    assert tables.append(spark.createDataFrame([(1, "a")], "id long, name string"), path) == 1
    assert tables.append(spark.createDataFrame([(2, "b", 5), (3, None, None)], "id long, name string, votes int"), path) == 2
    assert rows(spark, path, version=1) == [(1, "a")]
    assert rows(spark, path) == [(1, "a", None), (2, "b", 5), (3, None, None)]
    assert sorted(r["votes"] is None for r in tables.read(spark, path, defaults={"votes": 0}).collect()) == [False, False, True]
    with pytest.raises(FileNotFoundError):
        tables.read(spark, path, version=9)


def test_an_empty_batch_is_a_version(spark, folder):
    path = f"{folder}/t"
    tables.append(spark.createDataFrame([], "id long"), path)
    tables.append(spark.createDataFrame([(1,)], "id long"), path)
    assert rows(spark, path, version=1) == [] and rows(spark, path) == [(1,)]


def test_a_failed_write_leaves_the_version_before(spark, folder):
    path = f"{folder}/t"
    tables.append(spark.range(3), path)
    broken = spark.range(100).select(F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("id").cast("string")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        tables.append(broken, path)
    assert tables.versions(spark, path) == [1] and rows(spark, path) == [(0,), (1,), (2,)]
    assert tables.append(spark.range(3, 4), path) == 2
    assert len(rows(spark, path)) == 4


def test_of_two_writers_one_is_refused(spark, folder, monkeypatch):
    path = f"{folder}/t"
    tables.append(spark.range(1), path)
    known = tables.versions
    monkeypatch.setattr(tables, "versions", lambda s, p: known(s, p)[:1])  # it read the versions before the other's was there
    assert tables.append(spark.range(1, 2), path) == 2
    with pytest.raises(FileExistsError):
        tables.append(spark.range(2, 3), path)
    monkeypatch.undo()
    assert rows(spark, path) == [(0,), (1,)]
    assert tables.append(spark.range(2, 3), path) == 3
