"""Append-only tables on disk: folders of Parquet, and numbered manifests of the folders that count.

A batch is written to a folder of its own, then the next manifest is moved into its place
in one step. Until then readers see the version before, and a write that failed leaves
nothing they would read. Batches may add columns; a table is read with all of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it is not there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions of a table, in order; none where nothing was appended."""
    return [int(n.removeprefix("v")) for n in _folders(spark, f"{path}/manifests") if n.startswith("v")]


def _entries(spark: SparkSession, path: str, version: int) -> list[str]:
    rows = spark.read.schema("place int, folder string").json(f"{path}/manifests/v{version:09d}").collect()  # a row a batch
    return [r["folder"] for r in sorted(rows, key=lambda r: r["place"])]


def append(batch: DataFrame, path: str) -> int:
    """The new version of the table at path, with the rows of batch added.

    Of two writers at once the one whose manifest comes second fails with FileExistsError;
    its rows are not in the table, and it may try again.
    """
    spark = batch.sparkSession
    folder = f"b{uuid.uuid4().hex}"
    batch.write.parquet(f"{path}/data/{folder}")
    known = versions(spark, path)
    entries = [*(_entries(spark, path, known[-1]) if known else []), folder]
    version = known[-1] + 1 if known else 1
    draft = f"{path}/drafts/{folder}"
    spark.createDataFrame(list(enumerate(entries)), "place int, folder string").coalesce(1).write.json(draft)
    jvm = spark._jvm.org.apache.hadoop.fs
    context = jvm.FileContext.getFileContext(jvm.Path(path).toUri(), spark._jsc.hadoopConfiguration()) if "://" in path else jvm.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    context.mkdir(jvm.Path(f"{path}/manifests"), spark._jvm.org.apache.hadoop.fs.permission.FsPermission.getDirDefault(), True)
    no_overwrite = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 0)
    try:
        context.rename(jvm.Path(draft), jvm.Path(f"{path}/manifests/v{version:09d}"), no_overwrite)
    except Exception as refused:
        if "FileAlreadyExists" in str(refused):
            raise FileExistsError(f"version {version} of {path} was written meanwhile") from refused
        raise
    return version


def read(spark: SparkSession, path: str, version: int | None = None, defaults: dict | None = None) -> DataFrame:
    """The rows of a version, the latest unless told otherwise; columns that a batch has not are null, or what `defaults` says.

    A null that was written stays null: defaults are for batches without the column.
    """
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"no such version of {path}")
    out = None
    for folder in _entries(spark, path, known[-1] if version is None else version):
        b = spark.read.parquet(f"{path}/data/{folder}")
        b = b.withColumns({c: F.lit(v) for c, v in (defaults or {}).items() if c not in b.columns})
        out = b if out is None else out.unionByName(b, allowMissingColumns=True)
    return out
