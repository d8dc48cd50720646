"""Helpers that several operators share: the shared folder, row-hash buckets, components."""

from __future__ import annotations

import contextlib
import ctypes
import inspect
import itertools
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: A-Z to a-z on UTF-8 bytes; other letters stay.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets a temporary one; on a cluster that is an error."""
    sc = spark.sparkContext
    set_by_cluster = sc.getConf().get("spark.checkpoint.dir", "") or sc.getCheckpointDir()
    if not set_by_cluster:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(set_by_cluster)
    return (set_by_cluster or sc.getCheckpointDir()).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: computed once, safe against lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df, a stored table of short rows, marked for broadcast if it has at most `most` rows; else Spark shuffles it."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def buckets(spark: SparkSession) -> int:
    """How many hash buckets spread a two-step rank or prefix sum."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(col):
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns named: tables may carry further ones."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def set_aside(df: DataFrame, *own: str) -> tuple[DataFrame, dict[str, str]]:
    """df with all columns but its `own` under names that clash with nothing, and how to name them back (withColumnsRenamed)."""
    names = {c: f"_column_{i}" for i, c in enumerate(df.columns) if c not in own}
    return df.withColumnsRenamed(names), {v: k for k, v in names.items()}


_given = [0.0]


def give_back(every: float = 0.0) -> None:
    """Return to the system what a Python worker has freed: Arrow's pool and malloc keep it else while the worker waits for its next task. At most once in `every` seconds."""
    now = time.monotonic()
    if now - _given[0] >= every:
        _given[0] = now
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # where the C library has no such call
            ctypes.CDLL(None).malloc_trim(0)


_kept: list[dict] = []


def kept(memo: dict) -> dict:
    """A memo that a Python worker keeps from task to task, until one of another kind, in lean(), needs the room."""
    _kept.append(memo)
    return memo


def lean(f: Callable) -> Callable:
    """A function of batches or of a group that runs without the memos of other tasks and gives its memory back when it is done, groups every other second."""
    if inspect.isgeneratorfunction(f):
        def run(batches):
            for memo in _kept:
                memo.clear()
            yield from f(batches)
            give_back()
    else:
        def run(group):
            for memo in _kept:
                memo.clear()
            out = f(group)
            give_back(2.0)
            return out
    return run


def append(df: DataFrame, columns: list[str], added: str, make: Callable, dropped: tuple[str, ...] = ()) -> DataFrame:
    """df, less the columns `dropped`, with those of the schema `added`, made in Python a batch at a time.

    make(), called once for each task, gives the function that takes a batch's lists of
    `columns` and returns a list or array for each new column. The other columns go through
    as Arrow and are never touched: an integer next to a null keeps all its digits.
    """
    new = T.StructType.fromDDL(added)
    arrow = [to_arrow_type(f.dataType) for f in new]
    kept = [i for i, c in enumerate(df.columns) if c not in dropped]
    places = [df.columns.index(c) for c in columns]
    schema = T.StructType([*[df.schema[i] for i in kept], *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in batches:
            made = of(*[batch.column(i).to_pylist() for i in places])
            arrays = [batch.column(i) for i in kept] + [pa.array(x, t, from_pandas=False) for x, t in zip(made, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
        give_back()

    return df.mapInArrow(run, schema)


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """Connected components of edges(a, b): rows (node, root), root the smallest node of the component.

    Alternating large-star and small-star steps: every step sends a node's neighbours to
    its smallest neighbour, so the work of a round is linear in the edges and no list of
    neighbours is ever gathered; a hub costs a partial min and a join that Spark can split.
    Each round is checkpointed in the shared folder; rounds go on until one changes nothing,
    and an error is raised if `rounds` are not enough. Nodes without edges do not appear.
    """
    shared_dir(edges.sparkSession)
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct().checkpoint()
    before = None
    for done in itertools.count():
        if done == rounds:
            raise RuntimeError(f"components have not converged in {rounds} rounds")
        # large star: neighbours larger than a node go to the smallest of its neighbourhood
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select("v", "u"))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("v"), F.col("m").alias("u"))
        # small star: smaller neighbours of a node, and the node, go to its smallest neighbour
        large = large.where("v <> u").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).union(least.select("v", F.col("m")))
        e = small.where("v <> u").distinct().checkpoint()
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return roots.union(e.select("u", "u").distinct())
