"""How filters hide one another's work, for every order of applying them.

Each document gets a mask of the filters it fails. Which filter removes it, under each
order, is looked up: a table with a row for each of the 32 masks and a column for each of
the 120 orders holds the step of the first failure. Tasks count removals by part, order,
step and label with bincount over the steps looked up, a batch at a time; their arrays
are summed by Spark.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import append, columns_of, few, stored

FILTERS = "ABCDE"
ORDERS = ["".join(o) for o in itertools.permutations(FILTERS)]
STEPS = len(FILTERS)
#: Step, from 0, at which a document of each mask goes under each order; STEPS if it stays.
FIRST = np.array([
    [next((k for k, f in enumerate(order) if mask >> FILTERS.index(f) & 1), STEPS) for order in ORDERS] for mask in range(1 << STEPS)
], dtype=np.int64)
_CELLS = len(ORDERS) * (STEPS + 1)
_NOT_SIGNS = bytes(sorted(set(range(256)) - set(b"#$%&*|")))
_NOT_UPPER = bytes(sorted(set(range(256)) - set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")))


def word_lists(raw: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of UTF-8 bytes between U+0020 and U+0009 to U+000D, in lists from about `size` bytes each."""
    start = 0
    while start < len(raw):
        end = min(start + size, len(raw))
        while end < len(raw) and raw[end] not in b" \t\n\v\f\r":
            stop = [i for i in (raw.find(b, end, end + size) for b in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")) if i >= 0]
            end = min(stop) if stop else min(end + size, len(raw))
        yield raw[start:end].split()
        start = end


def own_mask(text: str | None, least_words: int = 200, least_distinct: int = 50, most_upper: int = 3) -> tuple[int, bytes]:
    """Filters A to D that a whole text fails, as bits, and 128 bits of its content."""
    raw = (text or "").encode()
    n, distinct = 0, set()
    for words in word_lists(raw):
        n += len(words)
        distinct.update(words)
    upper = len(raw.translate(None, _NOT_UPPER))
    mask = (n < least_words) | (100 * len(distinct) < least_distinct * n) << 1 | (100 * upper > most_upper * len(text or "")) << 2 | (len(raw.translate(None, _NOT_SIGNS)) > 0) << 3
    return mask, hashlib.blake2b(raw, digest_size=16).digest()


def with_table(rows: DataFrame, table: DataFrame, key: str, crowded: int = 1000) -> DataFrame:
    """rows left-joined to table(key, ...), which has a key once. Keys on more than 1 / crowded of the rows, fewer than `crowded` of them, are joined by broadcast, null keys to nothing."""
    total = rows.count()
    hot = rows.where(f"{key} is not null").groupBy(key).count().where(F.col("count") * crowded > total).select(key)
    hot = stored(hot.withColumn("_hot", F.lit(True)), "crowded-keys")
    marked = rows.join(F.broadcast(hot), key, "left")
    hot_table = stored(table.join(F.broadcast(hot.select(key)), key), "crowded-rows")
    apart = marked.where("_hot").drop("_hot").join(F.broadcast(hot_table), key, "left")
    rest = marked.where(F.col("_hot").isNull() & F.col(key).isNotNull()).drop("_hot").join(table, key, "left")
    none = rows.where(f"{key} is null").withColumns({c: F.lit(None).cast(table.schema[c].dataType) for c in table.columns if c != key})
    return apart.unionByName(rest).unionByName(none)


def failures(docs: DataFrame) -> DataFrame:
    """docs(doc_id, lang, text) as (doc_id, part, mask): bit 0 to 4 for each filter that the whole text fails.

    A: under 200 words (maximal runs of characters other than U+0020 and U+0009 to U+000D);
    B: distinct words under half of all; C: A-Z more than 3% of code points; D: holds one of
    `#$%&*|`; E: the text is that of a smaller doc_id. A null text is an empty one, a null
    lang the part ''. A null doc_id is smaller than none and none is smaller than it. Rows
    that share doc_id and text don't fail E for one another. Other columns are dropped.
    """
    d = columns_of(docs, "doc_id", "lang", "text").select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), "text")
    rows = append(d, ["text"], "own int, print binary", lambda: lambda texts: list(zip(*map(own_mask, texts), strict=True)) or [[], []], ("text",))
    rows = stored(rows, "audit-masks")
    copies = rows.groupBy("print").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = with_table(rows, few(stored(copies, "audit-copies")), "print")
    return rows.select("doc_id", "part", F.col("own").bitwiseOR(F.when(F.col("doc_id") > F.col("first"), 16).otherwise(0)).alias("mask"))


def counted(rows: DataFrame, most_parts: int = 256) -> DataFrame:
    """rows(part, mask, good, toxic) as (part, what, cell, n), zeros left out.

    What is removed, good or toxic, with cell = order * 6 + step (step 5: stayed), or mask,
    with cell = mask. A task keeps the arrays of up to most_parts parts and gives them away beyond.
    """
    kinds = {"removed": _CELLS, "good": _CELLS, "toxic": _CELLS, "mask": 1 << STEPS}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[str, np.ndarray]] = {}

        def given() -> Iterator[pa.RecordBatch]:
            for part, arrays in held.items():
                for what, a in arrays.items():
                    at = np.flatnonzero(a)
                    yield pa.RecordBatch.from_arrays([pa.array([part] * len(at), pa.string()), pa.array([what] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(a[at])], names=["part", "what", "cell", "n"])
            held.clear()

        for batch in batches:
            parts = batch.column("part").dictionary_encode()
            code = parts.indices.to_numpy(zero_copy_only=False)
            masks, good, toxic = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "good", "toxic"))
            for i, part in enumerate(parts.dictionary.to_pylist()):
                here = code == i
                own = held.setdefault(part, {what: np.zeros(n, dtype=np.int64) for what, n in kinds.items()})
                own["mask"] += np.bincount(masks[here], minlength=1 << STEPS)
                for what, m in (("removed", masks[here]), ("good", masks[here & good]), ("toxic", masks[here & toxic])):
                    for block in np.array_split(m, len(m) // 4096 + 1):
                        cells = np.arange(len(ORDERS)) * (STEPS + 1) + FIRST[block]
                        own[what] += np.bincount(cells.ravel(), minlength=_CELLS)
                if len(held) >= most_parts:
                    yield from given()
        yield from given()

    sums = rows.select("part", "mask", "good", "toxic").mapInArrow(run, "part string, what string, cell int, n long")
    return sums.groupBy("part", "what", "cell").agg(F.sum("n").alias("n"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part (lang), order of the filters and step, what the step's filter does.

    docs(doc_id, lang, text) as in failures(); labels(doc_id, quality, toxic), of which
    repeated rows count as the larger marks, null ids and marks as none. Rows (part,
    filter_order, step from 1, kept after it, removed, redundant: failing the filter but
    gone before, unique_fails: failing it alone, good_lost, toxic_lost: removed with
    quality or toxic 1, shapley: removed by that filter over all orders); 600 a part, zeros
    included. No rows, no parts.
    """
    marks = columns_of(labels, "doc_id", "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(
        (F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    rows = with_table(stored(failures(docs), "audit-rows"), marks, "doc_id")
    rows = rows.select("part", "mask", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    n = stored(counted(rows), "audit-counts")  # at most 1,832 rows a part
    spark = docs.sparkSession
    steps = F.broadcast(spark.createDataFrame(
        [(o, name, k, f) for o, name in enumerate(ORDERS) for k, f in enumerate(name)], "ord int, filter_order string, k int, filter string"))
    masks = n.where("what = 'mask'")
    of = [F.shiftleft(F.lit(1), i) for i in range(STEPS)]
    fails = masks.groupBy("part").agg(
        F.sum("n").alias("docs"),
        F.map_from_arrays(F.array(*[F.lit(f) for f in FILTERS]), F.array(*[F.sum(F.when(F.col("cell").bitwiseAND(b) > 0, F.col("n")).otherwise(0)) for b in of])).alias("fails"),
        F.map_from_arrays(F.array(*[F.lit(f) for f in FILTERS]), F.array(*[F.sum(F.when(F.col("cell") == b, F.col("n")).otherwise(0)) for b in of])).alias("alone"),
    )
    cells = n.where(f"what <> 'mask' and cell % {STEPS + 1} < {STEPS}").withColumns({"ord": (F.col("cell") / (STEPS + 1)).cast("int"), "k": F.col("cell") % (STEPS + 1)})
    cells = cells.groupBy("part", "ord", "k").pivot("what", ["removed", "good", "toxic"]).agg(F.sum("n"))
    grid = fails.join(steps).join(cells, ["part", "ord", "k"], "left").na.fill(0, ["removed", "good", "toxic"])
    before = F.sum("removed").over(W.partitionBy("part", "ord").orderBy("k"))
    return grid.select(
        "part", "filter_order", (F.col("k") + 1).cast("int").alias("step"), (F.col("docs") - before).alias("kept"), "removed",
        (F.col("fails")[F.col("filter")] - F.col("removed")).alias("redundant"), F.col("alone")[F.col("filter")].alias("unique_fails"),
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), F.sum("removed").over(W.partitionBy("part", "filter")).alias("shapley"),
    )
