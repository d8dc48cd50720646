"""Packing of token sequences into windows by non-negative least squares over length combinations.

The histogram of piece lengths (one bin per length, at most `window` of them) decides
everything on the driver: shallow combinations of lengths that fill a window exactly are
enumerated, their repeat counts solved for by non-negative least squares against the
histogram, rounded, and cut back to what is there. Pieces take their places by a rank
within their length, found with per-bucket counts so that no length meets in one task.
What is left over is packed greedily in one running order and cut at window ends.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import append, buckets, stored
from .tokens import word_ids


def combinations(histogram: np.ndarray, window: int, most_copies: int = 16) -> list[tuple[tuple[int, int], ...]]:
    """Combinations ((length, copies), ...) of at most three different lengths that fill `window` exactly.

    k copies of one length and one filler; or k copies of one, one of the next length
    present above the half of what is missing, and a filler.
    """
    present = np.flatnonzero(histogram)
    found = []
    for a in present:
        for k in range(1, min(most_copies, window // a) + 1):
            rest = window - k * int(a)
            if rest == 0:
                found.append(((int(a), k),))
            elif histogram[rest] and rest != a:
                found.append(((int(a), k), (rest, 1)))
            if rest > 1:
                i = np.searchsorted(present, rest // 2 + 1)
                if i < len(present) and (b := int(present[i])) < rest and histogram[rest - b] and len({int(a), b, rest - b}) == 3:
                    found.append(((int(a), k), (b, 1), (rest - b, 1)))
    return found


def repeat_counts(histogram: np.ndarray, combos: list, rounds: int = 400) -> np.ndarray:
    """How often each combination is used: non-negative least squares by multiplicative updates, rounded, never over the histogram."""
    if not combos:
        return np.zeros(0, dtype=np.int64)
    row = np.array([n for c in combos for n, _ in c])
    col = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
    val = np.array([k for c in combos for _, k in c], dtype=float)
    h = histogram.astype(float)
    target = np.bincount(col, val * h[row], len(combos))
    # A'h and A'Ax with A sparse: x stays positive and the squared error never grows.
    x = np.bincount(col, h[row] / (val * np.bincount(row, minlength=len(h))[row]), len(combos)) / 4 + 1e-6
    for _ in range(rounds):
        fit = np.bincount(row, val * x[col], len(h))
        x *= target / np.maximum(np.bincount(col, val * fit[row], len(combos)), 1e-12)
    left = histogram.astype(np.int64).copy()
    used = np.zeros(len(combos), dtype=np.int64)
    for floor in (True, False):  # once rounded, then whatever still fits
        for i in np.argsort(-x, kind="stable"):
            n = min(int(left[a]) // k for a, k in combos[i])
            n = min(n, int(np.rint(x[i]))) if floor else n
            used[i] += n
            for a, k in combos[i]:
                left[a] -= n * k
    return used


def tokenized(docs: DataFrame, path: str, end: int, window: int, memo_words: int = 800_000) -> DataFrame:
    """doc_id, print, n (ids with the end id) and the CRC-32 of each full window and of the rest."""

    def encoder():
        memo, last = word_ids(path, memo_words), np.array([end], dtype="<u4").tobytes()

        def encode(texts: list[str]) -> tuple[list, list]:
            ids = (memo.encode(t) + last for t in texts)
            out = [(len(x) // 4, [zlib.crc32(x[i:i + 4 * window]) for i in range(0, len(x), 4 * window)]) for x in ids]
            return [n for n, _ in out], [c for _, c in out]

        return encode

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("print", F.xxhash64("text"))
    return append(rows, ["text"], "n long, crcs array<long>", encoder, ("text",))


def pack(docs: DataFrame, path: str, window: int = 4096, end: int = 2, memo_words: int = 800_000) -> DataFrame:
    """Pieces of docs(doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document's ids, then `end`. Full windows of a long document are sequences of
    their own; the rest takes a place in a combination of lengths that fills a window, or
    in the running order of what is left, which is cut at window ends, so only the very
    last sequence is short. A null text is empty: the end id alone. Repeated rows are
    documents of their own; other columns are dropped; no rows give no rows.
    A Python worker remembers the ids of up to memo_words words.
    """
    spark = docs.sparkSession
    n_buckets = buckets(spark)
    docs = docs.select("doc_id", "text")
    toks = stored(
        tokenized(docs, path, end, window, memo_words)
        .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "print", "n"), F.lit(n_buckets)).cast("int"))
        .withColumns({"full": F.expr(f"n div {window}"), "rest": (F.col("n") % window).cast("int")}),
        "pack-tokens",
    )
    # one row for each length and bucket: at most window times buckets, however many documents there are
    counts = stored(toks.groupBy("rest", "bucket").agg(F.count("*").alias("n"), F.sum("full").alias("full")), "pack-counts")
    histogram = np.zeros(window + 1, dtype=np.int64)
    n_full = 0
    for r in counts.groupBy("rest").agg(F.sum("n").alias("n"), F.sum("full").alias("full")).collect():  # at most `window` rows
        histogram[r["rest"]] = r["n"] if r["rest"] else 0
        n_full += r["full"]
    combos = combinations(histogram, window)
    used = repeat_counts(histogram, combos)
    places, taken, sequence = [], np.zeros(window + 1, dtype=np.int64), n_full
    for c, n in zip(combos, used, strict=True):
        offset = 0
        for length, k in c if n else ():
            # ranks [from, from + n * k) of this length: instance = (rank - from) div k, copy = the remainder
            places.append((length, int(taken[length]), int(taken[length] + n * k), sequence, k, offset))
            taken[length] += n * k
            offset += length * k
        sequence += int(n)
    plan = spark.createDataFrame(places, "rest int, rank_from long, rank_to long, sequence long, copies int, base int")
    planned = spark.createDataFrame([(int(a), int(taken[a])) for a in np.flatnonzero(taken)], "rest int, planned long")

    # Rank within length, and first sequence of the full windows: running sums over buckets, then within each.
    firsts = counts.select(
        "rest", "bucket",
        (F.sum("n").over(W.partitionBy("rest").orderBy("bucket")) - F.col("n")).alias("rank_base"),
    )
    if counts.count() <= 200_000:
        firsts = F.broadcast(firsts)  # beyond that Spark shuffles by both keys, which hold no more rows than a bucket
    full_bases = (
        counts.groupBy("bucket").agg(F.sum("full").alias("full"))
        .select("bucket", (F.sum("full").over(W.orderBy("bucket")) - F.col("full")).alias("full_base"))
    )
    order = ["doc_id", "print", "n"]
    in_length = W.partitionBy("bucket", "rest").orderBy(*order)
    in_bucket = W.partitionBy("bucket").orderBy("rest", *order).rowsBetween(W.unboundedPreceding, -1)
    ranked = (
        toks.withColumn("rank", F.row_number().over(in_length) - 1)
        .withColumn("full_at", F.coalesce(F.sum("full").over(in_bucket), F.lit(0)))
        .join(firsts, ["rest", "bucket"])
        .join(F.broadcast(full_bases), "bucket")
        .join(F.broadcast(planned), "rest", "left")
        .withColumns({
            "rank": F.col("rank") + F.col("rank_base"), "full_at": F.col("full_at") + F.col("full_base"),
            "left": (F.col("rest") > 0) & (F.col("rank") + F.col("rank_base") >= F.coalesce("planned", F.lit(0))),
        })
        .select("doc_id", "print", "n", "crcs", "bucket", "full", "rest", "rank", "full_at", "left")
    )
    ranked = stored(ranked, "pack-ranks")
    crc = F.element_at("crcs", -1)
    full = (
        ranked.where("full > 0")
        .select("doc_id", "n", "full_at", F.posexplode(F.slice("crcs", F.lit(1), F.col("full").cast("int"))).alias("i", "ids_crc32"))
        .select("doc_id", (F.col("i") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32",
                F.col("n").alias("doc_tokens"), (F.col("full_at") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    )
    start = (F.col("full") * window).alias("start")
    placed = (
        ranked.where("rest > 0 and not left")
        .join(F.broadcast(plan), ["rest"]).where("rank >= rank_from and rank < rank_to")
        .select("doc_id", start, F.col("rest").cast("long").alias("length"), crc.alias("ids_crc32"), F.col("n").alias("doc_tokens"),
                F.expr("sequence + (rank - rank_from) div copies").alias("sequence_id"),
                F.expr("cast(base + (rank - rank_from) % copies * rest as long)").alias("offset"))
    )
    rest = ranked.where("left")
    sums = rest.groupBy("bucket").agg(F.sum("rest").alias("size"))
    bases = sums.select("bucket", (F.sum("size").over(W.orderBy("bucket")) - F.col("size")).alias("base"))
    running = W.partitionBy("bucket").orderBy("rest", *order, "rank").rowsBetween(W.unboundedPreceding, 0)
    spread = (
        rest.withColumn("to", F.sum("rest").over(running)).join(F.broadcast(bases), "bucket")
        .withColumns({"to": F.col("to") + F.col("base"), "from": F.col("to") + F.col("base") - F.col("rest")})
        .withColumn("q", F.explode(F.sequence(F.expr(f"`from` div {window}"), F.expr(f"(`to` - 1) div {window}"))))
        .withColumns({"low": F.greatest(F.col("from"), F.col("q") * window), "high": F.least(F.col("to"), (F.col("q") + 1) * window)})
        .select("doc_id", "print", "n", (F.col("full") * window + F.col("low") - F.col("from")).alias("start"), (F.col("high") - F.col("low")).alias("length"),
                F.when(F.col("high") - F.col("low") == F.col("rest"), crc).alias("ids_crc32"), F.col("n").alias("doc_tokens"),
                (F.lit(sequence) + F.col("q")).alias("sequence_id"), (F.col("low") - F.col("q") * window).alias("offset"))
    )
    spread = stored(spread, "pack-spread")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    cut = spread.where("ids_crc32 is null").drop("ids_crc32")
    return (
        full.unionByName(placed).unionByName(spread.where("ids_crc32 is not null").select(*columns))
        .unionByName(_cut_pieces(docs, cut, path, end, memo_words).select(*columns)).select(*columns)
    )


def _cut_pieces(docs: DataFrame, cut: DataFrame, path: str, end: int, memo_words: int) -> DataFrame:
    """CRC-32 of pieces that end inside a document's rest: those documents, at most one for each window end, are tokenized again."""
    pieces = cut.groupBy("doc_id", "print").agg(F.collect_set(F.struct("start", "length")).alias("pieces"))
    texts = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("print", F.xxhash64("text"))
        .join(pieces.withColumnsRenamed({"doc_id": "d", "print": "p"}), F.expr("d <=> doc_id and p = print"))
        .dropDuplicates(["doc_id", "print"])
    )

    def encoder():
        memo, last = word_ids(path, memo_words), np.array([end], dtype="<u4").tobytes()

        def encode(texts: list[str], pieces: list[list[dict]]) -> list:
            out = []
            for text, spans in zip(texts, pieces, strict=True):
                ids = memo.encode(text) + last
                out.append([zlib.crc32(ids[4 * x["start"]:4 * (x["start"] + x["length"])]) for x in spans])
            return [out]

        return encode

    sums = append(texts.select("doc_id", "print", "text", "pieces"), ["text", "pieces"], "sums array<long>", encoder, ("text",))
    sums = sums.select("doc_id", "print", F.explode(F.arrays_zip("pieces", "sums")).alias("x"))
    sums = sums.select("doc_id", "print", F.col("x.pieces.start").alias("start"), F.col("x.pieces.length").alias("length"), F.col("x.sums").alias("ids_crc32"))
    sums = sums.withColumnsRenamed({"doc_id": "d", "print": "p", "start": "s", "length": "l"})
    return cut.join(sums, F.expr("d <=> doc_id and p = print and s = start and l = length"), "left")
