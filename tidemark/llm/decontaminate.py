"""Benchmark decontamination over a positional inverted index.

The index has one row for each shard of documents and each term: the term's positions in
the shard, in order. A shard is a run of whole documents of one task, cut at a bounded
number of words, with one free position between documents, so no phrase crosses two. A
search takes each phrase's terms from the rarest of the corpus on, shifts each list by the
term's place in the phrase, and intersects; what is left after the last term are exact
occurrences. Shards are searched apart, so a frequent term or a hot source is only ever as
large as one shard's list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import lean, LOWER, stored

#: Bytes that end a word (all ASCII but digits and letters) become blanks, A-Z become a-z.
_WORDS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in LOWER)
_INDEX = "shard string, term binary, n_docs long, at binary, doc_ids array<long>, starts array<long>, sizes array<long>"


def words(text: str | None) -> list[bytes]:
    """Words of a text: runs of digits, a-z and characters outside ASCII, A-Z lower-cased; a null text has none."""
    return text.encode().translate(_WORDS).split() if text else []


class _Terms(dict):
    """Numbers terms as they come."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


def build_index(docs: DataFrame, terms: set[bytes] | None = None, shard_words: int = 1_000_000) -> DataFrame:
    """The stored index of docs(doc_id, text).

    Postings of all terms, or of those given alone. Each
    document is once in the row of its shard whose term is null, with its id, first
    position and number of words; empty and null texts have 0 words, repeated rows are
    documents of their own, other columns are ignored. A text longer than a shard is a
    shard of its own. No rows give an empty index.
    """
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    schema = T.StructType.fromDDL(_INDEX)
    arrow, names_of = [to_arrow_type(f.dataType) for f in schema], schema.names

    def shard(name: str, batch: list[tuple]) -> pa.RecordBatch:
        ids = _Terms() if sent.value is None else {t: i for i, t in enumerate(sent.value)}
        code = ids.__getitem__ if sent.value is None else lambda w: ids.get(w, -1)
        parts, starts, sizes, at = [], [], [], 0
        for _, ws in batch:
            codes = np.fromiter(map(code, ws), dtype=np.int32, count=len(ws))
            hit = np.flatnonzero(codes >= 0)
            parts.append((codes[hit], (hit + at).astype(np.int32), np.full(len(hit), len(starts), dtype=np.int32)))
            starts.append(at)
            sizes.append(len(ws))
            at += len(ws) + 1
        code, pos, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(code, kind="stable")
        code, pos, doc = code[order], pos[order], doc[order]
        first = np.r_[True, code[1:] != code[:-1]][:len(code)]
        begin = np.flatnonzero(first)
        n = len(begin)
        n_docs = np.add.reduceat(first | np.r_[True, doc[1:] != doc[:-1]][:len(doc)], begin, dtype=np.int64) if n else begin
        names = list(ids)
        lists = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.r_[begin, len(code)] * 4).astype(np.int32)), pa.py_buffer(pos.tobytes())])
        columns = (
            [name] * (n + 1), [names[c] for c in code[begin]] + [None], np.r_[n_docs, len(batch)],
            pa.concat_arrays([lists, pa.nulls(1, pa.binary())]), *([None] * n + [x] for x in ([d for d, _ in batch], starts, sizes)),
        )
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(columns, arrow, strict=True)], names=names_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, k = [], 0, 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ws = words(text)
                if held and n + len(ws) > shard_words:
                    yield shard(f"{part}-{k}", held)
                    held, n, k = [], 0, k + 1
                held.append((doc_id, ws))
                n += len(ws)
        if held:
            yield shard(f"{part}-{k}", held)

    return stored(docs.select("doc_id", "text").mapInArrow(lean(run), _INDEX), "postings")


def _find(lists: dict[bytes, np.ndarray], phrase: tuple[bytes, ...], order: list[int]) -> np.ndarray:
    """First positions of the phrase in one shard; order: its places from the rarest term on."""
    found = None
    for i in order:
        at = lists.get(phrase[i])
        if at is None:
            return np.zeros(0, dtype=np.int32)
        if found is None:
            found = at - i
        else:
            there = np.searchsorted(at, found + i)
            found = found[(there < len(at)) & (at[np.minimum(there, len(at) - 1)] == found + i)]
        if not len(found):
            break
    return found


def _near(lists: dict[bytes, np.ndarray], phrase: tuple[bytes, ...], order: list[int], starts: np.ndarray, slop: int) -> np.ndarray:
    """Positions of the phrase's rarest word that have each other word of it within `slop` words in the same document."""
    terms = list(dict.fromkeys(phrase[i] for i in order))
    found = lists.get(terms[0], np.zeros(0, dtype=np.int32))
    for w in terms[1:]:
        at = lists.get(w)
        if at is None or not len(found):
            return np.zeros(0, dtype=np.int32)
        i = np.searchsorted(at, found)
        doc = np.searchsorted(starts, found, side="right")
        near = np.zeros(len(found), dtype=bool)
        for j in (np.maximum(i - 1, 0), np.minimum(i, len(at) - 1)):
            near |= (np.abs(at[j] - found) <= slop) & (np.searchsorted(starts, at[j], side="right") == doc)
        found = found[near]
    return found


def _searcher(sent, slop: int | None):
    """The function that searches one shard for the phrases of one block."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = {bytes(t): np.frombuffer(a, dtype=np.int32) for t, a in zip(pdf["term"], pdf["at"], strict=True) if t is not None}
        own = pdf[pdf["term"].isna()].iloc[0]
        starts = np.asarray(own["starts"])
        hits: dict[int, tuple[list, set]] = {}
        for phrase, order, ids in sent.value:
            at = _find(lists, phrase, order) if slop is None else _near(lists, phrase, order, starts, slop)
            docs_of = np.searchsorted(starts, at, side="right") - 1
            for p, d in zip(at, docs_of, strict=True):
                places, found_ids = hits.setdefault(int(d), ([], set()))
                places.append((int(p - starts[d]), len(phrase) if slop is None else 1))
                found_ids.update(ids)
        rows = []
        for d, (places, found_ids) in sorted(hits.items()):
            spots = np.unique(np.concatenate([np.arange(p, p + n) for p, n in set(places)]))
            rows.append((own["shard"], d, spots.tolist(), sorted(found_ids)))
        return pd.DataFrame(rows, columns=["shard", "doc", "hit", "item_ids"])

    return run


def search(index: DataFrame, items: DataFrame, width: int = 10, slop: int | None = None, block_rows: int = 20_000, block_bytes: int = 32 << 20) -> DataFrame:
    """Documents of the index with what occurs in them of items(item_id, text).

    An item's phrases are its windows of `width` words, or the whole of a shorter one.
    slop None: exact occurrences. Otherwise a phrase matches around a place of its rarest
    word that has each of its words at most `slop` words away; that word is hit.
    Rows: shard, doc (place in the shard), doc_id, n_words, hit (sorted places of words
    hit) and item_ids (sorted), for every document. Items without words or without an id
    match nothing; repeated items count once. The items go to the shards in blocks of
    about block_rows rows and at most about block_bytes of text, whatever their number.
    """
    spark = index.sparkSession
    postings = index.where("term is not null")
    docs = index.where("term is null")
    blocks = items.where("item_id is not null and text is not null").select("item_id", "text")
    size = blocks.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("bytes")).first()
    n_blocks = max(1, -(-size["rows"] // block_rows), -(-size["bytes"] // block_bytes))
    found = []
    for b in range(n_blocks):
        block = blocks.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b).collect()  # about block_rows rows
        phrases: dict[tuple, set] = {}
        for r in block:
            ws = words(r["text"])
            for i in range(max(1, len(ws) - width + 1) if ws else 0):
                phrases.setdefault(tuple(ws[i:i + width]), set()).add(r["item_id"])
        terms = sorted({w for p in phrases for w in p})
        asked = F.broadcast(spark.createDataFrame([(t,) for t in terms], "term binary"))
        wanted = postings.join(asked, "term", "left_semi")
        rarity = {bytes(r["term"]): r["n"] for r in wanted.groupBy("term").agg(F.sum("n_docs").alias("n")).collect()}  # one row for each asked term
        orders = [sorted(range(len(p)), key=lambda i, p=p: (rarity.get(p[i], 0), p[i], i)) for p in phrases]
        sent = spark.sparkContext.broadcast(list(zip(phrases, orders, phrases.values(), strict=True)))

        part = wanted.unionByName(docs).groupBy("shard").applyInPandas(lean(_searcher(sent, slop)), "shard string, doc int, hit array<int>, item_ids array<long>")
        found.append(part)
    hits = found[0]
    for part in found[1:]:
        hits = hits.unionByName(part)
    if len(found) > 1:
        hits = hits.groupBy("shard", "doc").agg(
            F.sort_array(F.array_distinct(F.flatten(F.collect_list("hit")))).alias("hit"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        )
    every = docs.select("shard", F.posexplode(F.arrays_zip("doc_ids", "sizes")).alias("doc", "of")).select(
        "shard", "doc", F.col("of.doc_ids").alias("doc_id"), F.col("of.sizes").alias("n_words")
    )
    empty_hit, empty_ids = F.expr("cast(array() as array<int>)"), F.expr("cast(array() as array<long>)")
    return every.join(hits, ["shard", "doc"], "left").withColumns(
        {"hit": F.coalesce("hit", empty_hit), "item_ids": F.coalesce("item_ids", empty_ids)}
    )


def contamination(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """docs(doc_id, text) with n_words, n_hit (words inside an occurrence of a window of an item), item_ids and contaminated.

    All terms of the documents are indexed. Null and empty texts have no words and are
    clean; each row, repeated or not, gives one row; items without a text or an id match
    nothing; other columns are dropped; no rows give no rows.
    """
    index = build_index(docs)
    return search(index, items, width).select(
        "doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), "item_ids", (F.size("hit") > 0).alias("contaminated")
    )
