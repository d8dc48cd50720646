"""WARC archives: written from pages, read back by following the chain of record boundaries.

Archives are plain WARC/1.0 text. Reading splits a file at every `WARC/1.0` line, in
parallel byte ranges; each piece is a candidate record whose header names its successor's
offset. Within a byte range the chains are followed at once; across ranges the exits are
followed by pointer jumping from offset 0, in as many rounds as the logarithm of the
ranges. Only records reached from the start of their file stay: the same line inside a
payload is a candidate that nothing points to.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import few, new_path, shared_dir, stored

MAGIC = "WARC/1.0\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def sha1_base32(col):
    """Upper-case base32 of the SHA-1: each five hex digits are four of base 32."""
    digits = F.sha1(col)
    four = [F.lpad(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*four)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """One record for each row of pages(page_id, url, html), as archives under path.

    Of rows with equal payloads (by SHA-1) of at least min_bytes, that with the largest
    page_id is written as response, the others as revisit records without payload. A null
    html is an empty payload, a null url an empty one; line breaks in a url become %0D and
    %0A. Repeated rows give a record each, all responses if they hold the largest page_id;
    a null page_id is smaller than any other.
    """
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", sha1_base32(F.col("html").cast("binary")))
    first = stored(rows.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies"), "warc-first")
    rows = rows.join(few(first), "digest", "left")
    revisit = (
        F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.octet_length("html") >= min_bytes)
    )
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    block = F.when(revisit, F.lit("")).otherwise(F.concat(F.lit(HTTP), "html"))
    head = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), name,
        F.lit(">\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), "digest",
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    # The writer ends each row with \n, the last byte of the blank lines that end a record.
    rows.select(F.concat(head, block, F.lit("\r\n\r")).alias("value")).write.text(path)


def _chains(pdf: pd.DataFrame) -> pd.DataFrame:
    """Candidates of one byte range: where the chain that starts at each leaves the range."""
    pdf = pdf.sort_values("at", ignore_index=True)
    at, to = pdf["at"].to_numpy(), pdf["next"].to_numpy()
    there = np.searchsorted(at, to)
    inside = (there < len(at)) & (at[np.minimum(there, len(at) - 1)] == to)
    out = to.copy()
    for i in np.flatnonzero(inside)[::-1]:
        out[i] = out[there[i]]
    return pd.DataFrame({"file": pdf["file"], "span": pdf["span"], "at": at, "exit": out})


def _reached(key, cands: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
    """Candidates of one byte range that a chain from one of the entries passes."""
    nexts = dict(zip(cands["at"], cands["next"], strict=True))
    kept = []
    for e in entries["at"].sort_values():
        while e in nexts:
            kept.append(e)
            e = nexts.pop(e)
    return pd.DataFrame({"file": key[0], "at": np.array(kept, dtype="int64")})


def read_records(spark: SparkSession, path: str, summary: dict[str, Column] | None = None) -> DataFrame:
    """Records under path: file, at (byte offset), header (without the version line), block (bytes).

    With summary (columns of header and block) those columns stand in place of the two.

    A candidate without a Content-Length has no successor; reading of its file ends there.
    An empty folder or file gives no rows.
    """
    shared_dir(spark)
    size = len(MAGIC)
    text = (
        spark.read.option("lineSep", MAGIC).text(path)
        .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("span"))
        .withColumn("row", F.monotonically_increasing_id())
    )
    pieces = text.withColumns({"bytes": F.octet_length("value").cast("long"), "head": F.substring_index("value", "\r\n\r\n", 1)})
    if summary is not None:
        both = pieces.select("*", *_parsed())
        pieces = both.withColumn("summary", F.struct(*[c.alias(n) for n, c in summary.items()])).drop("header", "block")
    pieces = stored(pieces, "warc-pieces")
    in_block = W.partitionBy("file", "span").orderBy("row")
    blocks = pieces.groupBy("file", "span").agg(F.sum(F.col("bytes") + size).alias("size"))
    starts = blocks.withColumn("base", F.sum("size").over(W.partitionBy("file").orderBy("span")) - F.col("size")).drop("size")
    starts = few(stored(starts, "warc-ranges"))  # one row for each byte range of the scan
    cands = (
        pieces.select("file", "span", "row", "bytes", F.octet_length("head").alias("head_bytes"), content_length("head").alias("length"))
        .withColumn("within", F.sum(F.col("bytes") + size).over(in_block) - F.col("bytes") - size)
        .join(starts, ["file", "span"])
        .withColumn("at", F.col("base") + F.col("within") - size)
        .withColumn("next", F.coalesce(F.col("at") + size + F.col("head_bytes") + 4 + F.col("length") + 4, F.lit(-1)))
        .where("at >= 0").select("file", "span", "row", "at", "next")
    )
    cands = stored(cands, "warc-candidates")
    jump = cands.select("file", "span", "at", "next").groupBy("file", "span").applyInPandas(_chains, "file string, span long, at long, exit long")
    jump = jump.select("file", "at", "exit").checkpoint()
    most = blocks.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    seen = jump.where("at = 0").select("file", "at")
    for _ in range(math.ceil(math.log2(most + 1)) if most else 0):
        step = seen.join(jump, ["file", "at"]).select("file", F.col("exit").alias("at"))
        seen = seen.union(step).distinct().checkpoint()
        over = jump.select("file", F.col("at").alias("exit"), F.col("exit").alias("further"))
        jump = jump.join(over, ["file", "exit"]).select("file", "at", F.col("further").alias("exit")).checkpoint()
    seen = seen.join(cands.select("file", "span", "at"), ["file", "at"]).checkpoint()
    reached = (
        cands.select("file", "span", "at", "next").groupBy("file", "span")
        .cogroup(seen.groupBy("file", "span")).applyInPandas(_reached, "file string, at long")
    )
    # Pieces after a record and before the next belong to its payload.
    in_file = W.partitionBy("file").orderBy("at")
    owner = (
        cands.select("file", "span", "row", "at").join(reached.withColumn("record", F.col("at")), ["file", "at"], "left")
        .withColumn("record", F.last("record", ignorenulls=True).over(in_file))
        .where("record is not null")
        .withColumn("n", F.count("*").over(W.partitionBy("file", "record")))
    )
    owner = stored(owner, "warc-owners")
    whole = pieces.join(owner.where("n = 1"), ["file", "span", "row"]).select("file", F.col("record").alias("at"), "value")
    split = pieces.select("file", "span", "row", "value").join(few(owner.where("n > 1")), ["file", "span", "row"])
    parts = F.array_sort(F.collect_list(F.struct("at", "value")))
    joined = split.groupBy("file", "record").agg(F.array_join(F.transform(parts, lambda p: p["value"]), MAGIC).alias("value"))
    if summary is None:
        return whole.unionByName(joined.withColumnRenamed("record", "at")).select("file", "at", *_parsed())
    # Whole pieces were summed up in the scan: only those of split records carry their text through a shuffle.
    done = pieces.drop("value").join(owner.where("n = 1"), ["file", "span", "row"]).select("file", F.col("record").alias("at"), "summary.*")
    again = joined.select("file", F.col("record").alias("at"), *_parsed()).select("file", "at", *[c.alias(n) for n, c in summary.items()])
    return done.unionByName(again)


def content_length(header) -> Column:
    """The Content-Length of a header, up to 18 digits; null where it has none."""
    return F.nullif(F.regexp_extract(header, r"(?i)(?:^|\r\n)Content-Length:[ \t]*([0-9]{1,18})[ \t]*(?:\r\n|$)", 1), F.lit("")).cast("long")


def _parsed() -> list:
    """header and block of a record's text. A string of Spark ends before 2^31 bytes, and so does a block."""
    header = F.substring_index("value", "\r\n\r\n", 1)
    length = F.least(content_length(header), F.lit(2_147_483_647)).cast("int")
    return [header.alias("header"), F.substring(F.col("value").cast("binary"), F.octet_length(header) + 5, length).alias("block")]


def read_pages(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Pages of the archives: page_id, url, record_type, refers_to, payload_digest, payload_bytes and, if wanted, payload.

    Digest and size of a response come from its payload; those of a revisit from its
    header and from the response with that digest.
    """
    def field(name: str):
        return F.regexp_extract("header", rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)

    def page(name: str):
        return F.nullif(F.regexp_extract("header", rf"(?:^|\r\n){name}: <urn:page:(-?[0-9]+)>", 1), F.lit("")).cast("long")

    response = field("WARC-Type") == "response"
    body = F.when(response, F.expr(f"substring(block, {len(HTTP) + 1})"))
    columns = {
        "page_id": page("WARC-Record-ID"), "url": field("WARC-Target-URI"), "record_type": field("WARC-Type"), "refers_to": page("WARC-Refers-To"),
        "payload_digest": F.when(response, sha1_base32(body)).otherwise(F.regexp_extract("header", r"WARC-Payload-Digest: sha1:([A-Z2-7]+)", 1)),
        "payload_bytes": F.octet_length(body).cast("long"),
    }
    if payload:
        r = read_records(spark, path).select(*[c.alias(n) for n, c in columns.items()], body.alias("payload"))
    else:
        r = read_records(spark, path, columns).drop("file", "at")
    r = stored(r, "warc-pages")
    sizes = r.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("full"))
    revisits = r.where("record_type = 'revisit'").join(sizes, "payload_digest", "left").withColumn("payload_bytes", F.col("full")).drop("full")
    return r.where("record_type <> 'revisit'").unionByName(revisits)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages written to archives in the shared folder and read back: one row for each record, without the payload."""
    path = new_path(pages.sparkSession, "warc")
    write_warc(pages, path, min_bytes)
    return read_pages(pages.sparkSession, path, payload=False)
