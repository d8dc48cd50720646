"""The corpus pipeline: toxicity, n-gram Jaccard join, benchmark decontamination, secret scan, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame with the columns of documents, the last one the pieces of the packed sequences.
run() writes what a stage returns as Parquet in the shared folder and reads it again for
the next. Null and repeated doc_ids are rows like others; null and empty texts are clean;
further columns go through, whatever they are called.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard, packing, secrets, toxicity
from tidemark.llm.common import few, new_path, set_aside, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    docs, back = set_aside(docs, "doc_id", "text")
    return toxicity.toxicity(docs, labels).where("toxic_score < 0.5").select(*docs.columns).withColumnsRenamed(back)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar texts: the one with the smallest doc_id."""
    return jaccard.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item's window of ten words; rows are told apart by 64 bits of doc_id and text."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    docs, back = set_aside(docs, "doc_id", "text")
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    hit = decontaminate.contamination(keyed.select(F.col("_key").alias("doc_id"), "text"), items).where("contaminated")
    hit = few(stored(hit.select(F.col("doc_id").alias("_key")).distinct(), "contaminated"), 500_000)
    return keyed.join(hit, "_key", "left_anti").select(*docs.columns).withColumnsRenamed(back)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked and n_chars counted again."""
    masked = secrets.masked(docs)
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else masked


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the token sequences; workers remember fewer words, as they hold what the stages before left too."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), memo_words=100_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: The first stage's network can't be written in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = new_path(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
