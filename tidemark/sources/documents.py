"""JSON documents on disk: a folder of JSON lines by part, and a manifest that names each document and its hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Written last, so a folder without it was not finished.
MANIFEST = "manifest"
_MANIFEST = "key string, part string, sha256 string"


def write_documents(documents: DataFrame, path: str) -> None:
    """documents(key, part, document): each document a line of path/data/part=..., each key, part and SHA-256 of its line a line of path/manifest.

    Line ends inside a document, which JSON has no use for, become blanks; null documents
    are left out; a null part is the part none. The folder must not exist. Documents are
    hashed where they are and written once; keys and hashes alone are written twice.
    """
    d = documents.where("document is not null").select(F.col("key").cast("string").alias("key"), F.coalesce("part", F.lit("none")).alias("part"), F.regexp_replace("document", "[\r\n]+", " ").alias("value"))
    d.select("part", "value").write.partitionBy("part").text(f"{path}/data")
    d.select("key", "part", F.sha2("value", 256).alias("sha256")).write.json(f"{path}/{MANIFEST}")


def read_documents(spark: SparkSession, path: str, schema: str | T.StructType) -> tuple[DataFrame, DataFrame]:
    """(documents, damaged) of a folder.

    documents(key, part, document: the parsed struct) are the lines whose hash is in the
    manifest and whose JSON has the schema. damaged(key, part, reason) names every other
    document of the manifest: `changed or missing` if no line has its hash, `not of the
    schema` if the text was written like that. Lines that nobody wrote are not read at all.
    """
    t = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    parsed = T.StructType([*t.fields, T.StructField("_corrupt", T.StringType())])
    lines = spark.read.schema("value string, part string").text(f"{path}/data")
    lines = lines.select(F.sha2("value", 256).alias("sha256"), F.from_json("value", parsed, {"columnNameOfCorruptRecord": "_corrupt"}).alias("document")).dropDuplicates(["sha256"])
    manifest = spark.read.schema(_MANIFEST).json(f"{path}/{MANIFEST}").dropDuplicates()
    both = manifest.join(lines, "sha256", "left")
    ok = F.col("document").isNotNull() & F.col("document._corrupt").isNull()
    good = both.where(ok).select("key", "part", F.col("document").dropFields("_corrupt").alias("document"))
    reason = F.when(F.col("document").isNull(), "changed or missing").otherwise("not of the schema")
    return good, both.where(~F.coalesce(ok, F.lit(False))).select("key", "part", reason.alias("reason"))
