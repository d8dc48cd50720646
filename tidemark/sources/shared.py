"""Tables kept in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local session gets a temporary folder, on a cluster that is an error."""
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir", "")
    if not sc.getCheckpointDir():
        if not given and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="tidemark-"))
    return (given or sc.getCheckpointDir()).rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df computed once, into the shared folder, and read from there: several uses of it read, none computes again."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
