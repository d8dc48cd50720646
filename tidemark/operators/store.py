"""Mutable tables as append-only logs: log(id, version, op, ...) with op put or delete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def current(log: DataFrame) -> DataFrame:
    """The latest version of each id that is not deleted."""
    w = W.partitionBy("id").orderBy(F.desc("version"))
    return log.withColumn("_rn", F.row_number().over(w)).where("_rn = 1 and op <> 'delete'").drop("_rn", "op")


def children(child: DataFrame, parents: DataFrame) -> DataFrame:
    """Children of parents that still are: a deleted parent takes its children along."""
    return child.join(parents.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")


def fresh(cache: DataFrame, now: str, ttl_seconds: int) -> DataFrame:
    """The newest entry of each key, and whether it is still in its time to live; its source stays what it was."""
    w = W.partitionBy("key").orderBy(F.desc("cached_at"), F.desc("entry"))
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("cached_at").cast("timestamp"))
    return cache.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn").withColumn("hit", age < ttl_seconds)


def stale(decisions: DataFrame, now: str, version: int = 10, days: int = 30, growth: float = 0.2, available: bool = False) -> DataFrame:
    """Decisions with whether they must be made again: old rules, old age, a series that grew, or (available) one made without the model that is there now (`challenger_error` null)."""
    old = F.datediff(F.lit(now).cast("date"), "evaluated_at") > days
    missed = F.col("challenger_error").isNull() if available else F.lit(False)
    return decisions.withColumn("stale", missed | (F.coalesce("version", F.lit(1)) < version) | old | (F.col("n_now") >= F.col("n_then") * (1 + growth)))
