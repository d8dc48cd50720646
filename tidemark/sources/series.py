"""Series in long form, points(series_id, ts, value), read from the star-schema tables.

Sums of prices are taken as decimals, so they do not depend on the order of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _total(column: str):
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double")


def monthly_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: order value per month; the last month is partial and goes."""
    o = table(spark, sf_dir, "orders").select(F.last_day(F.col("o_orderdate").cast("date")).alias("ts"), "o_totalprice")
    m = o.groupBy("ts").agg(_total("o_totalprice").alias("value"))
    last = o.agg(F.max("ts").alias("last"))
    return m.join(F.broadcast(last), F.col("ts") < F.col("last")).select(F.lit("orders").alias("series_id"), "ts", "value")


def monthly_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: order value per month and market segment, without the partial last month."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.last_day(F.col("o_orderdate").cast("date")).alias("ts"), "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    m = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("series_id"), "ts").agg(_total("o_totalprice").alias("value"))
    last = o.agg(F.max("ts").alias("last"))
    return m.join(F.broadcast(last), F.col("ts") < F.col("last")).select("series_id", "ts", "value")


def daily_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: mean line price per day and return flag, used as three prices."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_shipdate").cast("date").alias("ts"), "l_extendedprice")
    return li.groupBy(F.col("l_returnflag").alias("series_id"), "ts").agg((_total("l_extendedprice") / F.count("*")).alias("value"))


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H5: mean event value per hour and event type; ts is a timestamp."""
    e = table(spark, sf_dir, "events").select("event_type", F.date_trunc("hour", "ts").alias("ts"), "value")
    return e.groupBy(F.col("event_type").alias("series_id"), "ts").agg((_total("value") / F.count("*")).alias("value"))


def by_series() -> W:
    return W.partitionBy("series_id").orderBy("ts")


def whole_series() -> W:
    return W.partitionBy("series_id")
