"""Autocorrelation, the test for a season, and seasonal scales."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .align import frequency
from .returns import model_differences


def autocorrelation(changes: DataFrame, lags: int) -> DataFrame:
    """Biased autocorrelation of changes(series_id, ts, d) at lags 1 to `lags`; null for a constant series."""
    w = W.partitionBy("series_id").orderBy("ts")
    x = changes.withColumn("x", F.col("d") - F.avg("d").over(W.partitionBy("series_id")))
    x = x.withColumn("products", F.array(*[F.col("x") * F.lag("x", k).over(w) for k in range(1, lags + 1)]))
    shifted = x.select("series_id", "x", F.posexplode("products").alias("k", "xx"))
    sums = shifted.groupBy("series_id", (F.col("k") + 1).alias("lag")).agg(F.sum("xx").alias("s"), F.sum(F.col("x") * F.col("x")).alias("s0"), F.count("*").alias("n"))
    return sums.select("series_id", "lag", "n", F.when(F.col("s0") > 0, F.coalesce("s", F.lit(0.0)) / F.col("s0")).alias("acf"))


def seasonal_test(points: DataFrame) -> DataFrame:
    """Whether the autocorrelation of the differences at the season stands out.

    The season is 12 for monthly and 4 for quarterly series, others have none. It stands
    out when it is over 1.645 times the square root of (1 + twice the sum of squares of
    the lags before) by the number of differences, and there are three seasons of them.
    """
    f = frequency(points).withColumn("period", F.when(F.col("frequency") == "monthly", 12).when(F.col("frequency") == "quarterly", 4))
    d = model_differences(points).join(f.where("period is not null").select("series_id"), "series_id", "left_semi")
    a = autocorrelation(d, 12).join(f.select("series_id", "period"), "series_id").where("lag <= period")
    t = a.groupBy("series_id").agg(
        F.max("n").alias("n_diffs"),
        F.max(F.when(F.col("lag") == F.col("period"), F.col("acf"))).alias("acf_at_period"),
        F.sqrt((1 + 2 * F.sum(F.when(F.col("lag") < F.col("period"), F.col("acf") * F.col("acf")).otherwise(0.0))) / F.max("n")).alias("se"),
    )
    return f.join(t, "series_id", "left").select(
        "series_id", "frequency", "period", "acf_at_period", (F.col("se") * 1.645).alias("threshold"),
        F.coalesce((F.col("n_diffs") >= 3 * F.col("period")) & (F.col("acf_at_period") > F.col("se") * 1.645), F.lit(False)).alias("is_seasonal"),
    )


def seasonal_scale(points: DataFrame, m: int) -> DataFrame:
    """Mean absolute difference over m steps: the scale of the (seasonal) scaled error."""
    w = W.partitionBy("series_id").orderBy("ts")
    return points.select("series_id", F.abs(F.col("value") - F.lag("value", m).over(w)).alias("d")).groupBy("series_id").agg(F.avg("d").alias("scale"))
