"""Alignment of series: duplicates, common dates, month ends, as-of values, set operations on dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def keep_last(points: DataFrame, position: str) -> DataFrame:
    """Of points with the same series and date, the one with the largest position."""
    return points.groupBy("series_id", "ts").agg(F.max_by("value", position).alias("value"))


def common_dates(points: DataFrame) -> DataFrame:
    """Points on the dates that every series has: the series of a date are counted beside its points, no chain of joins."""
    k = points.agg(F.count_distinct("series_id").alias("_k"))
    n = F.size(F.collect_set("series_id").over(W.partitionBy("ts")))
    return points.withColumn("_n", n).join(F.broadcast(k), F.col("_n") == F.col("_k")).select("series_id", "ts", "value")


def wide(points: DataFrame, names: list[str]) -> DataFrame:
    """One row a date, one column for each of the named series; rows with all of them only."""
    cols = [F.max(F.when(F.col("series_id") == n, F.col("value"))).alias(n) for n in names]
    return points.where(F.col("series_id").isin(names)).groupBy("ts").agg(*cols).dropna()


def median_gap(points: DataFrame) -> DataFrame:
    """Median number of days between neighbouring dates, and the number of points."""
    w = W.partitionBy("series_id").orderBy("ts")
    g = points.select("series_id", F.datediff("ts", F.lag("ts").over(w)).alias("gap"))
    return g.groupBy("series_id").agg(F.median("gap").alias("median_gap"), F.count("*").alias("n"))


def frequency(points: DataFrame) -> DataFrame:
    """Frequency by the median gap; fewer than three points are irregular."""
    g = F.col("median_gap")
    name = (
        F.when(F.col("n") < 3, "irregular").when(g <= 4, "daily").when(g.between(5, 10), "weekly").when(g.between(25, 35), "monthly")
        .when(g.between(80, 100), "quarterly").when(g.between(350, 380), "annual").otherwise("irregular")
    )
    return median_gap(points).select("series_id", "median_gap", "n", name.alias("frequency"))


def lower_to_months(points: DataFrame) -> DataFrame:
    """Common dates; if any series has a median gap over 15 days, of the last values of the months."""
    slow = median_gap(points).agg(F.coalesce(F.bool_or(F.floor("median_gap") > 15), F.lit(False)).alias("slow"))
    tagged = points.join(F.broadcast(slow)).withColumn("at", F.when(F.col("slow"), F.last_day("ts")).otherwise(F.col("ts")))
    monthly = tagged.groupBy("series_id", F.col("at")).agg(F.max_by("value", "ts").alias("value"))
    return common_dates(monthly.withColumnRenamed("at", "ts"))


def side_by_side(a: DataFrame, b: DataFrame, last: int = 250) -> DataFrame:
    """Union of the dates of two series, the last so many; null where a series has no value."""
    both = a.select("ts", F.col("value").alias("a")).join(b.select("ts", F.col("value").alias("b")), "ts", "full_outer")
    return both.orderBy(F.desc("ts")).limit(last)


def year_before(points: DataFrame, days: int = 365) -> DataFrame:
    """The last value and the value at or before `days` earlier, and the change."""
    last = points.groupBy("series_id").agg(F.max("ts").alias("last_ts"), F.max_by("value", "ts").alias("last_value"))
    before = points.join(last, "series_id").where(F.col("ts") <= F.date_sub("last_ts", days)).groupBy("series_id").agg(
        F.max("ts").alias("before_ts"), F.max_by("value", "ts").alias("before_value"))
    return last.join(before, "series_id", "left").withColumns({
        "change": F.col("last_value") - F.col("before_value"),
        "change_pct": F.when(F.col("before_value") != 0, (F.col("last_value") / F.col("before_value") - 1) * 100),
    })


def date_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Dates of either side with where they are: both, left or right."""
    both = a.select("ts").distinct().withColumn("l", F.lit(1)).join(b.select("ts").distinct().withColumn("r", F.lit(1)), "ts", "full_outer")
    return both.select("ts", F.when(F.col("l").isNull(), "right").when(F.col("r").isNull(), "left").otherwise("both").alias("side"))


def visible(points: DataFrame, last: int, days: int | None = None) -> DataFrame:
    """The last observations of each series by number, or by days before its last date."""
    if days is not None:
        end = F.max("ts").over(W.partitionBy("series_id"))
        return points.withColumn("_end", end).where(F.col("ts") >= F.date_sub("_end", days)).drop("_end")
    w = W.partitionBy("series_id").orderBy(F.desc("ts"))
    return points.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= last).drop("_rn")
