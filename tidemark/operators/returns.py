"""Returns, differences and normalisations of points(series_id, ts, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.sources.series import by_series, whole_series


def log_returns(points: DataFrame) -> DataFrame:
    """ln(p_t / p_t-1); the first of each series and non-positive prices drop out."""
    before = F.lag("value").over(by_series())
    ok = (F.col("value") > 0) & (before > 0)
    return points.withColumn("r", F.when(ok, F.ln(F.col("value") / before))).where("r is not null").select("series_id", "ts", "r")


def simple_returns(points: DataFrame) -> DataFrame:
    before = F.lag("value").over(by_series())
    return points.withColumn("r", (F.col("value") - before) / F.greatest(before, F.lit(1e-12))).where("r is not null").select("series_id", "ts", "r")


def stationary_changes(points: DataFrame) -> DataFrame:
    """Log differences of a series that is positive throughout, relative changes of any other."""
    before = F.lag("value").over(by_series())
    positive = F.min("value").over(whole_series()) > 0
    change = F.when(positive, F.ln(F.try_divide("value", before))).otherwise(F.try_divide(F.col("value") - before, before))
    return points.withColumn("r", change).where("r is not null").select("series_id", "ts", "r")


def model_differences(points: DataFrame) -> DataFrame:
    """First differences of the log of a positive series, of the level of any other."""
    level = F.when(F.min("value").over(whole_series()) > 0, F.ln("value")).otherwise(F.col("value"))
    x = points.withColumn("level", level)
    return x.withColumn("d", F.col("level") - F.lag("level").over(by_series())).where("d is not null").select("series_id", "ts", "d")


def base_100(points: DataFrame) -> DataFrame:
    """Each series as a percentage of its first value; base 1 where that is null or zero."""
    first = F.first("value").over(by_series().rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    base = F.when(first.isNull() | (first == 0), F.lit(1.0)).otherwise(first)
    return points.select("series_id", "ts", (F.col("value") / base * 100).alias("value"))


def wealth(returns: DataFrame) -> DataFrame:
    """exp of the running sum of log returns, its running peak (without a starting 1) and the drawdown."""
    w = by_series().rowsBetween(W.unboundedPreceding, W.currentRow)
    x = returns.withColumn("curve", F.exp(F.sum("r").over(w)))
    return x.withColumn("drawdown", F.col("curve") / F.max("curve").over(w) - 1)


def equity_drawdown(points: DataFrame) -> DataFrame:
    """Drawdown of a value curve from its running peak, the start included."""
    peak = F.greatest(F.max("value").over(by_series().rowsBetween(W.unboundedPreceding, W.currentRow)), F.lit(1e-12))
    return points.select("series_id", "ts", ((F.col("value") - peak) / peak).alias("drawdown"))


def horizon_move(points: DataFrame, h: int) -> DataFrame:
    """Largest absolute log move over h steps (the series' length less one, if shorter)."""
    n = F.count("*").over(whole_series())
    at = F.row_number().over(by_series())
    x = points.select("series_id", "value", at.alias("at"), F.least(F.lit(h), n - 1).alias("h"))
    ahead = x.select("series_id", (F.col("at") - F.col("h")).alias("at"), F.col("value").alias("ahead"))
    return x.join(ahead, ["series_id", "at"]).where("value > 0 and ahead > 0 and h > 0").groupBy("series_id").agg(F.max(F.abs(F.ln(F.col("ahead") / F.col("value")))).alias("max_move"))


def jump_flag(points: DataFrame, times: float = 4.0) -> DataFrame:
    """Whether a series ends in a jump: its last step is over `times` robust deviations (1.4826 MAD) of the steps before."""
    d = model_differences(points)
    back = W.partitionBy("series_id").orderBy(F.desc("ts"))
    d = d.withColumn("rn", F.row_number().over(back))
    mid = d.where("rn > 1").groupBy("series_id").agg(F.median("d").alias("mid"))
    mad = d.where("rn > 1").join(mid, "series_id").groupBy("series_id").agg((F.median(F.abs(F.col("d") - F.col("mid"))) * 1.4826).alias("scale"))
    last = d.where("rn = 1").select("series_id", "d")
    return last.join(mad, "series_id").select("series_id", F.col("d").alias("last_step"), "scale", (F.abs("d") > F.lit(times) * F.col("scale")).alias("jump"))


def top_moves(points: DataFrame, n: int = 5) -> DataFrame:
    """The n largest absolute steps of each series, with the date after."""
    d = model_differences(points).withColumn("next_ts", F.lead("ts").over(by_series()))
    order = W.partitionBy("series_id").orderBy(F.desc(F.round(F.abs("d"), 9)), "ts")
    return d.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
