"""Cutoffs, rivals, errors and verdicts of forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import holt


def spaced(n: Column, k: int, first: Column, last: Column) -> Column:
    """k evenly spaced indices from first to last, rounded half to even, without repeats."""
    at = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(first + i * (last - first) / max(1, k - 1)).cast("int"))
    return F.array_distinct(at)


def recent_cutoffs(points: DataFrame, k: int, horizon: int, window: int, least: int = 30) -> DataFrame:
    """(series_id, cutoff, place): k cutoffs in the last `window` points that leave `horizon` after them and at least `least` before."""
    w = W.partitionBy("series_id").orderBy("ts")
    x = points.select("series_id", "ts", (F.row_number().over(w) - 1).alias("place"))
    n = x.groupBy("series_id").agg(F.count("*").cast("int").alias("n"))
    last = F.col("n") - horizon - 1
    first = F.greatest(F.lit(least - 1), last - window)
    picks = n.where(last >= least - 1).select("series_id", F.explode(spaced(F.col("n"), k, first, last)).alias("place"))
    return x.join(picks, ["series_id", "place"]).select("series_id", F.col("ts").alias("cutoff"), "place")


def splits(points: DataFrame, cutoffs: DataFrame, horizon: int) -> tuple[DataFrame, DataFrame]:
    """Training points (up to the cutoff) and the first `horizon` points after it, with their step h, for each (series_id, cutoff)."""
    return _parts(points.join(F.broadcast(cutoffs.select("series_id", "cutoff")), "series_id"), horizon)


def splits_at(points: DataFrame, dates: tuple[str, ...], horizon: int) -> tuple[DataFrame, DataFrame]:
    """As splits(), at the same few dates for every series: no join, and one read of the points."""
    return _parts(points.withColumn("cutoff", F.explode(F.array(*[F.lit(d).cast("date") for d in dates]))), horizon)


def _parts(both: DataFrame, horizon: int) -> tuple[DataFrame, DataFrame]:
    train = both.where("ts <= cutoff")
    w = W.partitionBy("series_id", "cutoff").orderBy("ts")
    after = both.where("ts > cutoff").withColumn("h", F.row_number().over(w)).where(F.col("h") <= horizon)
    return train, after.select("series_id", "cutoff", "h", F.col("value").alias("actual"))


def per_cutoff(train: DataFrame) -> DataFrame:
    """Training points with series and cutoff as one series_id, for operators that know only series."""
    return train.select(F.concat_ws("|", "series_id", F.col("cutoff").cast("string")).alias("series_id"), "ts", "value")


def split_key(df: DataFrame) -> DataFrame:
    return df.withColumns({"cutoff": F.substring_index("series_id", "|", -1).cast("date"), "series_id": F.substring_index("series_id", "|", 1)})


def holt_forecasts(train: DataFrame, horizon: int, level: float, parameters: tuple[float, float, float] = holt.DEFAULT) -> DataFrame:
    arrays = holt.training_arrays(per_cutoff(train))
    return split_key(holt.forecast(holt.with_parameters(arrays, *parameters), horizon, level).select("series_id", "h", "value", "lower", "upper"))


def holt_forecasts_of(train: DataFrame, horizon: int, level: float, engines: dict[str, tuple[float, float, float]]) -> DataFrame:
    """Forecasts of several engines from one gathering of the training points: engine beside series_id, cutoff and h."""
    arrays = holt.training_arrays(per_cutoff(train))
    kinds = [F.struct(F.lit(n).alias("engine"), *[F.lit(float(v)).alias(k) for k, v in zip(("alpha", "beta", "phi"), p, strict=True)], holt.smooth(F.col("y"), *p).alias("state")) for n, p in engines.items()]
    fitted = arrays.withColumn("x", F.explode(F.array(*kinds))).select("*", "x.*").drop("x", "last_ts")
    return split_key(holt.forecast(fitted, horizon, level))


def naive_forecasts(train: DataFrame, horizon: int, z: float = 1.96) -> DataFrame:
    """The last value, with a cone of z population deviations of the steps times the root of h."""
    w = W.partitionBy("series_id", "cutoff").orderBy("ts")
    d = train.withColumn("d", F.col("value") - F.lag("value").over(w))
    g = d.groupBy("series_id", "cutoff").agg(F.max_by("value", "ts").alias("last"), F.stddev_pop("d").alias("sd"))
    g = g.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    cone = z * F.col("sd") * F.sqrt("h")
    return g.select("series_id", "cutoff", "h", F.col("last").alias("value"), (F.col("last") - cone).alias("lower"), (F.col("last") + cone).alias("upper"))


def seasonal_naive_forecasts(train: DataFrame, horizon: int, m: int) -> DataFrame:
    """The value m steps before, from the last season."""
    w = W.partitionBy("series_id", "cutoff").orderBy(F.desc("ts"))
    season = train.withColumn("back", F.row_number().over(w)).where(F.col("back") <= m).select("series_id", "cutoff", (m - F.col("back")).alias("slot"), "value")
    steps = season.select("series_id", "cutoff").distinct().withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("slot", (F.col("h") - 1) % m)
    return steps.join(season, ["series_id", "cutoff", "slot"]).select("series_id", "cutoff", "h", "value")


def errors(forecasts: DataFrame, actuals: DataFrame, train: DataFrame, m: int = 12) -> DataFrame:
    """MAE, MAPE, sMAPE, MASE, seasonal MASE, direction and coverage for each series and cutoff.

    MAPE is null when some actual is negligible against the training level, a scaled error
    when its scale is: an undefined number is null and never a large one.
    """
    w = W.partitionBy("series_id", "cutoff").orderBy("ts")
    t = train.withColumns({"d1": F.abs(F.col("value") - F.lag("value").over(w)), "dm": F.abs(F.col("value") - F.lag("value", m).over(w))})
    t = t.groupBy("series_id", "cutoff").agg(
        F.avg("d1").alias("scale"), F.avg("dm").alias("season"), F.avg(F.abs("value")).alias("level"), F.max_by("value", "ts").alias("last"))
    x = forecasts.join(actuals, ["series_id", "cutoff", "h"]).join(t, ["series_id", "cutoff"])
    s = W.partitionBy("series_id", "cutoff").orderBy("h")
    e = F.abs(F.col("actual") - F.col("value"))
    x = x.withColumns({
        "e": e, "sm": 2 * e / (F.abs("actual") + F.abs("value") + 1e-8),
        "same": F.signum(F.col("actual") - F.lag("actual").over(s)) == F.signum(F.col("value") - F.lag("value").over(s)),
    })
    floor = 1e-9 * F.greatest(F.lit(1.0), F.max("level"))
    inside = F.avg(F.col("actual").between(F.col("lower"), F.col("upper")).cast("double")) * 100 if "lower" in forecasts.columns else F.lit(None).cast("double")
    return x.groupBy("series_id", "cutoff").agg(
        F.count("*").alias("n"), F.avg("e").alias("mae"),
        F.when(F.min(F.abs("actual")) > floor, 100 * F.avg(F.try_divide(F.col("e"), F.abs("actual")))).alias("mape"),
        (100 * F.avg("sm")).alias("smape"),
        F.when(F.max("scale") > floor, F.avg("e") / F.max("scale")).alias("mase"),
        F.when(F.max("season") > floor, F.avg("e") / F.max("season")).alias("seasonal_mase"),
        F.coalesce(100 * F.avg(F.col("same").cast("double")), F.lit(50.0)).alias("direction"),
        (F.signum(F.max_by("actual", "h") - F.max("last")) == F.signum(F.max_by("value", "h") - F.max("last"))).alias("end_direction"),
        inside.alias("coverage"),
    )


def binomial_tail(wins: Column, n: Column) -> Column:
    """P(X >= wins) of n fair trials."""
    def ways(k: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(1.0), lambda c, i: F.when(i <= k, c * (n - i + 1) / i).otherwise(c))

    total = F.aggregate(F.sequence(F.lit(0), n), F.lit(0.0), lambda s, k: s + F.when(k >= wins, ways(k)).otherwise(F.lit(0.0)))
    return total / F.pow(F.lit(2.0), n)


def decide(pairs: DataFrame, least: int = 7, margin: float = 0.1) -> DataFrame:
    """Baseline or challenger for each series from pairs(series_id, cutoff, base, challenger) of errors.

    The challenger needs `least` pairs, more wins than losses, and a mean error `margin`
    under the baseline's; ties and everything undefined stay with the baseline.
    """
    p = pairs.where("base is not null and challenger is not null").groupBy("series_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("challenger") < F.col("base")).alias("wins"), F.count_if(F.col("challenger") > F.col("base")).alias("losses"),
        F.avg("base").alias("base_mean"), F.avg("challenger").alias("challenger_mean"))
    better = (F.col("n") >= least) & (F.col("wins") > F.col("losses")) & (F.col("base_mean") > 0) & (F.col("challenger_mean") <= F.col("base_mean") * (1 - margin))
    return p.withColumn("choice", F.when(better, "challenger").otherwise("baseline"))


def holm(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Step-down over tests(name, p): a test passes while all with smaller p pass."""
    w = W.orderBy("p", "name")
    k = tests.count()
    x = tests.withColumn("place", F.row_number().over(w)).withColumn("ok", F.col("p") <= F.lit(alpha) / (k - F.col("place") + 1))
    return x.withColumn("passes", F.min(F.col("ok").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)) == 1).drop("ok")


def bonferroni(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """A test of tests(name, p) passes under alpha by the number of tests."""
    k = tests.agg(F.count("*").alias("k"))
    return tests.join(F.broadcast(k)).select("name", "p", (F.col("p") < F.lit(alpha) / F.col("k")).alias("passes"))


def seasonal_naive_bands(train: DataFrame, horizon: int, m: int, z: float = 1.959963984540054) -> DataFrame:
    """The seasonal naive forecast in logs with bands: the deviation of the steps over a season, by the root of the seasons ahead."""
    w = W.partitionBy("series_id", "cutoff").orderBy("ts")
    d = train.withColumn("d", F.ln("value") - F.ln(F.lag("value", m).over(w))).groupBy("series_id", "cutoff").agg(F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("sigma"))
    f = seasonal_naive_forecasts(train, horizon, m).join(d, ["series_id", "cutoff"])
    half = z * F.col("sigma") * F.sqrt(F.floor((F.col("h") - 1) / m) + 1)
    return f.select("series_id", "cutoff", "h", "value", (F.col("value") * F.exp(-half)).alias("lower"), (F.col("value") * F.exp(half)).alias("upper"))


def long_enough(points: DataFrame) -> DataFrame:
    """Which engines each series has points enough for: backtest, book, risk and correlation."""
    n = F.col("n")
    return points.groupBy("series_id").agg(F.count("*").alias("n")).select(
        "series_id", "n", (n >= 30).alias("backtest"), (n >= 252).alias("book"), (n - 1 >= 252).alias("risk"), ((n >= 5) & (n - 1 >= 4)).alias("correlation"))
