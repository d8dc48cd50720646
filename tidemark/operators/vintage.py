"""Series as they were published: what was known at a cutoff, and whether an engine's skill was there at the time.

vintages(series_id, ts, published, value): every value an observation ever had. A version
holds from its publication to the next one's; it is laid on the cutoffs in that interval,
so a cutoff meets one version of a point, and versions that were replaced before any
cutoff, or held at none, meet nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.sources.shared import settled

from . import decisions, holt, seasonality, tournament


def known_at(vintages: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """(series_id, cutoff, ts, known): each point's value as published at each cutoff.

    cutoffs(cutoff), for every series, or (series_id, cutoff); a few dozen of a series. Of
    two versions published on one day the larger value counts; points after a cutoff are
    unknown at it whenever they were published; null dates and values are left out.
    """
    own = "series_id" in cutoffs.columns
    v = vintages.where("ts is not null and published is not null and value is not null").groupBy("series_id", "ts", F.greatest("published", "ts").alias("published")).agg(F.max_by("value", F.struct(vintages["published"], vintages["value"])).alias("known"))
    v = v.withColumn("superseded", F.lead("published").over(W.partitionBy("series_id", "ts").orderBy("published")))
    each = cutoffs.where("cutoff is not null").groupBy(*(["series_id"] if own else [])).agg(F.sort_array(F.collect_set("cutoff")).alias("cutoffs"))
    v = v.join(each, "series_id") if own else v.join(F.broadcast(each))  # one row, or one a series
    first = F.size(F.filter("cutoffs", lambda c: c < F.col("published")))
    after = F.when(F.col("superseded").isNull(), F.size("cutoffs")).otherwise(F.size(F.filter("cutoffs", lambda c: c < F.col("superseded"))))
    v = v.select("series_id", "ts", "known", F.slice("cutoffs", first + 1, F.greatest(after - first, F.lit(0))).alias("at"))
    return v.select("series_id", F.explode("at").alias("cutoff"), "ts", "known")


def ends(vintages: DataFrame) -> DataFrame:
    """(series_id, ts, first_release, current) of every observation."""
    return vintages.groupBy("series_id", "ts").agg(F.min_by("value", "published").alias("first_release"), F.max_by("value", "published").alias("current"))


def as_published(vintages: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """What was known of each observation at each cutoff, against its first and its last value."""
    return known_at(vintages, cutoffs).join(ends(vintages), ["series_id", "ts"])


def monthly_cutoffs(vintages: DataFrame, k: int, horizon: int, least: int = 36) -> DataFrame:
    """(series_id, cutoff): k cutoffs on the 15th of evenly spaced months, after `least` observations and with `horizon` after them."""
    w = W.partitionBy("series_id").orderBy("ts")
    x = vintages.select("series_id", "ts").distinct().withColumns({"place": F.row_number().over(w) - 1, "n": F.count("*").over(W.partitionBy("series_id"))})
    first, last = F.lit(least), F.col("n") - horizon - 1
    at = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(first + i * (last - first) / max(1, k - 1)))
    x = x.where((F.col("n") - horizon - 1 >= least) & F.array_contains(at, F.col("place").cast("double")))
    return x.select("series_id", F.date_add(F.trunc(F.add_months("ts", 1), "month"), 14).alias("cutoff"))


def vintage_errors(vintages: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Mean absolute errors of the last value as a forecast of the next one: from what was known at the cutoff or as revised since, against the first release or today's value."""
    v = settled(vintages)
    e = ends(v)
    own = ["series_id"] if "series_id" in cutoffs.columns else []
    known = known_at(v, cutoffs).groupBy("series_id", "cutoff").agg(F.max_by("known", "ts").alias("known"), F.max("ts").alias("t"))
    # every observation knows the one before it, so a cutoff looks up two rows
    w = W.partitionBy("series_id").orderBy("ts")
    e = e.withColumns({"next": F.lead("ts").over(w), "next_first": F.lead("first_release").over(w), "next_current": F.lead("current").over(w)})
    each = cutoffs.groupBy(*own).agg(F.sort_array(F.collect_set("cutoff")).alias("cutoffs"))
    x = e.join(each, "series_id") if own else e.join(F.broadcast(each))
    held = F.filter("cutoffs", lambda c: (c >= F.col("ts")) & F.coalesce(c < F.col("next"), F.lit(True)))
    x = x.where("next is not null").select("series_id", F.explode(held).alias("cutoff"), F.col("current").alias("today"), "next_first", "next_current")
    x = x.join(known, ["series_id", "cutoff"])
    return x.groupBy("series_id").agg(F.count("*").alias("n"), *[
        F.avg(F.abs(F.col(actual) - F.col(base))).alias(name) for name, actual, base in (
            ("known_vs_first", "next_first", "known"), ("known_vs_current", "next_current", "known"), ("revised_vs_first", "next_first", "today"), ("revised_vs_current", "next_current", "today"))])


def replayed(vintages: DataFrame, cutoffs: DataFrame, horizon: int = 6, m: int = 12, common: int = 60) -> DataFrame:
    """Errors of the engines at each cutoff, two by two: (series_id, cutoff, data, truth, engine, seasonal, k, mae, rw, sn, revision).

    data: training values as `known` at the cutoff, or as `revised` since, both up to the
    last point known then; truth: the first releases or today's values of the `horizon`
    points after it, all of which there must be. Engines are Holt and, where today's series
    has a season, Holt-Winters (k counts them), with fixed parameters; a cutoff at which
    Holt-Winters finds no season, or under two of them, in either training set counts for
    that set's engines not at all. rw and sn are the naive errors, revision the mean absolute one
    of the last `common` points in percent.
    """
    v = settled(vintages)
    e = settled(ends(v))
    known = known_at(v, cutoffs)
    both = known.join(e, ["series_id", "ts"]).withColumn("t", F.max("ts").over(W.partitionBy("series_id", "cutoff")))
    back = F.row_number().over(W.partitionBy("series_id", "cutoff").orderBy(F.desc("ts")))
    revision = both.withColumn("back", back).where((F.col("back") <= common) & (F.col("known") != 0)).groupBy("series_id", "cutoff").agg((F.avg(F.abs(F.col("current") / F.col("known") - 1)) * 100).alias("revision"))
    # what was known at a cutoff has no gaps before its last point, so today's training set is the same points
    train = both.select("series_id", "cutoff", "t", "ts", F.explode(F.create_map(F.lit("known"), "known", F.lit("revised"), "current")).alias("data", "value"))
    train = settled(train.withColumn("own", F.concat_ws("|", "series_id", F.col("cutoff").cast("string"), "data")))
    w = W.partitionBy("series_id").orderBy("ts").rowsBetween(1, horizon)
    coming = e.select("series_id", F.col("ts").alias("t"), F.collect_list("first_release").over(w).alias("first"), F.collect_list("current").over(w).alias("current")).where(F.size("first") == horizon)
    whole = seasonality.seasonal_test(e.select("series_id", "ts", F.col("current").alias("value"))).select("series_id", F.col("is_seasonal").alias("seasonal"))
    keys = train.select("series_id", "cutoff", "t", "data", "own").distinct().join(coming, ["series_id", "t"]).join(whole, "series_id").join(revision, ["series_id", "cutoff"])
    points = train.select(F.col("own").alias("series_id"), "ts", "value")
    arrays = holt.training_arrays(points).where("n >= 2")
    tested = seasonality.seasonal_test(points).select("series_id", F.col("is_seasonal").alias("window_seasonal"))
    plain = holt.forecast(holt.with_parameters(arrays, *tournament.HOLT), horizon).select("series_id", "h", "value", F.lit("holt").alias("engine"))
    able = arrays.join(tested.where("window_seasonal"), "series_id", "left_semi").where(F.size("y") >= 2 * m)
    winters = holt.seasonal_forecast(holt.with_season(able, *tournament.WINTERS, m), horizon, m).select("series_id", "h", "value", F.lit("winters").alias("engine"))
    f = plain.unionByName(winters).groupBy(F.col("series_id").alias("own"), "engine").agg(F.transform(F.array_sort(F.collect_list(F.struct("h", "value"))), lambda x: x["value"]).alias("f"))
    naive = points.groupBy(F.col("series_id").alias("own")).agg(F.array_sort(F.collect_list(F.struct("ts", "value"))).alias("p")).select("own", F.transform("p", lambda x: x["value"]).alias("v")).select("own", F.element_at("v", -1).alias("last"), F.slice("v", F.greatest(F.size("v") - m + 1, F.lit(1)), m).alias("season"))
    x = keys.join(f, "own").where(F.col("seasonal") | (F.col("engine") == "holt")).join(naive, "own")
    x = x.withColumn("k", F.when(F.col("seasonal"), 2).otherwise(1))
    usable = F.count("*").over(W.partitionBy("own")) == F.col("k")
    x = x.withColumn("usable", usable).where("usable").select("*", F.explode(F.create_map(F.lit("first"), "first", F.lit("current"), "current")).alias("truth", "came"))

    def error(forecast: str) -> Column:
        return F.expr(f"aggregate(zip_with({forecast}, came, (a, b) -> abs(a - b)), 0D, (s, d) -> s + d) / {horizon}")

    x = x.withColumns({"rws": F.transform("came", lambda c: F.col("last")), "sns": F.expr(f"transform(sequence(0, {horizon - 1}), h -> get(season, h % {m}))")})
    return x.select("series_id", "cutoff", "data", "truth", "engine", "seasonal", "k", error("f").alias("mae"), error("rws").alias("rw"), error("sns").alias("sn"), "revision")


def capability(errors: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(series_id, data, truth, engine, naive, n, wins, losses, p, skill, beats) of replayed().

    The rival is the random walk, or for a series with a season the seasonal naive where it
    errs less in total. An engine beats it with a one-sided sign test under alpha by the
    number of engines and a skill, 1 - sum(mae) / sum(naive), over 0.
    """
    cell = W.partitionBy("series_id", "data", "truth", "engine")
    x = errors.withColumn("naive", F.when(F.col("seasonal") & (F.sum("sn").over(cell) < F.sum("rw").over(cell)), "seasonal").otherwise("random_walk"))
    x = x.withColumn("ref", F.when(F.col("naive") == "seasonal", F.col("sn")).otherwise(F.col("rw")))
    g = x.groupBy("series_id", "data", "truth", "engine", "naive", "k").agg(
        F.count("*").alias("n"), F.count_if(F.col("mae") < F.col("ref")).alias("wins"), F.count_if(F.col("mae") > F.col("ref")).alias("losses"),
        (1 - F.try_divide(F.sum("mae"), F.sum("ref"))).alias("skill"), F.avg("revision").alias("revision"))
    g = g.withColumn("p", decisions.sign_p(F.col("wins"), F.col("losses")))
    return g.withColumn("beats", F.coalesce((F.col("p") < F.lit(alpha) / F.col("k")) & (F.col("skill") > 0), F.lit(False)))


def verdicts(capable: DataFrame) -> DataFrame:
    """(series_id, cutoffs, revision, known_first, known_current, revised_first, revised_current, verdict): in which of the four cells some engine beats the naive one.

    kept: with today's data and at the time; lost: with today's data alone; real time only;
    none. The verdict compares revised data against today's values with known data against
    first releases.
    """
    cells = [(d, t) for d in ("known", "revised") for t in ("first", "current")]

    def cell(d: str, t: str):
        return F.coalesce(F.bool_or(F.when((F.col("data") == d) & (F.col("truth") == t), F.col("beats"))), F.lit(False))

    g = capable.groupBy("series_id").agg(
        F.max(F.when((F.col("data") == "known") & (F.col("truth") == "first"), F.col("n"))).alias("cutoffs"),
        F.max(F.when((F.col("data") == "known") & (F.col("truth") == "first"), F.col("revision"))).alias("revision"), *[cell(d, t).alias(f"{d}_{t}") for d, t in cells])
    later, then = F.col("revised_current"), F.col("known_first")
    return g.withColumn("verdict", F.when(later & ~then, "lost").when(then & ~later, "real time only").when(later & then, "kept").otherwise("none"))
