"""Damped Holt against Holt-Winters at many cutoffs of every series, and the engine that is chosen.

The baseline is Holt-Winters on a series with a season and Holt on any other; the rival is
the other one. Both filters run once over a series and leave their states at its cutoffs;
scales, the season test of every training window, the last season and what came after are
window functions over the same points.
"""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import decisions, evidence, seasonality

#: alpha, beta, phi of Holt; alpha, beta, gamma, phi of Holt-Winters.
HOLT, WINTERS = (0.3, 0.1, 0.95), (0.3, 0.05, 0.2, 0.95)
#: Standard errors of the season test, and seasons of differences it takes.
Z_SEASON, SEASONS = 1.645, 3


def _states(y: Column, places: Column, first: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The states after the points at `places`, an array of struct(place, state): a fold over y that keeps what it passes."""
    start = F.struct(first.alias("s"), F.lit(-1).alias("at"), F.filter(F.array(F.struct(F.lit(-1).alias("place"), first.alias("state"))), lambda x: F.lit(False)).alias("out"))

    def run(c: Column, v: Column) -> Column:
        s, at = step(c["s"], v), c["at"] + 1
        kept = F.when(F.array_contains(places, at), F.concat(c["out"], F.array(F.struct(at.alias("place"), s.alias("state"))))).otherwise(c["out"])
        return F.struct(s.alias("s"), at.alias("at"), kept.alias("out"))

    return F.aggregate(y, start, run)["out"]


def _holt(y: Column, places: Column) -> Column:
    a, b, f = HOLT
    first = F.struct(F.element_at(y, 1).alias("l"), (F.element_at(y, 2) - F.element_at(y, 1)).alias("b"), F.lit(0.0).alias("sse"), F.lit(-1).alias("n"), F.array(F.lit(0.0)).alias("season"))

    def step(s: Column, v: Column) -> Column:
        guess = F.when(s["n"] < 0, s["l"]).otherwise(s["l"] + f * s["b"])  # the first point is the start itself
        e = v - guess
        trend = F.when(s["n"] < 0, s["b"]).otherwise(f * s["b"] + a * b * e)
        return F.struct((guess + a * e).alias("l"), trend.alias("b"), (s["sse"] + e * e).alias("sse"), (s["n"] + 1).alias("n"), s["season"].alias("season"))

    return _states(y, places, first, step)


def _winters(y: Column, places: Column, m: int) -> Column:
    a, b, g, f = WINTERS

    def mean(at: int) -> Column:
        return F.aggregate(F.slice(y, at, m), F.lit(0.0), lambda s, v: s + v) / m

    first = F.struct(mean(1).alias("l"), ((mean(m + 1) - mean(1)) / m).alias("b"), F.lit(0.0).alias("sse"), F.lit(0).alias("n"), F.transform(F.slice(y, 1, m), lambda v: v - mean(1)).alias("season"))

    def step(s: Column, v: Column) -> Column:
        guess, own = s["l"] + f * s["b"], F.element_at(s["season"], 1)
        e = v - guess - own
        season = F.concat(F.slice(s["season"], 2, m - 1), F.array(own + g * e))
        return F.struct((guess + a * e).alias("l"), (f * s["b"] + b * e).alias("b"), (s["sse"] + e * e).alias("sse"), (s["n"] + 1).alias("n"), season.alias("season"))

    return _states(y, places, first, step)


def windows(points: DataFrame, horizon: int, m: int) -> DataFrame:
    """points with what is known at each: place, scale and season_scale (mean absolute step, and step of a season), season (the last m values), actual (the next `horizon`), seasonal (the season test of the points so far)."""
    w = W.partitionBy("series_id").orderBy("ts")
    so_far = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    x = points.withColumns({
        "place": F.row_number().over(w) - 1, "d": F.ln(F.col("value") / F.lag("value").over(w)),
        "scale": F.abs(F.col("value") - F.lag("value").over(w)), "season_scale": F.abs(F.col("value") - F.lag("value", m).over(w)),
        "season": F.collect_list("value").over(w.rowsBetween(1 - m, 0)), "actual": F.collect_list("value").over(w.rowsBetween(1, horizon)),
    })
    lags = {f"d{k}": F.lag("d", k).over(w) for k in range(1, m + 1)}
    x = x.withColumns(lags)
    sums = {"scale": F.avg("scale").over(so_far), "season_scale": F.avg("season_scale").over(so_far), "nd": F.count("d").over(so_far), "sd": F.sum("d").over(so_far), "sdd": F.sum(F.col("d") * F.col("d")).over(so_far)}
    for k in range(1, m + 1):
        both = F.col(f"d{k}").isNotNull()
        sums |= {f"p{k}": F.sum(F.col("d") * F.col(f"d{k}")).over(so_far), f"u{k}": F.sum(F.when(both, F.col("d"))).over(so_far), f"v{k}": F.sum(f"d{k}").over(so_far), f"c{k}": F.count(f"d{k}").over(so_far)}
    x = x.withColumns(sums)
    mean = F.try_divide("sd", "nd")
    total = F.col("sdd") - F.col("nd") * mean * mean
    acf = [F.coalesce(F.col(f"p{k}") - mean * (F.col(f"u{k}") + F.col(f"v{k}")) + F.col(f"c{k}") * mean * mean, F.lit(0.0)) for k in range(1, m + 1)]
    acf = [F.try_divide(c, total) for c in acf]
    before = sum((c * c for c in acf[:-1]), F.lit(0.0))
    out = (F.col("nd") >= SEASONS * m) & (total > 1e-12 * F.col("sdd")) & (acf[-1] > Z_SEASON * F.sqrt(F.try_divide(1 + 2 * before, "nd")))
    return x.select("series_id", "ts", "value", "place", "scale", "season_scale", "season", "actual", F.coalesce(out, F.lit(False)).alias("seasonal"))


def _placed(points: DataFrame, k: int, horizon: int, recent: int | None) -> DataFrame:
    rows = evidence.arrays(points).withColumn("places", evidence.even(F.col("n"), k, horizon, recent=recent))
    return rows.where("size(places) > 0 and array_min(values) > 0").select("series_id", "n", "places", F.transform("values", lambda v: F.ln(v)).alias("y"))


def evidence_rows(points: DataFrame, k: int = 8, horizon: int = 6, m: int = 12, recent: int | None = None, level: float = 0.8) -> DataFrame:
    """A row for each series and cutoff: both engines' errors and coverages, the naive ones, and what was left out.

    (series_id, place, cutoff, baseline, base_skipped, rival_failed, base_mae, rival_mae,
    base, rival: the scaled errors, base_cov, rival_cov, rw, snaive). baseline: winters if
    the season test holds on the whole series, else holt. base_skipped: Holt-Winters as the
    baseline refuses a training window without a season. rival_failed: Holt-Winters as the
    rival has under three seasons to train on, or a forecast is not finite. The error is
    scaled by the mean step, for the baseline Holt-Winters by that of a season; null where
    the scale is 0. Points are modelled as logs; series with a value that is not positive,
    or too few points for a cutoff, give no rows.
    """
    placed = _placed(points, k, horizon, recent)
    kept = "_at.place as place, _at.state as state"
    holt = placed.select("series_id", F.lit("holt").alias("engine"), F.explode(_holt(F.col("y"), F.col("places"))).alias("_at")).selectExpr("series_id", "engine", *kept.split(", "))
    long = placed.where(F.size("y") >= 2 * m)
    winters = long.select("series_id", F.lit("winters").alias("engine"), F.explode(_winters(F.col("y"), F.col("places"), m)).alias("_at")).selectExpr("series_id", "engine", *kept.split(", "))
    whole = seasonality.seasonal_test(points).select("series_id", F.when(F.col("is_seasonal"), "winters").otherwise("holt").alias("baseline"))
    facts = windows(points, horizon, m).withColumnRenamed("ts", "cutoff")
    x = holt.unionByName(winters).join(facts, ["series_id", "place"]).join(whole, "series_id")
    s2 = F.when((F.col("state.n") > 1) & (F.col("state.sse") > 0), F.col("state.sse") / F.col("state.n")).otherwise(1e-4)
    h = x.withColumn("s2", s2).select("*", F.posexplode("actual").alias("j", "came")).withColumn("h", F.col("j") + 1)
    (ha, hb, hf), (wa, wb, wg, wf) = HOLT, WINTERS
    own = F.col("engine") == "winters"
    phi, a = F.when(own, F.lit(wf)).otherwise(hf), F.when(own, F.lit(wa)).otherwise(ha)
    b, g = F.when(own, F.lit(wb)).otherwise(ha * hb), F.when(own, F.lit(wg)).otherwise(0.0)
    h = h.withColumns({"phi": phi, "a": a, "b": b, "g": g})
    weights = F.expr(f"aggregate(filter(sequence(0, j), i -> i > 0), 0D, (s, i) -> s + pow(a + b * phi * (1 - pow(phi, i)) / (1 - phi) + if(i % {m} = 0, g, 0D), 2))")
    mu = F.expr(f"state.l + state.b * phi * (1 - pow(phi, h)) / (1 - phi) + if(engine = 'winters', element_at(state.season, j % {m} + 1), 0D)")
    z = NormalDist().inv_cdf((1 + level) / 2)
    h = h.withColumns({"mu": mu, "var": F.col("s2") * (1 + weights)})
    se = F.sqrt("var")
    inside = F.col("came").between(F.exp(F.col("mu") - z * se), F.exp(F.col("mu") + z * se)).cast("double") * 100
    h = h.withColumns({"e": F.abs(F.col("came") - F.exp(F.col("mu") + F.col("var") / 2)), "inside": inside, "rw": F.abs(F.col("came") - F.col("value")), "sn": F.abs(F.col("came") - F.expr(f"element_at(season, j % {m} + 1)"))})
    base = F.col("engine") == F.col("baseline")
    keys = ["series_id", "place", "cutoff", "baseline", "seasonal", "scale", "season_scale"]
    r = h.groupBy(*keys).agg(
        F.avg(F.when(base, F.col("e"))).alias("base_mae"), F.avg(F.when(~base, F.col("e"))).alias("rival_mae"), F.avg(F.when(base, F.col("inside"))).alias("base_cov"), F.avg(F.when(~base, F.col("inside"))).alias("rival_cov"),
        F.max(F.when(base, F.col("rw"))).alias("_"), F.avg("rw").alias("rw"), F.avg("sn").alias("snaive")).drop("_")
    unit = F.when(F.col("baseline") == "winters", F.col("season_scale")).otherwise(F.col("scale"))
    ok = F.col("rival_mae").isNotNull() & ~F.isnan("rival_mae") & (F.col("rival_mae") < float("inf"))
    short = (F.col("baseline") == "holt") & (F.col("place") + 1 < SEASONS * m)
    return r.select(
        "series_id", "place", "cutoff", "baseline", ((F.col("baseline") == "winters") & ~F.col("seasonal")).alias("base_skipped"), (short | ~F.coalesce(ok, F.lit(False))).alias("rival_failed"),
        "base_mae", "rival_mae", F.when(unit > 0, F.col("base_mae") / unit).alias("base"), F.when(unit > 0, F.col("rival_mae") / unit).alias("rival"), "base_cov", "rival_cov", "rw", "snaive")


def decided(rows: DataFrame, incumbents: DataFrame | None = None) -> DataFrame:
    """A row a series from evidence_rows(): the engine, on what metric, and what was counted.

    Cutoffs that the baseline skipped count for neither engine, those at which the rival
    failed for no pair. If the scaled error is undefined at any cutoff left, the whole series
    is decided on the mean absolute error. The robust rule decides, against the engine in
    use of incumbents(series_id, incumbent) if given; without a pair the baseline stays.
    Series whose cutoffs were all skipped have no engine.
    """
    left = rows.withColumn("_undefined", F.max((F.col("base").isNull() & ~F.col("base_skipped")).cast("int")).over(W.partitionBy("series_id")) > 0)
    used = ~F.col("base_skipped")
    paired = used & ~F.col("rival_failed")
    x = left.withColumns({c: F.when(F.col("_undefined"), F.col(f"{c}_mae")).otherwise(F.col(c)) for c in ("base", "rival")})

    def among(c: str) -> Column:
        return F.when(paired, F.col(c))

    g = x.groupBy("series_id", "baseline").agg(
        F.max("_undefined").alias("_undefined"), F.count("*").alias("cutoffs"), F.count_if("base_skipped").alias("skipped"), F.count_if(used & F.col("rival_failed")).alias("failed"), F.count_if(paired).alias("n"),
        F.count_if(paired & (F.col("rival") < F.col("base"))).alias("wins"), F.count_if(paired & (F.col("rival") > F.col("base"))).alias("losses"),
        F.avg(among("base")).alias("base_mean"), F.avg(among("rival")).alias("challenger_mean"), F.avg(among("base_cov")).alias("base_cov"), F.avg(among("rival_cov")).alias("challenger_cov"), F.avg(F.when(used, F.col("base"))).alias("alone"))
    g = g.join(incumbents, "series_id", "left") if incumbents is not None else g.withColumn("incumbent", F.lit(None).cast("string"))
    stays = F.when(F.col("incumbent").isNull(), F.lit(None).cast("string")).when(F.col("incumbent") == F.col("baseline"), "base").otherwise("challenger")
    choice = decisions.robust(decisions.columns(*decisions.H2H), stays)
    other = F.when(F.col("baseline") == "winters", "holt").otherwise("winters")
    metric = F.when(F.col("_undefined"), "mae").when(F.col("baseline") == "winters", "mase_seasonal").otherwise("mase")
    engine = F.when(F.col("skipped") == F.col("cutoffs"), F.lit(None).cast("string")).when((F.col("n") > 0) & (choice == "challenger"), other).otherwise(F.col("baseline"))
    return g.select(
        "series_id", "baseline", metric.alias("metric"), "cutoffs", "skipped", "failed", F.col("n").alias("pairs"), "wins", "losses",
        F.coalesce("base_mean", "alone").alias("base_mean"), F.col("challenger_mean").alias("rival_mean"), engine.alias("engine"))


def plan_b(points: DataFrame, horizon: int, m: int = 12, level: float = 0.95) -> DataFrame:
    """What runs where no model does: (series_id, engine, reason, low_confidence, h, value, lower, upper).

    Holt-Winters for a series with a season, Holt for any other, and for one with a season
    but under two of them, or not positive throughout, to train on; the reason says which. A series under 30 points has
    low_confidence; one of a single point gives no rows. Each series goes through its own
    engine's fold only.
    """
    from . import holt

    a = holt.training_arrays(points).where("n >= 2").join(seasonality.seasonal_test(points).select("series_id", "is_seasonal", "period"), "series_id", "left")
    seasonal = F.coalesce("is_seasonal", F.lit(False)) & (F.col("period") == m)
    able = (F.col("n") >= 2 * m) & F.col("use_log")
    engine = F.when(seasonal & able, "winters").otherwise("holt")
    reason = F.when(seasonal & able, "seasonal").when(seasonal, "seasonal, too short or not positive").otherwise("not seasonal")
    a = a.withColumns({"engine": engine, "reason": reason, "low_confidence": F.col("n") < 30})
    why = a.select("series_id", "engine", "reason", "low_confidence")
    plain = holt.forecast(holt.with_parameters(a.where("engine = 'holt'"), *HOLT), horizon, level).select("series_id", "h", "value", "lower", "upper")
    own = holt.seasonal_forecast(holt.with_season(a.where("engine = 'winters'"), *WINTERS, m), horizon, m, level).select("series_id", "h", "value", "lower", "upper")
    return why.join(plain.unionByName(own), "series_id")
