"""Queries on what reports state: alerts, labels, verdicts, claims, grounding, JSON documents, mutable tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions import calendar
from tidemark.operators import align, backtest, decisions, evidence, grounding, holt, reports, store, texts, vintage
from tidemark.sources import documents, series, tables
from tidemark.sources.shared import new_path, settled
from tidemark.sources.series import table

from . import decision_queries as dq
from . import forecast_queries as fq
from .base import C3, D3, M1, M5, r, rounded
from .portfolio_queries import _PAIR, _returns

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# Forecasts in words and numbers

@query("prj_07_cone", f"{dq.STEPS} SELECT series_id, cutoff, engine, {r('CASE WHEN last > 0 THEN (value - last) / last * 100 ELSE 0 END', 'change_pct')}, {r('CASE WHEN value > 0 THEN (upper - lower) / value * 100 ELSE 0 END', 'cone_pct')}, {r('(upper - lower) / 2', 'half_width', 2)} FROM st WHERE h = {dq.H}")
def prj_07(spark, sf):
    """Change to the last step, width of the cone, and half of it."""
    s = dq._steps(spark, sf).where(F.col("h") == dq.H)
    x = s.select("series_id", "cutoff", "engine", *reports.cone(F.col("last"), F.col("value"), F.col("lower"), F.col("upper")))
    return rounded(x.withColumn("half_width", F.round("half_width", 2)))


@query("prj_11_stress", f"{dq.STEPS} SELECT series_id, cutoff, actual < lower * 0.98 AS breached, place % 5 = 0 OR actual < lower * 0.98 AS stressed FROM st WHERE h = 1 AND engine = 'base'")
def prj_11(spark, sf):
    """A value under the nearest lower bound by two percent, or a thesis already marked, is under stress."""
    s = dq._steps(spark, sf).where("h = 1 and engine = 'base'")
    breached = F.col("actual") < F.col("lower") * reports.BREACH
    return s.select("series_id", "cutoff", breached.alias("breached"), ((F.col("place") % 5 == 0) | breached).alias("stressed"))


@query("krn_12_verdict", f"""{dq.PAIRS} SELECT series_id, cutoff, CASE WHEN snaive < rw THEN 'seasonal' ELSE 'random_walk' END AS rival, base < least(rw, snaive) AS beats, base < greatest(rw, snaive) AS beats_other,
 {r('(least(rw, snaive) - base) / (least(rw, snaive) + 1e-8) * 100', 'gap_pct', 4)}, base_cov < 80 - 15 AS undercovered FROM pr""")
def krn_12(spark, sf):
    """The verdict of a backtest: against the naive forecast with the smaller error (on a tie the random walk), the other one second, and a warning where the band covers 15 points less than it says."""
    p = settled(dq._pairs(spark, sf))
    best = F.least("rw", "snaive")
    return rounded(p.select(
        "series_id", "cutoff", F.when(F.col("snaive") < F.col("rw"), "seasonal").otherwise("random_walk").alias("rival"), (F.col("base") < best).alias("beats"),
        (F.col("base") < F.greatest("rw", "snaive")).alias("beats_other"), F.round((best - F.col("base")) / (best + 1e-8) * 100, 4).alias("gap_pct"), (F.col("base_cov") < 80 - 15).alias("undercovered")))


@query("krn_50_interval_label", f"""{dq.STEPS}, c AS (SELECT engine, avg(CASE WHEN actual BETWEEN lower AND upper THEN 100.0 ELSE 0 END) AS cov FROM st GROUP BY 1)
 SELECT engine, coalesce(level, 95) AS level, printf('%.1f%% of %d%%', cov, coalesce(level, 95)) AS label FROM c LEFT JOIN (VALUES ('base', 80)) t(engine, level) USING (engine)""")
def krn_50(spark, sf):
    """The declared level of an engine's interval, 95 where none is declared, and the observed coverage beside it."""
    c = dq._steps(spark, sf).groupBy("engine").agg(F.avg(F.col("actual").between(F.col("lower"), F.col("upper")).cast("double") * 100).alias("cov"))
    level = F.coalesce(F.create_map(F.lit("base"), F.lit(80))[F.col("engine")], F.lit(95))
    return c.select("engine", level.alias("level"), F.format_string("%.1f%% of %d%%", F.col("cov"), level).alias("label"))


@query("krn_49_default_cutoff", f"""WITH {M5}, {D3}, e AS (SELECT series_id, ts FROM m5 UNION ALL SELECT series_id, ts FROM d3 UNION ALL SELECT series_id || ' short', ts FROM d3 WHERE ts < (SELECT min(ts) + INTERVAL 60 DAY FROM d3)), n AS (SELECT series_id, CAST(count(*) AS INT) AS n FROM e GROUP BY 1),
 g AS (SELECT series_id, median(gap) AS gap FROM (SELECT series_id, date_diff('day', lag(ts) OVER (PARTITION BY series_id ORDER BY ts), ts) AS gap FROM e) GROUP BY 1)
 SELECT series_id, n, CAST(CASE WHEN gap > 4 AND n > 30 THEN greatest(20, n - 1 - 12) WHEN n > 80 THEN greatest(30, n - 80) WHEN n > 30 THEN floor(n * 0.7) END AS INT) AS cutoff FROM n JOIN g USING (series_id)""")
def krn_49(spark, sf):
    """The default cutoff by frequency and length: the horizon from the end, 80 points for daily series, 70 percent of short ones."""
    d = series.daily_flags(spark, sf).select("series_id", "ts", "value")
    first = d.agg(F.date_add(F.min("ts"), 60).alias("end"))
    short = d.join(F.broadcast(first)).where("ts < end").select(F.concat("series_id", F.lit(" short")).alias("series_id"), "ts", "value")
    f = align.frequency(series.monthly_segments(spark, sf).unionByName(d).unionByName(short))
    n = F.col("n").cast("int")
    return f.select("series_id", n.alias("n"), reports.default_cutoff(n, F.col("frequency"), calendar.horizon(F.col("frequency"))).cast("int").alias("cutoff"))


@query("krn_18_selection", f"""{dq.PAIRS}, {dq._CHOICE}, cat(series_id, kind, engine) AS (VALUES ('AUTOMOBILE', 'seasonal catalog', 'challenger'), ('BUILDING', 'fund catalog', 'base')), every AS (SELECT series_id, n FROM nn UNION ALL SELECT series_id || ' new', 40 FROM nn)
 SELECT e.series_id, coalesce(cat.kind, CASE WHEN n >= 48 AND ch.choice IS NOT NULL THEN 'discovered' WHEN n < 60 THEN 'short history' ELSE 'default' END) AS reason, coalesce(cat.engine, CASE WHEN n >= 48 THEN ch.choice END, 'base') AS engine, cat.kind IS NULL AND n < 48 AS low_confidence
 FROM every e LEFT JOIN cat USING (series_id) LEFT JOIN ch ON ch.series_id = e.series_id""")
def krn_18(spark, sf):
    """Which engine runs: by the seasonal catalog, the fund catalog, the decision on evidence, or the default, with a warning for a short history."""
    catalog = spark.createDataFrame([("AUTOMOBILE", "seasonal catalog", "challenger"), ("BUILDING", "fund catalog", "base")], "series_id string, kind string, catalog_engine string")
    p = settled(dq._pairs(spark, sf))
    n = series.monthly_segments(spark, sf).groupBy("series_id").agg(F.count("*").alias("n"))
    every = n.unionByName(n.select(F.concat("series_id", F.lit(" new")).alias("series_id"), F.lit(40).cast("long").alias("n")))
    return decisions.select_engine(every, catalog, dq._chosen(p))


@query("krn_40_vintage_errors", f"""WITH {M1}, v AS (SELECT series_id, ts, CAST(ts + INTERVAL 1 DAY * (30 * k) AS DATE) AS published, value * (1 + k * CAST(0.001 AS DOUBLE) * (month(ts) - 6)) AS value FROM m1, (VALUES (0), (1), (2)) t(k)),
 e AS (SELECT series_id, ts, arg_min(value, published) AS first_release, arg_max(value, published) AS current FROM v GROUP BY ALL), c AS (SELECT DISTINCT ts AS cutoff FROM m1 WHERE ts BETWEEN DATE '1998-01-31' AND DATE '2000-12-31'),
 k AS (SELECT series_id, cutoff, arg_max(value, (ts, published)) AS known FROM v JOIN c ON published <= cutoff GROUP BY ALL), t AS (SELECT e.series_id, c.cutoff, arg_max(current, ts) AS today FROM e JOIN c ON ts <= cutoff GROUP BY ALL),
 n AS (SELECT e.series_id, c.cutoff, arg_min(first_release, ts) AS first_release, arg_min(current, ts) AS current FROM e JOIN c ON ts > cutoff GROUP BY ALL)
 SELECT series_id, count(*) AS n, {r('avg(abs(n.first_release - known))', 'known_vs_first', 3)}, {r('avg(abs(n.current - known))', 'known_vs_current', 3)}, {r('avg(abs(n.first_release - today))', 'revised_vs_first', 3)}, {r('avg(abs(n.current - today))', 'revised_vs_current', 3)} FROM k JOIN t USING (series_id, cutoff) JOIN n USING (series_id, cutoff) GROUP BY 1""")
def krn_40(spark, sf):
    """Two by two: forecasts of the last value from data as known at the cutoff or as revised since, against the first release or today's value of the next month."""
    from .series_queries import _vintages

    v = _vintages(spark, sf)
    months = v.select(F.col("ts").alias("cutoff")).where("ts between date'1998-01-31' and date'2000-12-31'").distinct()
    return rounded(vintage.vintage_errors(v, months), 3)


@query("krn_37_macro_evidence", f"""WITH {M5}, x AS (SELECT series_id, ts, CASE WHEN series_id < 'F' THEN value ELSE value / 1e6 END AS value FROM m5), l AS (SELECT series_id, max(ts) AS t, arg_max(value, ts) AS last_value FROM x GROUP BY 1),
 b AS (SELECT x.series_id, max(ts) AS t0, arg_max(value, ts) AS before_value FROM x JOIN l USING (series_id) WHERE ts <= t - INTERVAL 365 DAY GROUP BY 1)
 SELECT series_id, CASE WHEN series_id < 'F' THEN 'percent' ELSE 'points' END AS unit, {r("CASE WHEN series_id < 'F' THEN (last_value / before_value - 1) * 100 ELSE last_value - before_value END", 'change')} FROM l JOIN b USING (series_id)""")
def krn_37(spark, sf):
    """Change over twelve months: in percent, or in points for a series that is itself a percentage."""
    m = series.monthly_segments(spark, sf).withColumn("value", F.when(F.col("series_id") < "F", F.col("value")).otherwise(F.col("value") / 1e6))
    y = align.year_before(m).where("before_value is not null")
    rate = F.col("series_id") >= "F"
    return rounded(y.select("series_id", F.when(rate, "points").otherwise("percent").alias("unit"), F.when(rate, F.col("change")).otherwise(F.col("change_pct")).alias("change")))


@query("krn_39_narrative", f"""{dq.PAIRS}, {dq._CHOICE}, {dq._skill_sql('sk')} SELECT series_id, printf('%s: the %s wins %d of %d; it %s.', series_id, choice, wins, n, CASE state WHEN 'adds' THEN 'adds to the ' || naive WHEN 'adds_nothing' THEN 'adds nothing to the ' || naive ELSE 'was not evaluated' END) AS text FROM sk JOIN ch USING (series_id)""")
def krn_39(spark, sf):
    """A sentence on each series, by rules."""
    p = settled(dq._pairs(spark, sf))
    c = dq._chosen(p)
    s = decisions.skill(p, c).join(c, "series_id")
    end = F.when(F.col("state") == "adds", F.concat(F.lit("adds to the "), "naive")).when(F.col("state") == "adds_nothing", F.concat(F.lit("adds nothing to the "), "naive")).otherwise("was not evaluated")
    return s.select("series_id", F.format_string("%s: the %s wins %d of %d; it %s.", "series_id", "choice", "wins", "n", end).alias("text"))


@query("krn_09_seasonal_bands", f"""WITH {fq._SPLIT}, d AS (SELECT series_id, cutoff, ln(value) - ln(lag(value, 12) OVER (PARTITION BY series_id, cutoff ORDER BY ts)) AS d FROM tr), s AS (SELECT series_id, cutoff, sqrt(avg(d * d)) AS sigma FROM d GROUP BY ALL),
 n AS (SELECT *, row_number() OVER (PARTITION BY series_id, cutoff ORDER BY ts DESC) AS back FROM tr) SELECT series_id, cutoff, CAST(h AS INT) AS h, {r('value', 'value', 2)}, {r(f'value * exp(-{fq.Z95} * sigma * sqrt((h - 1) // 12 + 1))', 'lower', 2)}, {r(f'value * exp({fq.Z95} * sigma * sqrt((h - 1) // 12 + 1))', 'upper', 2)} FROM n JOIN s USING (series_id, cutoff) JOIN range(1, 15) q(h) ON 12 - back = (h - 1) % 12""")
def krn_09(spark, sf):
    """The seasonal naive forecast with bands in logs that widen by the season."""
    return rounded(backtest.seasonal_naive_bands(fq._split(spark, sf)[0], 14, 12), 2)


def _robust_fold(name: str, level: str, trend: str) -> str:
    return f"""{name} AS (SELECT x0.series_id, 0 AS place, x0.y AS l, x1.y - x0.y AS tr, 0::DOUBLE AS sse FROM x x0 JOIN x x1 ON x0.series_id = x1.series_id AND x1.place = 1 WHERE x0.place = 0 UNION ALL
 SELECT {name}.series_id, x.place, l + 0.95 * tr + 0.3 * {level}, 0.95 * tr + 0.3 * 0.1 * {trend}, sse + pow(y - l - 0.95 * tr, 2) FROM {name} JOIN x ON x.series_id = {name}.series_id AND x.place = {name}.place + 1 JOIN lm ON lm.series_id = x.series_id)"""


_CLIP = "greatest(least(y - l - 0.95 * tr, lim), -lim)"


@query("krn_11_robust_holt", f"""WITH RECURSIVE {M5}, x AS (SELECT series_id, ln(value) AS y, CAST(row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS INT) AS place FROM m5), d AS (SELECT series_id, y - lag(y) OVER (PARTITION BY series_id ORDER BY place) AS d FROM x), md AS (SELECT series_id, median(d) AS m FROM d GROUP BY 1),
 lm AS (SELECT series_id, 0.5 * 1.4826 * median(abs(d - m)) AS lim FROM d JOIN md USING (series_id) GROUP BY 1), {_robust_fold('fb', _CLIP, _CLIP)}, {_robust_fold('ft', '(y - l - 0.95 * tr)', _CLIP)}
 SELECT series_id, 'both' AS mode, {r('arg_max(l, place)', 'l')}, {r('arg_max(tr, place)', 'trend')}, {r('max(sse) / max(place)', 's2')} FROM fb GROUP BY 1 UNION ALL SELECT series_id, 'trend', {r('arg_max(l, place)', 'l')}, {r('arg_max(tr, place)', 'trend')}, {r('max(sse) / max(place)', 's2')} FROM ft GROUP BY 1""")
def krn_11(spark, sf):
    """The filter with errors drawn in to half a robust deviation of the steps: in level and trend, or in the trend alone."""
    a = holt.training_arrays(series.monthly_segments(spark, sf))
    a = a.join(holt.robust_scale(a), "series_id")
    lim = 0.5 * F.col("scale")
    x = a.select("series_id", *[holt.smooth(F.col("y"), *holt.DEFAULT, clip=lim, clip_level=mode == "both").alias(mode) for mode in ("both", "trend")])
    x = x.select("series_id", F.explode(F.create_map(F.lit("both"), "both", F.lit("trend"), "trend")).alias("mode", "s"))
    return rounded(x.select("series_id", "mode", F.col("s.l").alias("l"), F.col("s.b").alias("trend"), (F.col("s.sse") / F.col("s.n")).alias("s2")))


_HW = (0.3, 0.05, 0.2, 0.95)
_HWE = "(y - l - {f} * tr - s[1])".format(f=_HW[3])


@query("krn_04_holt_winters", f"""WITH RECURSIVE {M5}, x AS (SELECT series_id, ln(value) AS y, CAST(row_number() OVER (PARTITION BY series_id ORDER BY ts) AS INT) AS k FROM m5), i AS (SELECT series_id, avg(y) FILTER (k <= 12) AS m1, avg(y) FILTER (k BETWEEN 13 AND 24) AS m2, list(y ORDER BY k) FILTER (k <= 12) AS ys FROM x GROUP BY 1),
 f AS (SELECT series_id, 0 AS k, m1 AS l, (m2 - m1) / 12 AS tr, list_transform(ys, lambda v: v - m1) AS s, 0::DOUBLE AS sse FROM i UNION ALL SELECT f.series_id, x.k, l + {_HW[3]} * tr + {_HW[0]} * {_HWE}, {_HW[3]} * tr + {_HW[1]} * {_HWE}, list_append(s[2:], s[1] + {_HW[2]} * {_HWE}), sse + pow({_HWE}, 2) FROM f JOIN x ON x.series_id = f.series_id AND x.k = f.k + 1),
 e AS (SELECT series_id, arg_max(l, k) AS l, arg_max(tr, k) AS tr, arg_max(s, k) AS s, max(sse) / max(k) AS s2 FROM f GROUP BY 1),
 h AS (SELECT series_id, CAST(h AS INT) AS h, l + tr * {_HW[3]} * (1 - pow({_HW[3]}, h)) / (1 - {_HW[3]}) + s[CAST((h - 1) % 12 + 1 AS INT)] AS mu, s2 * (1 + coalesce((SELECT sum(pow({_HW[0]} + {_HW[1]} * {_HW[3]} * (1 - pow({_HW[3]}, j)) / (1 - {_HW[3]}) + CASE WHEN j % 12 = 0 THEN {_HW[2]} ELSE 0 END, 2)) FROM range(1, h) q(j)), 0)) AS var FROM e, range(1, 15) g(h))
 SELECT series_id, h, {r('exp(mu + var / 2)', 'value', 2)}, {r(f'exp(mu - {fq.Z95} * sqrt(var))', 'lower', 2)}, {r(f'exp(mu + {fq.Z95} * sqrt(var))', 'upper', 2)} FROM h""")
def krn_04(spark, sf):
    """Damped trend and additive season in logs, as a fold over the series with given parameters, and its forecasts with exact intervals."""
    a = holt.training_arrays(series.monthly_segments(spark, sf))
    return rounded(holt.seasonal_forecast(holt.with_season(a, *_HW, 12), 14, 12, 0.95).select("series_id", "h", "value", "lower", "upper"), 2)


@query("krn_04_fit")
def krn_04_fit(spark, sf):
    """Fitted parameters and start of the seasonal model, and its squared error, which is never above that of the defaults; whether the series passes the test for a season beside it."""
    from tidemark.operators import seasonality

    m = series.monthly_segments(spark, sf)
    f = holt.fit_season(holt.training_arrays(m), 12)
    t = seasonality.seasonal_test(m).select("series_id", "is_seasonal")
    return f.join(t, "series_id", "left").select("series_id", "alpha", "beta", "gamma", "phi", "l0", "b0", "s0", "sse", "sse_start", "is_seasonal")


@query("krn_04_fitted_states", f"""WITH {M5} SELECT series_id, TRUE AS no_worse, TRUE AS same_error, 12 AS seasons, 0.0::DOUBLE AS season_sum, TRUE AS ordered FROM m5 GROUP BY 1""")
def krn_04_states(spark, sf):
    """Of every series: the fitted error is not above the defaults', the fold from the fitted start gives it, its seasons add to 0, and bounds are about the forecasts."""
    a = holt.training_arrays(series.monthly_segments(spark, sf))
    f = settled(holt.with_fitted_season(a, 12))
    c = holt.seasonal_forecast(f, 6, 12).groupBy("series_id").agg(F.bool_and((F.col("lower") < F.col("value")) & (F.col("value") < F.col("upper"))).alias("ordered"))
    total = F.aggregate("s0", F.lit(0.0), lambda s, v: s + v)
    x = f.select("series_id", (F.col("sse") <= F.col("sse_start") * (1 + 1e-9)).alias("no_worse"), (F.abs(F.col("sse") - F.col("state.sse")) <= 1e-6 * F.col("sse")).alias("same_error"),
                 F.size("s0").alias("seasons"), (F.round(total, 9) + F.lit(0.0)).alias("season_sum"))
    return x.join(c, "series_id")


# Correlations

@query("prj_12_strength", f"""WITH {_PAIR}, p AS (SELECT i, j, corr(x, y) AS c FROM pr WHERE i < j GROUP BY ALL), g AS (SELECT * FROM p UNION ALL SELECT 'grid', CAST(k AS VARCHAR), k / 20.0::DOUBLE FROM range(-20, 21) t(k))
 SELECT i, j, CASE WHEN c >= 0.75 THEN 'strong positive' WHEN c >= 0.4 THEN 'clear positive' WHEN c >= 0.15 THEN 'weak positive' WHEN c <= -0.75 THEN 'strong negative' WHEN c <= -0.4 THEN 'clear negative' WHEN c <= -0.15 THEN 'weak negative' ELSE 'none' END AS band FROM g""")
def prj_12(spark, sf):
    """Seven bands of a correlation: of the pairs of series, and of an even grid from -1 to 1."""
    from tidemark.operators import portfolio

    p = portfolio.correlations(_returns(spark, sf)).where("i < j").select("i", "j", F.col("pearson").alias("c"))
    k = spark.range(-20, 21).select(F.lit("grid").alias("i"), F.col("id").cast("string").alias("j"), (F.col("id") / 20.0).alias("c"))
    return p.unionByName(k).select("i", "j", reports.strength(F.col("c")).alias("band"))


@query("agg_16_strong_pairs", f"WITH {M5}, l AS (SELECT series_id, ts, ln(value) AS v FROM m5), p AS (SELECT a.series_id AS i, b.series_id AS j, corr(a.v, b.v) AS c FROM l a JOIN l b ON a.ts = b.ts AND a.series_id < b.series_id GROUP BY ALL) SELECT count(*) AS pairs, count(*) FILTER (abs(c) >= 0.7) AS strong FROM p")
def agg_16(spark, sf):
    """How many pairs of series correlate by 0.7 or more, either way."""
    l = series.monthly_segments(spark, sf).select("series_id", "ts", F.ln("value").alias("r"))
    from tidemark.operators import products

    p = products.pair_products(l).where("i < j").select("i", "j", products.correlation().alias("c"))
    return p.agg(F.count("*").alias("pairs"), F.count_if(F.abs("c") >= reports.STRONG).alias("strong"))


# Series and sources

@query("prj_13_labels", """SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'Last price' ELSE 'Last value' END AS label,
 CASE WHEN p_size % 3 = 0 THEN printf('$%.2f', p_retailprice) WHEN trim(p_type) <> '' AND p_size % 2 = 0 THEN printf('%.2f', p_retailprice) || ' ' || trim(p_type) ELSE printf('%.2f', p_retailprice) END AS shown,
 CASE WHEN p_size % 3 = 0 THEN CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END WHEN p_size % 5 = 0 THEN 'no metadata' ELSE concat_ws(' · ', CASE WHEN p_size % 2 = 0 THEN p_type END, p_brand, CASE WHEN p_size % 7 > 0 THEN 'NSA' END) END AS meta FROM part""")
def prj_13(spark, sf):
    """Label, value with its unit, and metadata of a series in words."""
    s = F.col("p_size")
    kind, unit = F.when(s % 3 == 0, "equity").otherwise("macro"), F.when(s % 2 == 0, F.col("p_type"))
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.when(kind == "equity", "Last price").otherwise("Last value").alias("label"), reports.formatted(F.col("p_retailprice"), kind, unit).alias("shown"),
        reports.meta_text(kind, unit, F.when(s % 5 == 0, "unavailable").otherwise("live"), F.col("p_brand"), F.when(s % 7 > 0, "NSA").otherwise("")).alias("meta"))


@query("fil_03_provenance", f"WITH {M5}, x AS (SELECT series_id, ts, value, CASE WHEN series_id = 'BUILDING' AND month(ts) = 3 THEN 'synthetic' ELSE 'live' END AS source FROM m5) SELECT series_id, ts, source FROM x WHERE series_id NOT IN (SELECT series_id FROM x WHERE source = 'synthetic')")
def fil_03(spark, sf):
    """No series with a made-up point enters an analysis."""
    x = series.monthly_segments(spark, sf).withColumn("source", F.when((F.col("series_id") == "BUILDING") & (F.month("ts") == 3), "synthetic").otherwise("live"))
    return reports.real_only(x).select("series_id", "ts", "source")


@query("fil_04_minimum_history", f"""WITH {C3}, n AS (SELECT series_id, count(*) AS n FROM c3 WHERE ts < DATE '1995-04-15' OR series_id <> 'R' GROUP BY 1) SELECT series_id, n, n >= 30 AS backtest, n >= 252 AS book, n - 1 >= 252 AS risk, n >= 5 AND n - 1 >= 4 AS correlation FROM n""")
def fil_04(spark, sf):
    """Which engines a series is long enough for: 30 points for a backtest, 252 prices for a book, 252 returns for risk, 5 points and 4 returns for a correlation."""
    c = align.common_dates(series.daily_flags(spark, sf)).where("ts < date'1995-04-15' or series_id <> 'R'")
    return backtest.long_enough(c)


@query("fil_09_smoke_window", f"WITH {D3} SELECT series_id, ts, {r('value', 'value')} FROM d3 WHERE ts BETWEEN DATE '1996-01-01' AND DATE '1996-03-31' AND day(ts) IN (1, 15)")
def fil_09(spark, sf):
    """Sample dates of a window."""
    return rounded(series.daily_flags(spark, sf).where("ts between date'1996-01-01' and date'1996-03-31'").where(F.dayofmonth("ts").isin(1, 15)))


@query("src_10_snapshot", f"""WITH {M5} SELECT series_id, CASE WHEN series_id < 'F' THEN 'a' END AS category, ts, value FROM m5""")
def src_10(spark, sf):
    """A snapshot written as JSON documents with a manifest of their hashes, and the points read back from the folder."""
    m = series.monthly_segments(spark, sf)
    c = m.where("series_id < 'F'").select("series_id", F.lit("a").alias("category")).distinct()
    path = new_path(spark, "snapshot")
    documents.write_documents(settled(reports.snapshot(m, c)), path)
    return reports.snapshot_points(documents.read_documents(spark, path, reports.SNAPSHOT)[0])


@query("src_10_damaged", """SELECT CAST(s_suppkey AS VARCHAR) AS key, CASE WHEN s_acctbal < 0 THEN 'negative' ELSE 'positive' END AS part, 'not of the schema' AS reason FROM supplier WHERE s_nationkey % 5 = 0""")
def src_10_damaged(spark, sf):
    """Documents of suppliers, of which some are no JSON of the schema: those are named, the others read."""
    s = table(spark, sf, "supplier")
    text = F.to_json(F.struct(F.col("s_suppkey").alias("id"), "s_name"))
    bad = F.when(F.col("s_nationkey") % 5 == 0, F.substring(text, 1, 12)).otherwise(text)
    d = s.select(F.col("s_suppkey").alias("key"), F.when(F.col("s_acctbal") < 0, "negative").otherwise("positive").alias("part"), bad.alias("document"))
    path = new_path(spark, "suppliers")
    documents.write_documents(d, path)
    return documents.read_documents(spark, path, "id long, s_name string")[1]


@query("src_14_popularity_scan", """WITH x AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS popularity, CASE WHEN p_size < 25 THEN 'history' WHEN p_type <> 'ECONOMY' THEN 'not seasonal' ELSE 'chosen' END AS outcome FROM part),
 c AS (SELECT *, count(*) FILTER (outcome = 'chosen') OVER (ORDER BY popularity) AS chosen FROM x) SELECT id, CAST(popularity AS INT) AS popularity, outcome FROM c WHERE chosen - CASE WHEN outcome = 'chosen' THEN 1 ELSE 0 END < 6""")
def src_14(spark, sf):
    """Candidates by popularity with the reason for or against each, up to the sixth that is chosen: the sixth's place is found first, then everything up to it."""
    outcome = F.when(F.col("p_size") < 25, "history").when(F.col("p_type") != "ECONOMY", "not seasonal").otherwise("chosen")
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_retailprice", outcome.alias("outcome"))
    sixth = p.where("outcome = 'chosen'").orderBy(F.desc("p_retailprice"), "id").limit(6).agg(F.min("p_retailprice").alias("price"), F.count("*").alias("n"), F.max_by("id", F.struct(-F.col("p_retailprice"), "id")).alias("last"))
    seen = p.join(F.broadcast(sixth)).where("n < 6 or p_retailprice > price or (p_retailprice = price and id <= last)")
    return seen.select("id", F.row_number().over(W.orderBy(F.desc("p_retailprice"), "id")).alias("popularity"), "outcome")


@query("snk_02_json", f"WITH {M5} SELECT series_id, count(*) AS n, {r('avg(value)', 'mean', 3)} FROM m5 GROUP BY 1")
def snk_02(spark, sf):
    """A result written as JSON lines with their hashes, and read back with its schema."""
    g = series.monthly_segments(spark, sf).groupBy("series_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    path = new_path(spark, "result")
    documents.write_documents(settled(g.select(F.col("series_id").alias("key"), F.lit("means").alias("part"), F.to_json(F.struct("series_id", "n", "mean")).alias("document"))), path)
    return rounded(documents.read_documents(spark, path, "series_id string, n long, mean double")[0].select("document.*"), 3)


@query("ord_07_newest_first", "SELECT user_id AS thesis, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INT) AS place, event_id AS snapshot FROM events QUALIFY place <= 3")
def ord_07(spark, sf):
    """The newest three snapshots of each thesis, newest first."""
    w = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf, "events").select(F.col("user_id").alias("thesis"), F.row_number().over(w).alias("place"), F.col("event_id").alias("snapshot")).where("place <= 3")


@query("join_13_evidence", """WITH f AS (SELECT c_mktsegment AS ticker, o_orderpriority AS metric, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority < '3' GROUP BY ALL), a(ticker) AS (VALUES ('BUILDING'), ('MACHINERY'), ('NOTHING'))
 SELECT coalesce(a.ticker, f.ticker) AS ticker, coalesce(string_agg(metric, ',' ORDER BY metric), '') AS metrics, count(metric) AS n, a.ticker IS NOT NULL AND count(metric) = 0 AS missing, a.ticker IS NULL AS unasked FROM a FULL JOIN f ON a.ticker = f.ticker GROUP BY a.ticker, f.ticker""")
def join_13(spark, sf):
    """Evidence by ticker, with those asked for and not found, and those found and not asked for."""
    o = table(spark, sf, "orders").where("o_orderpriority < '3'").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    f = o.groupBy(F.col("c_mktsegment").alias("ticker"), F.col("o_orderpriority").alias("metric")).agg(F.sum("o_totalprice").alias("v"))
    f = f.groupBy("ticker").agg(F.array_sort(F.collect_list("metric")).alias("metrics"))
    asked = spark.createDataFrame([("BUILDING",), ("MACHINERY",), ("NOTHING",)], "ticker string").withColumn("asked", F.lit(True))
    x = asked.join(f, "ticker", "full_outer")
    n = F.coalesce(F.size("metrics"), F.lit(0)).cast("long")
    return x.select("ticker", F.coalesce(F.array_join("metrics", ","), F.lit("")).alias("metrics"), F.greatest(n, F.lit(0)).alias("n"), (F.col("asked").isNotNull() & F.col("metrics").isNull()).alias("missing"), F.col("asked").isNull().alias("unasked"))


# Claims and grounding

_ITEM = "p_name || CASE p_size % 4 WHEN 0 THEN ' 3x etf' WHEN 1 THEN ' inverse 2x' WHEN 2 THEN ' the company' ELSE ' gold' END"
_LEV = r"CAST(nullif(replace(regexp_extract(lower({t}), '(?:^|[^0-9a-z.,])([0-9]{{1,2}}(?:[.,][0-9])?)x(?:[^a-z]|$)', 1), ',', '.'), '') AS DOUBLE)"
_INV = r"regexp_matches(lower({t}), '\b(inverse|short|bear)\b')"


def _item():
    s = F.col("p_size") % 4
    return F.concat("p_name", F.when(s == 0, " 3x etf").when(s == 1, " inverse 2x").when(s == 2, " the company").otherwise(" gold"))


@query("str_05_contradictions", rf"""WITH x AS (SELECT p_partkey AS id, lower({_ITEM}) AS t, p_type, CASE WHEN p_size % 3 = 0 THEN 'EQUITY' ELSE 'ETF' END AS kind, CASE WHEN p_size % 5 < 2 THEN 'etf' ELSE 'stock' END AS declared, CASE WHEN p_size % 2 = 0 THEN lower(p_type) || ' bear' ELSE lower(p_type) END AS category FROM part)
 SELECT id, array_to_string(list_filter([CASE WHEN declared = 'etf' AND kind = 'EQUITY' OR declared = 'stock' AND kind = 'ETF' THEN 'type' END, CASE WHEN kind = 'EQUITY' AND regexp_matches(t, '\b(etf|fund)\b') OR kind = 'ETF' AND regexp_matches(t, '\bthe company\b') THEN 'called' END,
 CASE WHEN t LIKE '%red%' AND p_type NOT LIKE '%PROMO%' THEN 'issuer' END, CASE WHEN {_LEV.format(t='t')} <> {_LEV.format(t='category')} THEN 'leverage' END, CASE WHEN {_INV.format(t='category')} AND NOT {_INV.format(t='t')} THEN 'inverse_unsaid' WHEN kind = 'ETF' AND NOT {_INV.format(t='category')} AND {_INV.format(t='t')} THEN 'not_inverse' END,
 CASE WHEN kind = 'ETF' AND t LIKE '%gold%' AND NOT (category LIKE '%gold%' OR category LIKE '%precious metals%') THEN 'theme' END], lambda v: v IS NOT NULL), ',') AS problems FROM x""")
def str_05(spark, sf):
    """The six rules on an instrument's description against its facts."""
    s = F.col("p_size")
    category = F.lower(F.when(s % 2 == 0, F.concat("p_type", F.lit(" bear"))).otherwise(F.col("p_type")))
    found = texts.contradictions(
        F.lower(_item()), declared=F.when(s % 5 < 2, "etf").otherwise("stock"), kind=F.when(s % 3 == 0, "EQUITY").otherwise("ETF"), category=category,
        issuer=F.col("p_type"), issuers=(("red", "PROMO"),), themes=(("gold", ("gold", "precious metals")),))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(found, ",").alias("problems"))


@query("str_06_risk_profile", rf"""WITH x AS (SELECT p_partkey AS id, {_ITEM} AS t, p_name || CASE p_size % 3 WHEN 0 THEN ' 2x' WHEN 1 THEN ' short 1,5x' ELSE '' END AS u FROM part)
 SELECT id, CASE WHEN {_INV.format(t='t')} <> {_INV.format(t='u')} THEN 'direction' WHEN coalesce({_LEV.format(t='u')}, 1) > coalesce({_LEV.format(t='t')}, 1) THEN 'leverage' END AS breaks FROM x""")
def str_06(spark, sf):
    """A replacement must go the same way and not be more leveraged."""
    s = F.col("p_size") % 3
    new = F.concat("p_name", F.when(s == 0, " 2x").when(s == 1, " short 1,5x").otherwise(""))
    old = _item()
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), reports.risk_profile(texts.says_inverse(old), texts.leverage(old), texts.says_inverse(new), texts.leverage(new)).alias("breaks"))


#: The parts as a catalog, and events as items: each proposes an id and claims something of the part its user holds.
_GROUND = rf"""ct AS (SELECT p_partkey AS id, p_name || ' ' || p_type || ' ' || p_brand AS title, p_retailprice AS popularity, CASE WHEN p_size > 40 THEN 3::DOUBLE WHEN p_size > 25 THEN 2 END AS lev, p_type = 'SMALL' AS inv, p_type FROM part),
 it AS (SELECT event_id AS item, user_id, value, event_id // 3 AS proposed, p_name AS concept, coalesce(p_name, '') || CASE WHEN value > 150 THEN ' 2x' ELSE '' END || CASE WHEN event_type = 'error' THEN ' inverse' ELSE '' END AS claim FROM events LEFT JOIN part ON p_partkey = user_id),
 ix AS (SELECT DISTINCT id, popularity, unnest(string_split(lower(title), ' ')) AS word FROM ct), wd AS (SELECT word, ln((SELECT count(*) FROM ct)::DOUBLE / count(*)) + 1 AS weight FROM ix GROUP BY 1),
 cw AS (SELECT DISTINCT concept, unnest(string_split(lower(concept), ' ')) AS word FROM it WHERE concept IS NOT NULL),
 cs AS (SELECT concept, id, round(sum(weight), 9) AS score, max(popularity) AS popularity FROM cw JOIN ix USING (word) JOIN wd USING (word) GROUP BY ALL), cr AS (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY score DESC, popularity DESC, id) AS rank FROM cs),
 to0 AS (SELECT concept, sum(weight) AS total FROM cw JOIN wd USING (word) GROUP BY 1), bs AS (SELECT concept, list(id ORDER BY rank) AS best FROM cr JOIN to0 USING (concept) WHERE rank <= 2 AND score >= 0.5 * total GROUP BY 1),
 g1 AS (SELECT it.*, c.id IS NOT NULL AS found, c.lev AS wl, coalesce(c.inv, FALSE) AS wi, {_LEV.format(t='claim')} AS said, {_INV.format(t='claim')} AS si, best FROM it LEFT JOIN ct c ON c.id = proposed LEFT JOIN bs USING (concept)),
 g2 AS (SELECT *, found AND NOT (said IS NOT NULL AND coalesce(said <> wl, TRUE)) AND si = wi AS ok, list_filter(best, lambda b: b <> proposed)[1] AS fx FROM g1),
 g3 AS (SELECT g2.*, CASE WHEN NOT ok THEN f.id END AS fix, CASE WHEN NOT ok THEN f.id IS NOT NULL AND NOT (said IS NOT NULL AND coalesce(said <> f.lev, TRUE)) AND si = f.inv AND (NOT found OR (wi = f.inv AND coalesce(f.lev, 1) <= coalesce(wl, 1))) END AS fixed FROM g2 LEFT JOIN ct f ON f.id = fx),
 gr AS (SELECT *, CASE WHEN ok THEN 'verified' WHEN coalesce(fixed, FALSE) THEN 'repaired' ELSE 'discarded' END AS grounding, CASE WHEN ok THEN proposed WHEN coalesce(fixed, FALSE) THEN fix END AS id FROM g3)"""


def _grounded(spark, sf):
    """The events' items after grounding, with user_id and value."""
    p = table(spark, sf, "part")
    catalog = p.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("title"), F.col("p_retailprice").alias("popularity"),
                       F.when(F.col("p_size") > 40, 3.0).when(F.col("p_size") > 25, 2.0).alias("leverage"), (F.col("p_type") == "SMALL").alias("is_inverse"))
    held = p.select(F.col("p_partkey").alias("user_id"), F.col("p_name").alias("concept"))
    e = table(spark, sf, "events").join(held, "user_id", "left")
    claim = F.concat(F.coalesce("concept", F.lit("")), F.when(F.col("value") > 150, " 2x").otherwise(""), F.when(F.col("event_type") == "error", " inverse").otherwise(""))
    items = e.select(F.col("event_id").alias("item"), "user_id", "value", F.floor(F.col("event_id") / 3).alias("proposed"), "concept", claim.alias("claim"))
    return grounding.ground(items, catalog)


@query("krn_38_grounding", f"WITH {_GROUND} SELECT item, grounding, id FROM gr")
def krn_38(spark, sf):
    """Each item is verified against the catalog, or repaired once by the best candidate of a word search, or discarded."""
    return _grounded(spark, sf).select("item", "grounding", "id")


@query("src_09_word_candidates", f"WITH {_GROUND} SELECT concept, id, score, CAST(rank AS INT) AS rank FROM cr WHERE rank <= 5")
def src_09_words(spark, sf):
    """The five best catalog entries for every concept, by the weights of shared words."""
    p = table(spark, sf, "part")
    catalog = p.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("title"), F.col("p_retailprice").alias("popularity"))
    concepts = table(spark, sf, "events").select("user_id").distinct().join(p, F.col("p_partkey") == F.col("user_id")).select(F.col("p_name").alias("concept"))
    return grounding.candidates(concepts, grounding.word_index(catalog))


@query("fil_06_entity_gate", f"WITH {_GROUND} SELECT item, id, grounding FROM gr WHERE grounding <> 'discarded'")
def fil_06(spark, sf):
    """Only what the grounding verified or repaired enters an analysis."""
    return reports.allowed(_grounded(spark, sf)).select("item", "id", "grounding")


@query("agg_33_rubric", f"""WITH {_GROUND}, t AS (SELECT user_id, item, gr.id IS NOT NULL AS kept, CAST(value AS DECIMAL(18,2)) AS w, coalesce(ct.p_type = 'ECONOMY', FALSE) AS stock FROM gr LEFT JOIN ct ON ct.id = gr.id)
 SELECT user_id AS thesis, count(*) FILTER (kept) AS existing, count(*) AS asked, round(coalesce(sum(CASE WHEN kept AND stock THEN w ELSE 0 END)::DOUBLE / nullif(sum(CASE WHEN kept THEN w ELSE 0 END)::DOUBLE, 0), 0), 3) + 0.0 AS stock_share, NOT arg_min(stock, item) FILTER (kept) AS first_is_no_stock FROM t GROUP BY 1""")
def agg_33(spark, sf):
    """Of each user's items: how many are in the catalog after grounding, the share of one class by weight, and whether the first is of another."""
    kinds = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_type") == "ECONOMY").alias("stock"))
    g = _grounded(spark, sf).join(kinds, "id", "left").withColumns({"kept": F.col("id").isNotNull(), "w": F.col("value").cast("decimal(18,2)"), "stock": F.coalesce("stock", F.lit(False))})
    none = F.lit(0).cast("decimal(18,2)")
    share = F.try_divide(F.sum(F.when(F.col("kept") & F.col("stock"), F.col("w")).otherwise(none)).cast("double"), F.sum(F.when(F.col("kept"), F.col("w")).otherwise(none)).cast("double"))
    return g.groupBy(F.col("user_id").alias("thesis")).agg(
        F.count_if("kept").alias("existing"), F.count("*").alias("asked"), (F.round(F.coalesce(share, F.lit(0.0)), 3) + F.lit(0.0)).alias("stock_share"),
        (~F.min_by(F.when(F.col("kept"), F.col("stock")), F.when(F.col("kept"), F.col("item")))).alias("first_is_no_stock"))


_RULES = """bw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda v: v <> '') AS w FROM benchmark),
 ru AS (SELECT item_id AS priority, 'theme ' || item_id % 7 AS theme, CASE WHEN item_id % 2 = 0 THEN w[3] || ' ' || w[4] ELSE w[5] END AS phrase FROM bw WHERE len(w) >= 5)"""


@query("str_07_rules", f"""WITH {_RULES}, dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda v: v <> '') AS w FROM documents),
 dp AS (SELECT DISTINCT doc_id, w[i] AS phrase FROM dw, range(1, len(w) + 1) g(i) UNION SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] FROM dw, range(1, len(w)) g(i)),
 m AS (SELECT doc_id, arg_min(theme, priority) AS theme FROM dp JOIN ru USING (phrase) GROUP BY 1) SELECT doc_id, coalesce(theme, 'general') AS theme FROM documents LEFT JOIN m USING (doc_id)""")
def str_07_rules(spark, sf):
    """The theme of every document by stored rules, a phrase of each benchmark item: the first rule by its place wins."""
    w = grounding.lower_words(F.col("text"))
    b = table(spark, sf, "benchmark").select("item_id", w.alias("w")).where(F.size("w") >= 5)
    phrase = F.when(F.col("item_id") % 2 == 0, F.concat_ws(" ", F.get("w", F.lit(2)), F.get("w", F.lit(3)))).otherwise(F.get("w", F.lit(4)))
    rules = b.select(F.col("item_id").alias("priority"), F.concat(F.lit("theme "), F.col("item_id") % 7).alias("theme"), phrase.alias("phrase"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), "text")
    return grounding.themes(d, rules).select(F.col("key").alias("doc_id"), "theme")


@query("str_07_themes", r"""WITH x AS (SELECT conv_id, turn, ' ' || lower(p_name || ' ' || coalesce(text, '')) || ' ' AS t FROM conversations JOIN part ON p_partkey = conv_id) SELECT conv_id, turn, CASE WHEN t LIKE '% red %' OR t LIKE '% widget %' THEN 'widgets' WHEN t LIKE '% la %' OR t LIKE '% le %' THEN 'french' WHEN t LIKE '% die %' OR t LIKE '% und %' THEN 'german' ELSE 'general' END AS theme FROM x""")
def str_07(spark, sf):
    """The first theme of which a word stands in a free text."""
    c = table(spark, sf, "conversations").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("conv_id"))
    t = F.concat_ws(" ", "p_name", F.coalesce("text", F.lit("")))
    themes = (("widgets", ("red", "widget")), ("french", ("la", "le")), ("german", ("die", "und")))
    return c.select("conv_id", "turn", texts.theme(t, themes).alias("theme"))


@query("str_08_failure_texts", r"""WITH x AS (SELECT event_id, event_id % 600 AS status, event_type || ' ' || props || CASE WHEN user_id % 4 = 0 THEN ' Rate limit reached' WHEN user_id % 4 = 1 THEN ' request timed out' ELSE '' END AS m FROM events)
 SELECT event_id, CASE WHEN status = 429 OR lower(m) LIKE '%rate limit%' OR lower(m) LIKE '%quota%' THEN 'quota' WHEN status IN (401, 403) THEN 'auth' WHEN status >= 500 THEN 'server' WHEN lower(m) LIKE '%timeout%' OR lower(m) LIKE '%timed out%' THEN 'timeout' ELSE 'other' END AS kind FROM x""")
def str_08(spark, sf):
    """The kind of a failure from its status and its message."""
    u = F.col("user_id") % 4
    m = F.concat("event_type", F.lit(" "), "props", F.when(u == 0, " Rate limit reached").when(u == 1, " request timed out").otherwise(""))
    return table(spark, sf, "events").select("event_id", texts.failure_kind(F.col("event_id") % 600, m).alias("kind"))


_NOISE = "CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN 'Here it is: ```json\n' || props || '\n``` done' WHEN 2 THEN 'so ' || props || ' yes' WHEN 3 THEN 'nothing here' ELSE '{broken' END"


@query("str_09_json_inside", f"SELECT event_id, CASE WHEN event_id % 5 < 3 THEN CAST(json_extract(regexp_extract({_NOISE}, '\\{{.*\\}}', 0, 's'), '$.k') AS BIGINT) END AS k FROM events")
def str_09(spark, sf):
    """A JSON object in a noisy text: the whole, in a fence, or between braces."""
    e, p = F.col("event_id") % 5, F.col("props")
    t = F.when(e == 0, p).when(e == 1, F.concat(F.lit("Here it is: ```json\n"), p, F.lit("\n``` done"))).when(e == 2, F.concat(F.lit("so "), p, F.lit(" yes"))).when(e == 3, "nothing here").otherwise("{broken")
    return table(spark, sf, "events").select("event_id", F.from_json(reports.json_inside(t), "k bigint")["k"].alias("k"))


@query("str_10_money", "SELECT p_partkey AS id, CASE WHEN v >= 1e9 THEN printf('$%.2fB', v / 1e9) WHEN v >= 1e6 THEN printf('$%.2fM', v / 1e6) ELSE printf('$%.2f', v) END AS shown FROM (SELECT *, p_retailprice * CASE WHEN p_size % 2 = 0 THEN 1e6 ELSE 1 END AS v FROM part)")
def str_10(spark, sf):
    """Money in billions, millions or whole."""
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), texts.money(F.col("p_retailprice") * F.when(F.col("p_size") % 2 == 0, 1e6).otherwise(1.0)).alias("shown"))


@query("str_12_revision_note", """WITH x AS (SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'adds' ELSE 'adds_nothing' END AS state, CASE p_size % 5 WHEN 0 THEN ' nsa' WHEN 1 THEN '' WHEN 2 THEN 'SAAR' WHEN 3 THEN NULL ELSE 'SA ' END AS adj, CASE p_size % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS held FROM part)
 SELECT id, CASE WHEN state <> 'adds' OR upper(trim(coalesce(adj, ''))) IN ('', 'NSA') OR coalesce(held, FALSE) THEN NULL WHEN held IS NULL THEN 'not checked as published' ELSE 'did not hold as published' END AS note FROM x""")
def str_12(spark, sf):
    """A note on revised data under a verdict, unless the series is not seasonally adjusted."""
    s = F.col("p_size")
    adj = F.when(s % 5 == 0, " nsa").when(s % 5 == 1, "").when(s % 5 == 2, "SAAR").when(s % 5 == 4, "SA ")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), reports.revision_note(
        F.when(s % 2 == 0, "adds").otherwise("adds_nothing"), adj, F.when(s % 3 == 0, True).when(s % 3 == 1, False)).alias("note"))


# Dates, arrays, maps, JSON

@query("dat_02_weeks", f"WITH {M5}, l AS (SELECT series_id, max(ts) AS t FROM m5 GROUP BY 1) SELECT series_id, CAST(h AS INT) AS h, CAST(t + INTERVAL 1 DAY * (7 * h) AS DATE) AS ts FROM l, range(1, 14) q(h)")
def dat_02(spark, sf):
    return calendar.weeks_ahead(series.monthly_segments(spark, sf).groupBy("series_id").agg(F.max("ts").alias("ts")), 13)


_GAPS = """d AS (SELECT DISTINCT o_custkey AS series_id, CAST(o_orderdate AS DATE) AS ts FROM orders), q AS (SELECT series_id, date_diff('day', lag(ts) OVER (PARTITION BY series_id ORDER BY ts), ts) AS gap FROM d),
 i AS (SELECT series_id, CASE WHEN count(*) < 3 THEN 'irregular' WHEN median(gap) <= 4 THEN 'daily' WHEN median(gap) BETWEEN 5 AND 10 THEN 'weekly' WHEN median(gap) BETWEEN 25 AND 35 THEN 'monthly' WHEN median(gap) BETWEEN 80 AND 100 THEN 'quarterly' WHEN median(gap) BETWEEN 350 AND 380 THEN 'annual' ELSE 'irregular' END AS inferred FROM q GROUP BY 1)"""


@query("dat_05_hints", f"""WITH {_GAPS}, h AS (SELECT c_custkey AS series_id, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'W' WHEN 'BUILDING' THEN 'M' WHEN 'FURNITURE' THEN 'Q' WHEN 'HOUSEHOLD' THEN 'A' END AS hint FROM customer),
 f AS (SELECT series_id, inferred, hint, CASE WHEN inferred <> 'irregular' THEN inferred ELSE CASE hint WHEN 'W' THEN 'weekly' WHEN 'M' THEN 'monthly' WHEN 'Q' THEN 'quarterly' WHEN 'A' THEN 'annual' ELSE 'daily' END END AS frequency FROM i JOIN h USING (series_id))
 SELECT *, CASE frequency WHEN 'weekly' THEN 13 WHEN 'monthly' THEN 12 WHEN 'quarterly' THEN 4 WHEN 'annual' THEN 2 ELSE 60 END AS horizon FROM f""")
def dat_05(spark, sf):
    """The frequency of each customer's order dates; where it is irregular what the code of their segment says, else daily; and its horizon."""
    d = table(spark, sf, "orders").select(F.col("o_custkey").alias("series_id"), F.col("o_orderdate").cast("date").alias("ts")).distinct()
    codes = {"AUTOMOBILE": "W", "BUILDING": "M", "FURNITURE": "Q", "HOUSEHOLD": "A"}
    hint = None
    for segment, code in codes.items():
        hint = F.when(F.col("c_mktsegment") == segment, code) if hint is None else hint.when(F.col("c_mktsegment") == segment, code)
    h = table(spark, sf, "customer").select(F.col("c_custkey").alias("series_id"), hint.alias("hint"))
    x = align.frequency(d).select("series_id", F.col("frequency").alias("inferred")).join(h, "series_id").withColumn("frequency", calendar.resolved(F.col("inferred"), F.col("hint")))
    return x.select("series_id", "inferred", "hint", "frequency", calendar.horizon(F.col("frequency")).alias("horizon"))


@query("dat_06_add_months", f"WITH {M1} SELECT ts, CAST(k AS INT) AS k, strftime(last_day(CAST(date_trunc('month', ts) + INTERVAL 1 MONTH * k AS DATE)), '%Y-%m-%d') AS later, CAST(year(ts) * 12 + month(ts) - 1 AS INT) AS month_index FROM m1, (VALUES (-13), (1), (24)) t(k)")
def dat_06(spark, sf):
    """Months added to a month end, as text, and the number of a month."""
    m = series.monthly_orders(spark, sf).select("ts", F.explode(F.array(F.lit(-13), F.lit(1), F.lit(24))).alias("k"))
    return m.select("ts", "k", F.last_day(F.add_months(F.trunc("ts", "month"), F.col("k"))).cast("string").alias("later"), (F.year("ts") * 12 + F.month("ts") - 1).alias("month_index"))


@query("arr_01_last_rows", f"WITH {M5}, a AS (SELECT series_id, list(ts ORDER BY ts) AS d, list(value ORDER BY ts) AS v FROM m5 GROUP BY 1) SELECT series_id, d[-1] AS last_ts, v[-1] AS last, v[-3] AS third, len(d) AS n FROM a")
def arr_01(spark, sf):
    """Parallel arrays of a series, their last and third last items."""
    a = evidence.arrays(series.monthly_segments(spark, sf))
    z = a.select("series_id", F.col("n").cast("long").alias("n"), F.slice(F.arrays_zip("dates", "values"), -3, 3).alias("z"))
    return z.select("series_id", F.element_at("z", -1)["dates"].alias("last_ts"), F.element_at("z", -1)["values"].alias("last"), F.element_at("z", 1)["values"].alias("third"), "n")


@query("map_01_normalized", """WITH w AS (SELECT p_brand AS book, p_type AS name, sum(CASE WHEN p_size % 2 = 0 AND p_brand <> 'Brand#2' THEN p_size ELSE -1 END)::DOUBLE AS w FROM part GROUP BY ALL), n AS (SELECT b.book, t.name, greatest(coalesce(w.w, 0), 0) AS w FROM (SELECT DISTINCT book FROM w) b, (SELECT DISTINCT p_type AS name FROM part) t LEFT JOIN w ON w.book = b.book AND w.name = t.name)
 SELECT book, name, round(CASE WHEN sum(w) OVER (PARTITION BY book) > 0 THEN w / sum(w) OVER (PARTITION BY book) ELSE 1.0 / count(*) OVER (PARTITION BY book) END, 6) + 0.0 AS w FROM n""")
def map_01(spark, sf):
    """Weights of each book that add to 1: missing and negative ones are 0, and all are equal where none is positive."""
    from tidemark.operators import portfolio

    p = table(spark, sf, "part")
    w = p.groupBy(F.col("p_brand").alias("book"), F.col("p_type").alias("name")).agg(F.sum(F.when((F.col("p_size") % 2 == 0) & (F.col("p_brand") != "Brand#2"), F.col("p_size")).otherwise(-1)).cast("double").alias("w"))
    names = p.agg(F.collect_set("p_type").alias("names"))  # a handful of types
    return rounded(portfolio.normalized_books(w, w.select("book").distinct().join(F.broadcast(names)).select("book", F.explode("names").alias("name"))))


@query("jsn_01_id_lists", """WITH x AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '[]' WHEN 1 THEN '["a' || user_id || '", "' || event_type || '"]' WHEN 2 THEN '["a", ' END AS t FROM events)
 SELECT event_id, CASE WHEN t IS NOT NULL AND json_valid(t) THEN coalesce(array_to_string(json_extract_string(t, '$[*]'), ','), '') ELSE '' END AS ids FROM x""")
def jsn_01(spark, sf):
    """Ids of a JSON array; none where it is empty, null or broken."""
    e = F.col("event_id") % 4
    t = F.when(e == 0, "[]").when(e == 1, F.to_json(F.array(F.concat(F.lit("a"), F.col("user_id").cast("string")), "event_type"))).when(e == 2, "[\"a\", ")
    return table(spark, sf, "events").select("event_id", F.array_join(reports.ids_in(t), ",").alias("ids"))


@query("jsn_02_evidence_blob", f"{dq.PAIRS} SELECT series_id, cutoff, {r('base', 'base', 3)}, {r('challenger', 'challenger', 3)}, {r('rw', 'rw', 3)}, {r('snaive', 'snaive', 3)} FROM pr")
def jsn_02(spark, sf):
    """The evidence of each series as one JSON text, and read back."""
    x = F.struct(F.col("cutoff").cast("string").alias("cutoff"), "base", "challenger", "rw", "snaive")
    blobs = dq._pairs(spark, sf).groupBy("series_id").agg(F.to_json(F.array_sort(F.collect_list(x))).alias("blob"))
    back = blobs.select("series_id", F.explode(F.from_json("blob", "array<struct<cutoff:string,base:double,challenger:double,rw:double,snaive:double>>")).alias("x"))
    return rounded(back.select("series_id", F.col("x.cutoff").cast("date").alias("cutoff"), "x.base", "x.challenger", "x.rw", "x.snaive"), 3)


# Mutable tables

@query("mut_01_cascade", """WITH l AS (SELECT user_id AS id, event_type = 'error' AS gone FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) SELECT o_orderkey AS child, o_custkey AS parent_id FROM orders JOIN l ON id = o_custkey WHERE NOT gone""")
def mut_01(spark, sf):
    """A deleted parent takes its children along."""
    log = table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("version"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"))
    return store.children(table(spark, sf, "orders").select(F.col("o_orderkey").alias("child"), F.col("o_custkey").alias("parent_id")), store.current(log))


@query("krn_16_model_available", """SELECT o_orderkey AS series_id, o_orderkey % 5 = 0 OR o_orderkey % 12 < 10 OR date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') > 30 OR o_totalprice >= 200000 AS stale FROM orders""")
def krn_16(spark, sf):
    """Decisions made without the model, now that it is there, are made again, like old ones and those of series that grew."""
    d = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("series_id"), (F.col("o_orderkey") % 12).alias("version"), F.col("o_orderdate").cast("date").alias("evaluated_at"),
        F.col("o_totalprice").alias("n_now"), F.lit(200000.0 / 1.2).alias("n_then"), F.when(F.col("o_orderkey") % 5 > 0, 1.0).alias("challenger_error"))
    return store.stale(d, "2001-08-01", available=True).select("series_id", "stale")


@query("mut_02_append", """WITH p AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 > 0), n AS (SELECT user_id AS parent_id, event_id, ts FROM events) SELECT parent_id, event_id AS child, CAST(row_number() OVER (PARTITION BY parent_id ORDER BY ts, event_id) AS INT) AS place FROM n JOIN p ON id = parent_id""")
def mut_02(spark, sf):
    """Notes appended in two batches to a stored table, those of theses that exist; others are refused."""
    path, parents = new_path(spark, "notes"), new_path(spark, "theses")
    tables.append(table(spark, sf, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("id")), parents)
    for half in (F.col("event_type") < "p", F.col("event_type") >= "p"):
        batch = table(spark, sf, "events").where(half).select(F.col("user_id").alias("parent_id"), "event_id", "ts")
        tables.append(store.children(batch, tables.read(spark, parents)), path)
    kept = tables.read(spark, path)
    return kept.select("parent_id", F.col("event_id").alias("child"), F.row_number().over(W.partitionBy("parent_id").orderBy("ts", "event_id")).alias("place"))


@query("mut_04_added_columns", "SELECT event_id AS id, value, CASE WHEN event_id % 2 = 1 THEN event_type END AS kind, CASE WHEN event_id % 2 = 1 THEN user_id ELSE 0 END AS votes FROM events")
def mut_04(spark, sf):
    """A stored table to which a batch with two more columns is appended, read as one: what is missing is null, or its default."""
    e, path = table(spark, sf, "events"), new_path(spark, "migrated")
    tables.append(e.where("event_id % 2 = 0").select(F.col("event_id").alias("id"), "value"), path)
    tables.append(e.where("event_id % 2 = 1").select(F.col("event_id").alias("id"), "value", F.col("event_type").alias("kind"), F.col("user_id").alias("votes")), path)
    return tables.read(spark, path, defaults={"votes": 0})


@query("mut_04_versions", "SELECT CAST(1 AS INT) AS version, count(*) AS n, 2 AS columns FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 2, count(*), 3 FROM events")
def mut_04_versions(spark, sf):
    """The versions of a stored table, each as it was: rows and columns."""
    e, path = table(spark, sf, "events"), new_path(spark, "versions")
    one = tables.append(e.where("event_id % 2 = 0").select("event_id", "value"), path)
    two = tables.append(e.where("event_id % 2 = 1").select("event_id", "value", "event_type"), path)
    both = [(v, tables.read(spark, path, v)) for v in (one, two)]
    out = [d.agg(F.lit(v).alias("version"), F.count("*").alias("n"), F.lit(len(d.columns)).alias("columns")) for v, d in both]
    return out[0].unionByName(out[1])


@query("snk_03_tables", """SELECT s.user_id AS thesis, count(*) AS snapshots, max(s.value) AS largest FROM events s JOIN customer ON c_custkey = s.user_id GROUP BY 1""")
def snk_03(spark, sf):
    """The tables of theses and snapshots, stored and joined on their keys."""
    theses, snapshots = new_path(spark, "theses"), new_path(spark, "snapshots")
    tables.append(table(spark, sf, "customer").select(F.col("c_custkey").alias("thesis"), F.col("c_name").alias("title")), theses)
    tables.append(table(spark, sf, "events").select(F.col("user_id").alias("thesis"), "event_id", "ts", "value"), snapshots)
    t = tables.read(spark, theses).select("thesis")
    return tables.read(spark, snapshots).select("thesis", "value").join(t, "thesis", "left_semi").groupBy("thesis").agg(F.count("*").alias("snapshots"), F.max("value").alias("largest"))
