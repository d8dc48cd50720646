"""Queries on forecasts, backtests and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.operators import backtest, decisions, holt
from tidemark.sources import series
from tidemark.sources.shared import settled

from .base import M5, r, rounded

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


H = 6
CUTOFFS = ("1999-06-30", "1999-12-31", "2000-06-30", "2000-12-31")
_CUT = "c(cutoff) AS (VALUES " + ", ".join(f"(DATE '{d}')" for d in CUTOFFS) + ")"
_SPLIT = f"""{M5}, {_CUT}, tr AS (SELECT series_id, cutoff, ts, value, CAST(row_number() OVER w AS INT) AS k FROM m5 JOIN c ON ts <= cutoff WINDOW w AS (PARTITION BY series_id, cutoff ORDER BY ts)),
 ev AS (SELECT series_id, cutoff, CAST(row_number() OVER (PARTITION BY series_id, cutoff ORDER BY ts) AS INT) AS h, value AS actual FROM m5 JOIN c ON ts > cutoff QUALIFY h <= {H})"""


def _holt_sql(prefix: str, alpha: float, beta: float, phi: float, z: float, use: str = "e") -> str:
    """The filter as a recursive query, and its forecasts."""
    p = prefix
    return f"""{p}f AS (SELECT series_id, cutoff, 1 AS k, CAST(0 AS DOUBLE) AS l, CAST(0 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS sse FROM tr WHERE k = 1
  UNION ALL SELECT tr.series_id, tr.cutoff, tr.k,
    CASE WHEN tr.k = 2 THEN (y0 + (y1 - y0)*{phi}) + {alpha} * (ln(value) - (y0 + {phi} * (y1 - y0))) ELSE l + {phi} * b + {alpha} * (ln(value) - (l + {phi} * b)) END,
    CASE WHEN tr.k = 2 THEN {phi} * (y1 - y0) + {alpha} * {beta} * (ln(value) - (y0 + {phi} * (y1 - y0))) ELSE {phi} * b + {alpha} * {beta} * (ln(value) - (l + {phi} * b)) END,
    sse + CASE WHEN tr.k = 2 THEN pow(ln(value) - (y0 + {phi} * (y1 - y0)), 2) ELSE pow(ln(value) - (l + {phi} * b), 2) END
    FROM {p}f f JOIN tr ON f.series_id = tr.series_id AND f.cutoff = tr.cutoff AND tr.k = f.k + 1 JOIN st ON st.series_id = tr.series_id AND st.cutoff = tr.cutoff),
 {p}e AS (SELECT series_id, cutoff, arg_max(l, k) AS l, arg_max(b, k) AS b, max(sse) / (max(k) - 1) AS s2 FROM {p}f GROUP BY ALL),
 {p}h AS (SELECT series_id, cutoff, CAST(h AS INT) AS h, l + b * {phi} * (1 - pow({phi}, h)) / (1 - {phi}) AS mu,
    s2 * (1 + coalesce((SELECT sum(pow({alpha} + {alpha} * {beta} * {phi} * (1 - pow({phi}, j)) / (1 - {phi}), 2)) FROM range(1, h) g(j)), 0)) AS v FROM {p}e, range(1, {H + 1}) q(h)),
 {p} AS (SELECT series_id, cutoff, h, exp(mu + v / 2) AS value, exp(mu - {z} * sqrt(v)) AS lower, exp(mu + {z} * sqrt(v)) AS upper FROM {p}h)"""


_ST = "st AS (SELECT series_id, cutoff, max(CASE WHEN k = 1 THEN ln(value) END) AS y0, max(CASE WHEN k = 2 THEN ln(value) END) AS y1 FROM tr GROUP BY ALL)"
Z95 = "1.959963984540054"
A = holt.DEFAULT
B = (0.6, 0.05, 0.9)
_HOLT = f"WITH RECURSIVE {_SPLIT}, {_ST}, {_holt_sql('ha', *A, Z95)}"
_BOTH = f"{_HOLT}, {_holt_sql('hb', *B, Z95)}"


def _errors_sql(forecast: str, name: str, band: bool = True) -> str:
    inside = "avg(CASE WHEN actual BETWEEN lower AND upper THEN 1.0 ELSE 0 END) * 100" if band else "NULL"
    return f"""sc AS (SELECT series_id, cutoff, avg(d1) AS scale, avg(dm) AS season, arg_max(value, ts) AS last FROM (SELECT *, abs(value - lag(value) OVER w) AS d1, abs(value - lag(value, 12) OVER w) AS dm FROM tr WINDOW w AS (PARTITION BY series_id, cutoff ORDER BY ts)) GROUP BY ALL),
 x AS (SELECT *, abs(actual - value) AS e, sign(actual - lag(actual) OVER w) = sign(value - lag(value) OVER w) AS same FROM {forecast} JOIN ev USING (series_id, cutoff, h) JOIN sc USING (series_id, cutoff) WINDOW w AS (PARTITION BY series_id, cutoff ORDER BY h)),
 {name} AS (SELECT series_id, cutoff, count(*) AS n, avg(e) AS mae, 100 * avg(e / abs(actual)) AS mape, 100 * avg(2 * e / (abs(actual) + abs(value) + 1e-8)) AS smape, avg(e) / max(scale) AS mase, avg(e) / max(season) AS seasonal_mase,
  coalesce(100 * avg(CASE WHEN same THEN 1.0 WHEN NOT same THEN 0 END), 50) AS direction, sign(arg_max(actual, h) - max(last)) = sign(arg_max(value, h) - max(last)) AS end_direction, {inside} AS coverage FROM x GROUP BY ALL)"""


_ROUND = "series_id, cutoff, n, " + ", ".join(r(c, c) for c in ("mae", "mape", "smape", "mase", "seasonal_mase", "direction")) + ", end_direction, " + r("coverage", "coverage")


def _split(spark, sf):
    return backtest.splits_at(series.monthly_segments(spark, sf), CUTOFFS, H)


@query("krn_01_holt_filter", f"WITH RECURSIVE {_SPLIT}, {_ST}, {_holt_sql('ha', *A, Z95)} SELECT series_id, cutoff, {r('l', 'l')}, {r('b', 'b')}, {r('s2', 's2')} FROM hae")
def krn_01(spark, sf):
    """The damped filter as a fold: last level, trend and mean squared error."""
    train, _ = _split(spark, sf)
    f = holt.with_parameters(holt.training_arrays(backtest.per_cutoff(train)))
    return rounded(backtest.split_key(f.select("series_id", F.col("state.l").alias("l"), F.col("state.b").alias("b"), (F.col("state.sse") / F.col("state.n")).alias("s2"))))


@query("krn_03_holt_forecast", f"{_HOLT} SELECT series_id, cutoff, h, {r('value', 'value', 2)}, {r('lower', 'lower', 2)}, {r('upper', 'upper', 2)} FROM ha")
def krn_03(spark, sf):
    train, _ = _split(spark, sf)
    return rounded(backtest.holt_forecasts(train, H, 0.95), 2)


@query("krn_07_seasonal_naive", f"WITH {_SPLIT}, n AS (SELECT *, row_number() OVER (PARTITION BY series_id, cutoff ORDER BY ts DESC) AS back FROM tr) SELECT series_id, cutoff, CAST(h AS INT) AS h, value FROM n JOIN range(1, {H + 1}) q(h) ON 12 - back = (h - 1) % 12")
def krn_07(spark, sf):
    return backtest.seasonal_naive_forecasts(_split(spark, sf)[0], H, 12)


_NAIVE = f"""nv AS (SELECT series_id, cutoff, CAST(h AS INT) AS h, last AS value, last - 1.96 * sd * sqrt(h) AS lower, last + 1.96 * sd * sqrt(h) AS upper FROM (SELECT series_id, cutoff, arg_max(value, ts) AS last, stddev_pop(d) AS sd FROM
 (SELECT *, value - lag(value) OVER (PARTITION BY series_id, cutoff ORDER BY ts) AS d FROM tr) GROUP BY ALL), range(1, {H + 1}) q(h))"""


@query("krn_08_naive", f"WITH {_SPLIT}, {_NAIVE} SELECT series_id, cutoff, h, {r('value', 'value', 3)}, {r('lower', 'lower', 3)}, {r('upper', 'upper', 3)} FROM nv")
def krn_08(spark, sf):
    return rounded(backtest.naive_forecasts(_split(spark, sf)[0], H), 3)


@query("krn_12_backtest_holt", f"{_HOLT}, {_errors_sql('ha', 'er')} SELECT {_ROUND} FROM er")
def krn_12(spark, sf):
    """AGG-01 to AGG-08, JOIN-07: all metrics of the damped filter for each series and cutoff; krn_12_verdict has the verdict."""
    train, after = _split(spark, sf)
    return rounded(backtest.errors(backtest.holt_forecasts(train, H, 0.95), after, train))


@query("agg_09_backtest_naive", f"WITH {_SPLIT}, {_NAIVE}, {_errors_sql('nv', 'er')} SELECT {_ROUND} FROM er")
def agg_09(spark, sf):
    train, after = _split(spark, sf)
    return rounded(backtest.errors(backtest.naive_forecasts(train, H), after, train))


@query("agg_10_backtest_seasonal_naive", f"WITH {_SPLIT}, n AS (SELECT *, row_number() OVER (PARTITION BY series_id, cutoff ORDER BY ts DESC) AS back FROM tr), sn AS (SELECT series_id, cutoff, CAST(h AS INT) AS h, value FROM n JOIN range(1, {H + 1}) q(h) ON 12 - back = (h - 1) % 12), {_errors_sql('sn', 'er', False)} SELECT {_ROUND} FROM er")
def agg_10(spark, sf):
    train, after = _split(spark, sf)
    return rounded(backtest.errors(backtest.seasonal_naive_forecasts(train, H, 12), after, train))


_LOG_ERRORS = f"""ea AS (SELECT series_id, cutoff, avg(abs(actual - value)) AS base FROM ha JOIN ev USING (series_id, cutoff, h) GROUP BY ALL), eb AS (SELECT series_id, cutoff, avg(abs(actual - value)) AS challenger FROM hb JOIN ev USING (series_id, cutoff, h) GROUP BY ALL),
 pairs AS (SELECT * FROM ea JOIN eb USING (series_id, cutoff))"""


def _pairs(spark, sf):
    train, after = _split(spark, sf)
    f = backtest.holt_forecasts_of(train, H, 0.95, {"base": A, "challenger": B}).join(after, ["series_id", "cutoff", "h"])
    e = F.abs(F.col("actual") - F.col("value"))
    return f.groupBy("series_id", "cutoff").agg(*[F.avg(F.when(F.col("engine") == n, e)).alias(n) for n in ("base", "challenger")])


@query("join_06_pairs", f"{_BOTH}, {_LOG_ERRORS} SELECT series_id, cutoff, {r('base', 'base', 3)}, {r('challenger', 'challenger', 3)} FROM pairs")
def join_06(spark, sf):
    """Paired errors of two engines at the same four cutoffs; krn_13_tournament has eight."""
    return rounded(_pairs(spark, sf), 3)


@query("krn_14_decide", f"""{_BOTH}, {_LOG_ERRORS}, g AS (SELECT series_id, count(*) AS n, count(*) FILTER (challenger < base) AS wins, count(*) FILTER (challenger > base) AS losses, avg(base) AS base_mean, avg(challenger) AS challenger_mean FROM pairs GROUP BY 1)
 SELECT series_id, n, wins, losses, {r('base_mean', 'base_mean', 3)}, {r('challenger_mean', 'challenger_mean', 3)}, CASE WHEN n >= 3 AND wins > losses AND base_mean > 0 AND challenger_mean <= base_mean * 0.98 THEN 'challenger' ELSE 'baseline' END AS choice FROM g""")
def krn_14(spark, sf):
    """The core of the robust rule, here with three pairs and two percent; krn_14_hysteresis has the rule in full."""
    return rounded(backtest.decide(_pairs(spark, sf), least=3, margin=0.02), 3)


#: Of each user and event type: days on which more, and on which less, than 50 was spent; at most 30 days.
_DAYS = "dy AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day, sum(CAST(value AS DECIMAL(18,2))) AS v FROM events GROUP BY ALL), wl AS (SELECT user_id, event_type, count(*) FILTER (v > 50) AS wins, count(*) FILTER (v < 50) AS losses FROM dy GROUP BY ALL)"
_ONE_SIDED = "CASE WHEN {w} + {lo} = 0 THEN 1.0::DOUBLE ELSE (SELECT sum(factorial(CAST({w} + {lo} AS INT)) // (factorial(CAST(k AS INT)) * factorial(CAST({w} + {lo} - k AS INT)))) FROM range({w}, {w} + {lo} + 1) g(k))::DOUBLE / pow(2, {w} + {lo}) END"


def _wins_and_losses(spark, sf):
    e = series.table(spark, sf, "events").groupBy("user_id", "event_type", F.col("ts").cast("date").alias("day")).agg(F.sum(F.col("value").cast("decimal(18,2)")).alias("v"))
    return e.groupBy("user_id", "event_type").agg(F.count_if(F.col("v") > 50).alias("wins"), F.count_if(F.col("v") < 50).alias("losses"))


@query("mth_02_sign_test", f"WITH {_DAYS} SELECT user_id, event_type, wins, losses, {_ONE_SIDED.format(w='wins', lo='losses')} AS p FROM wl")
def mth_02(spark, sf):
    """Exact one-sided sign test of days over against days under 50, for each user and event type."""
    w = _wins_and_losses(spark, sf)
    return w.withColumn("p", decisions.sign_p(F.col("wins"), F.col("losses")))


@query("mth_02_two_sided", f"WITH {_DAYS} SELECT user_id, event_type, wins, losses, least(1, 2 * ({_ONE_SIDED.format(w='greatest(wins, losses)', lo='least(wins, losses)')})) AS p FROM wl")
def mth_02_both(spark, sf):
    """The two-sided test of the same days."""
    w = _wins_and_losses(spark, sf)
    return w.withColumn("p", decisions.sign_p_both(F.col("wins"), F.col("losses")))


@query("mth_03_holm", """WITH t AS (SELECT n_name AS name, (n_nationkey + 1) * 0.0007::DOUBLE AS p FROM nation), x AS (SELECT *, row_number() OVER (ORDER BY p, name) AS place, count(*) OVER () AS k FROM t), o AS (SELECT *, p <= 0.05::DOUBLE / (k - place + 1) AS ok FROM x)
 SELECT name, round(p, 6) + 0.0 AS p, CAST(place AS INT) AS place, min(CAST(ok AS INT)) OVER (ORDER BY place) = 1 AS passes FROM o""")
def mth_03(spark, sf):
    t = series.table(spark, sf, "nation").select(F.col("n_name").alias("name"), ((F.col("n_nationkey") + 1) * 0.0007).alias("p"))
    return rounded(backtest.holm(t))


@query("ord_03_cutoffs", f"""WITH {M5}, x AS (SELECT series_id, ts, CAST(row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS INT) AS place FROM m5), n AS (SELECT series_id, count(*) AS n FROM x GROUP BY 1),
 p AS (SELECT DISTINCT series_id, round_even(greatest(29, n - 7 - 40) + i * (n - 7 - greatest(29, n - 7 - 40)) / 7.0::DOUBLE, 0) AS place FROM n, range(0, 8) g(i)) SELECT series_id, ts AS cutoff, place FROM x JOIN p USING (series_id, place)""")
def ord_03(spark, sf):
    """Eight evenly spaced cutoffs in the last 40 points."""
    return backtest.recent_cutoffs(series.monthly_segments(spark, sf), 8, 6, 40)


@query("ord_06_best_rival", f"""WITH {_SPLIT}, {_NAIVE}, n AS (SELECT *, row_number() OVER (PARTITION BY series_id, cutoff ORDER BY ts DESC) AS back FROM tr), sn AS (SELECT series_id, cutoff, CAST(h AS INT) AS h, value FROM n JOIN range(1, {H + 1}) q(h) ON 12 - back = (h - 1) % 12),
 e AS (SELECT series_id, cutoff, 'random walk' AS rival, 1 AS pr, avg(abs(actual - value)) AS mae FROM nv JOIN ev USING (series_id, cutoff, h) GROUP BY ALL UNION ALL SELECT series_id, cutoff, 'seasonal', 2, avg(abs(actual - value)) FROM sn JOIN ev USING (series_id, cutoff, h) GROUP BY ALL)
 SELECT series_id, cutoff, rival, {r('mae', 'mae', 3)} FROM e QUALIFY row_number() OVER (PARTITION BY series_id, cutoff ORDER BY mae, pr) = 1""")
def ord_06(spark, sf):
    """The rival with the smallest error; on a tie the random walk."""
    train, after = _split(spark, sf)
    both = backtest.naive_forecasts(train, H).select("series_id", "cutoff", "h", "value", F.lit("random walk").alias("rival"), F.lit(1).alias("pr")).unionByName(
        backtest.seasonal_naive_forecasts(train, H, 12).select("series_id", "cutoff", "h", "value", F.lit("seasonal").alias("rival"), F.lit(2).alias("pr")))
    e = both.join(after, ["series_id", "cutoff", "h"]).groupBy("series_id", "cutoff", "rival", "pr").agg(F.avg(F.abs(F.col("actual") - F.col("value"))).alias("mae"))
    w = W.partitionBy("series_id", "cutoff").orderBy("mae", "pr")
    return rounded(e.withColumn("k", F.row_number().over(w)).where("k = 1").select("series_id", "cutoff", "rival", "mae"), 3)


@query("krn_22_stability", f"""{_BOTH}, {_LOG_ERRORS}, k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY cutoff) AS i FROM pairs),
 t AS (SELECT a.series_id, a.i AS a, b.i AS b, (a.base + b.base) / 2 > (a.challenger + b.challenger) / 2 AS pick FROM k a JOIN k b ON a.series_id = b.series_id AND a.i < b.i),
 f AS (SELECT series_id, avg(base) > avg(challenger) AS pick FROM pairs GROUP BY 1)
 SELECT series_id, count(*) AS subsets, {r('avg(CASE WHEN t.pick <> f.pick THEN 1.0 ELSE 0 END)', 'disagree')} FROM t JOIN f USING (series_id) GROUP BY 1""")
def krn_22(spark, sf):
    """How often a pair of the four cutoffs decides otherwise than all of them: pairs by a self-join i < j; krn_22_triples takes triples of 24."""
    p = settled(_pairs(spark, sf))
    k = p.withColumn("i", F.row_number().over(W.partitionBy("series_id").orderBy("cutoff")))
    a, b = k.select("series_id", F.col("i").alias("a"), F.col("base").alias("ba"), F.col("challenger").alias("ca")), k.select("series_id", F.col("i").alias("b"), F.col("base").alias("bb"), F.col("challenger").alias("cb"))
    t = a.join(b, "series_id").where("a < b").select("series_id", (F.col("ba") + F.col("bb") > F.col("ca") + F.col("cb")).alias("pick"))
    full = p.groupBy("series_id").agg((F.avg("base") > F.avg("challenger")).alias("all"))
    g = t.join(full, "series_id").groupBy("series_id").agg(F.count("*").alias("subsets"), F.avg((F.col("pick") != F.col("all")).cast("double")).alias("disagree"))
    return rounded(g)


@query("krn_21_regret", f"""{_BOTH}, {_LOG_ERRORS}, s AS (SELECT series_id, avg(base) > avg(challenger) AS pick FROM pairs WHERE cutoff < DATE '2000-06-30' GROUP BY 1)
 SELECT series_id, {r('least(1.0, CASE WHEN least(avg(base), avg(challenger)) > 0 THEN CASE WHEN bool_and(pick) THEN avg(challenger) ELSE avg(base) END / least(avg(base), avg(challenger)) - 1 END)', 'regret')} FROM pairs JOIN s USING (series_id) WHERE cutoff >= DATE '2000-06-30' GROUP BY 1""")
def krn_21(spark, sf):
    """What the choice of the early cutoffs costs on the held-out ones, at most 1."""
    p = settled(_pairs(spark, sf))
    s = p.where("cutoff < date'2000-06-30'").groupBy("series_id").agg((F.avg("base") > F.avg("challenger")).alias("pick"))
    g = p.where("cutoff >= date'2000-06-30'").join(s, "series_id").groupBy("series_id").agg(F.avg("base").alias("b"), F.avg("challenger").alias("c"), F.bool_and("pick").alias("pick"))
    best = F.least("b", "c")
    return rounded(g.select("series_id", F.least(F.lit(1.0), F.when(best > 0, F.when(F.col("pick"), F.col("c")).otherwise(F.col("b")) / best - 1)).alias("regret")))


@query("krn_10_relevel", f"{_HOLT}, x AS (SELECT *, (ln(lower) + ln(upper)) / 2 AS mu, (ln(upper) - ln(lower)) / (2 * {Z95}) AS se FROM ha) SELECT series_id, cutoff, h, {r('exp(mu - 1.2815515655446004 * se)', 'lower', 2)}, {r('exp(mu + 1.2815515655446004 * se)', 'upper', 2)} FROM x")
def krn_10(spark, sf):
    """The 80 percent band out of the 95 percent one."""
    train, _ = _split(spark, sf)
    f = backtest.holt_forecasts(train, H, 0.95)
    mu, se = (F.ln("lower") + F.ln("upper")) / 2, (F.ln("upper") - F.ln("lower")) / (2 * 1.959963984540054)
    return rounded(f.select("series_id", "cutoff", "h", F.exp(mu - 1.2815515655446004 * se).alias("lower"), F.exp(mu + 1.2815515655446004 * se).alias("upper")), 2)


@query("mth_04_explosion", f"""{_HOLT}, mv AS (SELECT series_id, cutoff, max(abs(m)) AS move, arg_max(value, ts) AS last FROM (SELECT *, ln(lead(value, {H}) OVER (PARTITION BY series_id, cutoff ORDER BY ts) / value) AS m FROM tr) GROUP BY ALL)
 SELECT ha.series_id, ha.cutoff, {r('max(abs(ln(value / last))) / max(move)', 'x')}, max(abs(ln(value / last))) / max(move) > 2 AS flag FROM ha JOIN mv USING (series_id, cutoff) WHERE h = {H} GROUP BY ALL""")
def mth_04(spark, sf):
    """Reliability: how far a forecast goes against the largest move the series ever made in as many steps."""
    from tidemark.operators import returns

    train, _ = _split(spark, sf)
    move = backtest.split_key(returns.horizon_move(backtest.per_cutoff(train), H))
    last = train.groupBy("series_id", "cutoff").agg(F.max_by("value", "ts").alias("last"))
    f = backtest.holt_forecasts(train, H, 0.95).where(F.col("h") == H)
    x = F.abs(F.ln(F.col("value") / F.col("last"))) / F.col("max_move")
    return rounded(f.join(move, ["series_id", "cutoff"]).join(last, ["series_id", "cutoff"]).select("series_id", "cutoff", x.alias("x"), (x > 2).alias("flag")))


GRID = ((0.1, 0.3, 0.6), (0.05, 0.1, 0.3), (0.85, 0.95))


@query("krn_02_grid_fit", f"""WITH RECURSIVE {M5}, x AS (SELECT series_id, ln(value) AS y, CAST(row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS INT) AS place FROM m5), g AS (SELECT a::DOUBLE AS a, b::DOUBLE AS b, f::DOUBLE AS f FROM {', '.join(f"(VALUES {', '.join(f'({v})' for v in vs)}) g{n}({n})" for n, vs in zip('abf', GRID))}),
 fl AS (SELECT x.series_id, a, b, f, 0 AS place, x.y AS l, x1.y - x.y AS tr, 0::DOUBLE AS sse FROM x JOIN x x1 ON x1.series_id = x.series_id AND x1.place = 1, g WHERE x.place = 0
  UNION ALL SELECT fl.series_id, a, b, f, x.place, l + f * tr + a * (y - l - f * tr), f * tr + a * b * (y - l - f * tr), sse + pow(y - l - f * tr, 2) FROM fl JOIN x ON x.series_id = fl.series_id AND x.place = fl.place + 1),
 e AS (SELECT series_id, a, b, f, max(sse) AS sse FROM fl GROUP BY ALL) SELECT series_id, a AS alpha, b AS beta, f AS phi, {r('sse', 'sse')} FROM e QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY sse) = 1""")
def krn_02_grid(spark, sf):
    """The parameters of least squared error on a coarse grid."""
    f = holt.grid_fit(holt.training_arrays(series.monthly_segments(spark, sf)), *GRID)
    return rounded(f.select("series_id", "alpha", "beta", "phi", "sse"))


@query("krn_02_holt_fit")
def krn_02(spark, sf):
    """Fitted parameters and the squared error, which is never above the start's."""
    f = holt.fit(holt.training_arrays(series.monthly_segments(spark, sf)))
    return f.select("series_id", "alpha", "beta", "phi", F.col("state.sse").alias("sse"), holt.smooth(F.col("y"), *holt.DEFAULT)["sse"].alias("sse_start"))


@query("entry_m5_backtest", f"""{_HOLT}, {_errors_sql('ha', 'er')} SELECT series_id, {r('avg(mae)', 'mae', 3)}, {r('avg(smape)', 'smape')}, {r('avg(mase)', 'mase')}, {r('avg(coverage)', 'coverage')} FROM er GROUP BY 1""")
def flagship(spark, sf):
    """One row a segment: mean error and coverage over the cutoffs."""
    train, after = _split(spark, sf)
    e = backtest.errors(backtest.holt_forecasts(train, H, 0.95), after, train)
    g = e.groupBy("series_id").agg(F.round(F.avg("mae"), 3).alias("mae"), F.avg("smape").alias("smape"), F.avg("mase").alias("mase"), F.avg("coverage").alias("coverage"))
    return rounded(g)

