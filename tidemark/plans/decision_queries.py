"""Queries on the choice of an engine: tournaments, rules, their stability, and studies of them.

They all rest on the evidence of two engines with fixed parameters at 24 cutoffs of five
monthly series; the SQL repeats the filter as one recursive query.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.operators import backtest, decisions, evidence, tournament, vintage
from tidemark.sources import series
from tidemark.sources.shared import settled

from .base import M1, M5, r, rounded

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


H, K, M = 6, 24, 12
Z80 = "1.2815515655446004"
_ENG = "eng(engine, a, b, f) AS (VALUES " + ", ".join(f"('{k}', {p[0]}::DOUBLE, {p[1]}::DOUBLE, {p[2]}::DOUBLE)" for k, p in evidence.ENGINES.items()) + ")"


def _grid(k: int = K, recent: int | None = None, name: str = "cut") -> str:
    first = "29" if recent is None else f"greatest(29, n - {H} - 1 - {recent})"
    return f"{name} AS (SELECT DISTINCT series_id, CAST(round_even({first} + i * (n - {H} - 1 - {first}) / {max(1, k - 1)}.0::DOUBLE, 0) AS INT) AS place FROM nn, range(0, {k}) g(i) WHERE n - {H} - 1 >= 29)"


_X = f"""WITH RECURSIVE {M5}, x AS (SELECT series_id, ts, value, ln(value) AS y, CAST(row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS INT) AS place FROM m5),
 nn AS (SELECT series_id, CAST(count(*) AS INT) AS n FROM x GROUP BY 1), {_ENG},
 fl AS (SELECT x.series_id, engine, 0 AS place, x.y AS l, x1.y - x.y AS tr, 0::DOUBLE AS sse FROM x JOIN x x1 ON x1.series_id = x.series_id AND x1.place = 1, eng WHERE x.place = 0
  UNION ALL SELECT fl.series_id, fl.engine, x.place, l + f * tr + a * (y - l - f * tr), f * tr + a * b * (y - l - f * tr), sse + pow(y - l - f * tr, 2)
  FROM fl JOIN x ON x.series_id = fl.series_id AND x.place = fl.place + 1 JOIN eng ON eng.engine = fl.engine)"""
_ST = f"""sc AS (SELECT c.series_id, c.place, avg(d1) AS scale, avg(dm) AS season_scale, max(mv) AS move FROM cut c JOIN (SELECT series_id, place, abs(value - lag(value) OVER w) AS d1, abs(value - lag(value, {M}) OVER w) AS dm, abs(y - lag(y, {H}) OVER w) AS mv FROM x WINDOW w AS (PARTITION BY series_id ORDER BY place)) d ON d.series_id = c.series_id AND d.place <= c.place GROUP BY ALL),
 st0 AS (SELECT c.series_id, c.place, c.ts AS cutoff, c.value AS last, engine, CAST(h AS INT) AS h, t.ts, t.value AS actual, s.value AS snaive, c.value AS rw, a, b, f, l, tr, sse / c.place AS s2, f * (1 - pow(f, h)) / (1 - f) AS damp
  FROM cut JOIN x c USING (series_id, place) JOIN fl USING (series_id, place) JOIN eng USING (engine), range(1, {H + 1}) g(h) JOIN x t ON t.series_id = cut.series_id AND t.place = cut.place + h JOIN x s ON s.series_id = cut.series_id AND s.place = cut.place - {M} + 1 + (h - 1) % {M}),
 st1 AS (SELECT *, l + damp * tr AS mu, s2 * (1 + coalesce((SELECT sum(pow(a + a * b * f * (1 - pow(f, j)) / (1 - f), 2)) FROM range(1, h) q(j)), 0)) AS var FROM st0),
 st AS (SELECT *, sqrt(var) AS se, exp(mu + var / 2) AS value, exp(mu - {Z80} * sqrt(var)) AS lower, exp(mu + {Z80} * sqrt(var)) AS upper FROM st1)"""
_PR = """pr AS (SELECT series_id, place, cutoff, avg(abs(actual - value)) FILTER (engine = 'base') AS base, avg(abs(actual - value)) FILTER (engine = 'challenger') AS challenger,
  avg(CASE WHEN actual BETWEEN lower AND upper THEN 100.0 ELSE 0 END) FILTER (engine = 'base') AS base_cov, avg(CASE WHEN actual BETWEEN lower AND upper THEN 100.0 ELSE 0 END) FILTER (engine = 'challenger') AS challenger_cov,
  avg(abs(actual - rw)) FILTER (engine = 'base') AS rw, avg(abs(actual - snaive)) FILTER (engine = 'base') AS snaive FROM st GROUP BY ALL)"""
_H2H = """count(*) AS n, count(*) FILTER (challenger < base) AS wins, count(*) FILTER (challenger > base) AS losses, count(*) FILTER (challenger = base) AS ties, avg(base) AS base_mean, avg(challenger) AS challenger_mean, avg(base_cov) AS base_cov, avg(challenger_cov) AS challenger_cov"""
STEPS = f"{_X}, {_grid()}, {_ST}"
PAIRS = f"{STEPS}, {_PR}"
RECENT = f"{_X}, {_grid(8, 40)}, {_ST}, {_PR}"
_ERR = "abs(actual - value)"
_TAIL = "(SELECT sum(factorial(CAST({n} AS INT)) // (factorial(CAST(q AS INT)) * factorial(CAST({n} - q AS INT)))) FROM range({w}, {n} + 1) g(q))::DOUBLE / pow(2, {n})"


def _p(w: str, lo: str) -> str:
    return f"CASE WHEN {w} + {lo} > 0 THEN {_TAIL.format(n=f'({w} + {lo})', w=w)} ELSE 1 END"


def _steps(spark, sf, **parameters) -> DataFrame:
    return evidence.steps(evidence.walk(series.monthly_segments(spark, sf), **({"k": K, "horizon": H, "m": M} | parameters)), H, 0.8, M)


def _pairs(spark, sf, **parameters) -> DataFrame:
    return evidence.pairs(_steps(spark, sf, **parameters))


_COLUMNS = ("base", "challenger", "base_cov", "challenger_cov", "rw", "snaive")


@query("krn_13_tournament", f"{RECENT} SELECT series_id, cutoff, {', '.join(r(c, c, 3) for c in _COLUMNS)} FROM pr")
def krn_13(spark, sf):
    """Two engines and both naive forecasts at eight recent cutoffs, 80 percent bands."""
    return rounded(_pairs(spark, sf, k=8, recent=40).drop("place"), 3)


def _robust_sql(alpha: str = "NULL::DOUBLE", margin: str = "0.1::DOUBLE", incumbent: str = "incumbent", least: str = "7", guard: str = "FALSE", h: str = "") -> str:
    """The robust rule as one expression; `alpha` null means a plain majority."""
    p_to, p_away = _p(f"{h}wins", f"{h}losses"), _p(f"{h}losses", f"{h}wins")
    ok = f"(NOT {guard} OR base_cov - challenger_cov <= 30)"
    to = f"(CASE WHEN {alpha} IS NULL THEN wins > losses ELSE {p_to} < {alpha} END AND challenger_mean <= (1 - CASE WHEN {incumbent} IS NULL THEN {margin} ELSE {margin} * 2 END) * base_mean AND {ok})"
    away = f"((CASE WHEN {alpha} IS NULL THEN losses > wins ELSE {p_away} < {alpha} END AND base_mean <= (1 - {margin} * 2) * challenger_mean) OR NOT {ok})"
    return f"CASE WHEN n >= {least} AND base_mean <> 0 AND (CASE WHEN coalesce({incumbent} = 'challenger', FALSE) THEN NOT {away} ELSE {to} END) THEN 'challenger' ELSE 'base' END"


_INCUMBENTS = "inc(incumbent) AS (VALUES (NULL::VARCHAR), ('base'), ('challenger'))"


@query("krn_14_hysteresis", f"""{PAIRS}, h AS (SELECT series_id, {_H2H} FROM pr GROUP BY 1), {_INCUMBENTS}
 SELECT series_id, coalesce(incumbent, 'none') AS incumbent, n, wins, losses, {r('challenger_mean / base_mean - 1', 'rel_gap')}, {_robust_sql()} AS choice, {_robust_sql('0.05::DOUBLE')} AS choice_by_test, {_robust_sql(margin='0.02::DOUBLE', guard='TRUE')} AS choice_guarded FROM h, inc""")
def krn_14(spark, sf):
    """The robust rule in full: seven pairs, ten percent, double to leave the engine in use; also by sign test, and with the coverage guard."""
    h = evidence.head_to_head(_pairs(spark, sf), "series_id").withColumn("incumbent", F.explode(F.array(F.lit(None).cast("string"), F.lit("base"), F.lit("challenger"))))
    c, i = decisions.columns(*decisions.H2H), F.col("incumbent")
    return rounded(h.select(
        "series_id", F.coalesce(i, F.lit("none")).alias("incumbent"), "n", "wins", "losses", (F.col("challenger_mean") / F.col("base_mean") - 1).alias("rel_gap"),
        decisions.robust(c, i).alias("choice"), decisions.robust(c, i, alpha=0.05).alias("choice_by_test"), decisions.robust(c, i, margin=0.02, guard=True).alias("choice_guarded")))


#: The five segments as they are and with a season laid over them, and one series that rises once.
_MIXED = f"""{M5}, mixed AS (SELECT series_id, ts, value FROM m5 UNION ALL SELECT series_id || ' seasonal', ts, value * (1 + 0.4::DOUBLE * sin(2 * pi() * month(ts) / 12)) FROM m5
  UNION ALL SELECT DISTINCT 'step', ts, CASE WHEN ts >= DATE '1999-01-01' THEN 2.0::DOUBLE ELSE 1 END FROM m5)"""
_HA, _HB, _HF = tournament.HOLT
_WA, _WB, _WG, _WF = tournament.WINTERS
_WE = f"(y - l - {_WF} * tr - s[1])"
_FILTERS = f"""hf AS (SELECT x.series_id, 0 AS place, x.y AS l, x1.y - x.y AS tr, 0::DOUBLE AS sse FROM x JOIN x x1 ON x1.series_id = x.series_id AND x1.place = 1 WHERE x.place = 0
  UNION ALL SELECT x.series_id, x.place, l + {_HF} * tr + {_HA} * (y - l - {_HF} * tr), {_HF} * tr + {_HA} * {_HB} * (y - l - {_HF} * tr), sse + pow(y - l - {_HF} * tr, 2) FROM hf JOIN x ON x.series_id = hf.series_id AND x.place = hf.place + 1),
 wi AS (SELECT series_id, avg(y) FILTER (place < 12) AS m1, avg(y) FILTER (place BETWEEN 12 AND 23) AS m2, list(y ORDER BY place) FILTER (place < 12) AS ys FROM x GROUP BY 1),
 wf AS (SELECT series_id, -1 AS place, m1 AS l, (m2 - m1) / 12 AS tr, list_transform(ys, lambda v: v - m1) AS s, 0::DOUBLE AS sse FROM wi
  UNION ALL SELECT wf.series_id, x.place, l + {_WF} * tr + {_WA} * {_WE}, {_WF} * tr + {_WB} * {_WE}, list_append(s[2:], s[1] + {_WG} * {_WE}), sse + pow({_WE}, 2) FROM wf JOIN x ON x.series_id = wf.series_id AND x.place = wf.place + 1),
 df AS (SELECT series_id, place, y - lag(y) OVER (PARTITION BY series_id ORDER BY place) AS d FROM x QUALIFY d IS NOT NULL),
 dm AS (SELECT c.series_id, c.place AS top, d.place, d.d - avg(d.d) OVER (PARTITION BY c.series_id, c.place) AS e FROM tops c JOIN df d ON d.series_id = c.series_id AND d.place <= c.place),
 ac AS (SELECT a.series_id, a.top, k, sum(a.e * b.e) AS p FROM dm a, range(1, 13) g(k), dm b WHERE b.series_id = a.series_id AND b.top = a.top AND b.place = a.place - k GROUP BY ALL),
 vr AS (SELECT series_id, top, sum(e * e) AS v, count(*) AS nd FROM dm GROUP BY ALL),
 ss AS (SELECT series_id, top, coalesce(bool_and(v > 1e-12) AND max(nd) >= 36 AND max(p / v) FILTER (k = 12) > 1.645 * sqrt((1 + 2 * sum(pow(p / v, 2)) FILTER (k < 12)) / max(nd)), FALSE) AS seasonal FROM vr JOIN ac USING (series_id, top) GROUP BY ALL),
 en AS (SELECT series_id, place, 'holt' AS engine, l, tr, CASE WHEN place > 1 AND sse > 0 THEN sse / place ELSE 1e-4 END AS s2, NULL::DOUBLE[] AS s, {_HA}::DOUBLE AS a, {_HA} * {_HB}::DOUBLE AS b, 0::DOUBLE AS g, {_HF}::DOUBLE AS f FROM hf
  UNION ALL SELECT series_id, place, 'winters', l, tr, CASE WHEN sse > 0 THEN sse / (place + 1) ELSE 1e-4 END, s, {_WA}, {_WB}, {_WG}, {_WF} FROM wf)"""
_PLACED = "x AS (SELECT series_id, ts, value, ln(value) AS y, CAST(row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS INT) AS place FROM mixed), nn AS (SELECT series_id, CAST(count(*) AS INT) AS n FROM x GROUP BY 1)"
_ENGINES = f"""{_PLACED}, {_grid(8)}, tops AS (SELECT series_id, place FROM cut UNION ALL SELECT series_id, n - 1 FROM nn), {_FILTERS},
 bl AS (SELECT series_id, CASE WHEN seasonal THEN 'winters' ELSE 'holt' END AS baseline FROM ss JOIN nn USING (series_id) WHERE top = n - 1),
 fs AS (SELECT en.series_id, en.place, engine, CAST(h AS INT) AS h, t.value AS came, c.value AS last, q.value AS sn, l + tr * f * (1 - pow(f, h)) / (1 - f) + CASE WHEN engine = 'winters' THEN s[CAST((h - 1) % 12 + 1 AS INT)] ELSE 0 END AS mu,
   s2 * (1 + coalesce((SELECT sum(pow(a + b * f * (1 - pow(f, j)) / (1 - f), 2)) FROM range(1, h) g2(j)), 0)) AS var FROM en JOIN cut USING (series_id, place), range(1, {H + 1}) g1(h) JOIN x t ON t.series_id = en.series_id AND t.place = en.place + h JOIN x c ON c.series_id = en.series_id AND c.place = en.place
   JOIN x q ON q.series_id = en.series_id AND q.place = en.place - 12 + 1 + (h - 1) % 12),
 sc AS (SELECT c.series_id, c.place, avg(d1) AS scale, avg(dm) AS season_scale FROM cut c JOIN (SELECT series_id, place, abs(value - lag(value) OVER w) AS d1, abs(value - lag(value, 12) OVER w) AS dm FROM x WINDOW w AS (PARTITION BY series_id ORDER BY place)) d ON d.series_id = c.series_id AND d.place <= c.place GROUP BY ALL),
 er AS (SELECT fs.series_id, place, baseline, baseline = 'winters' AND NOT any_value(seasonal) AS base_skipped, baseline = 'holt' AND place + 1 < 36 AS rival_failed, any_value(CASE WHEN baseline = 'winters' THEN season_scale ELSE scale END) AS unit,
   avg(abs(came - exp(mu + var / 2))) FILTER (engine = baseline) AS base_mae, avg(abs(came - exp(mu + var / 2))) FILTER (engine <> baseline) AS rival_mae,
   100 * avg(CASE WHEN came BETWEEN exp(mu - {Z80} * sqrt(var)) AND exp(mu + {Z80} * sqrt(var)) THEN 1.0 ELSE 0 END) FILTER (engine = baseline) AS base_cov, 100 * avg(CASE WHEN came BETWEEN exp(mu - {Z80} * sqrt(var)) AND exp(mu + {Z80} * sqrt(var)) THEN 1.0 ELSE 0 END) FILTER (engine <> baseline) AS rival_cov,
   avg(abs(came - last)) AS rw, avg(abs(came - sn)) AS snaive FROM fs JOIN bl USING (series_id) JOIN sc USING (series_id, place) JOIN ss ON ss.series_id = fs.series_id AND ss.top = fs.place GROUP BY fs.series_id, place, baseline),
 ev AS (SELECT *, CASE WHEN unit > 0 THEN base_mae / unit END AS base, CASE WHEN unit > 0 THEN rival_mae / unit END AS rival FROM er)"""


def mixed(spark, sf) -> DataFrame:
    m = series.monthly_segments(spark, sf)
    wave = F.col("value") * (1 + 0.4 * F.sin(2 * math.pi * F.month("ts") / 12))
    step = F.when(F.col("ts") >= "1999-01-01", 2.0).otherwise(1.0)
    own = m.withColumn("x", F.explode(F.array(F.struct("series_id", "value"), F.struct(F.concat("series_id", F.lit(" seasonal")).alias("series_id"), wave.alias("value")))))
    return own.select("x.series_id", "ts", "x.value").unionByName(m.select(F.lit("step").alias("series_id"), "ts", step.alias("value")).distinct())


@query("krn_13_engines", f"""WITH RECURSIVE {_MIXED}, {_ENGINES} SELECT series_id, place, baseline, base_skipped, rival_failed, {', '.join(r(c, c, 4) for c in ('base_mae', 'rival_mae', 'base', 'rival', 'base_cov', 'rival_cov', 'rw', 'snaive'))} FROM ev""")
def krn_13_engines(spark, sf):
    """KRN-12, KRN-13: Holt and Holt-Winters at eight cutoffs of each series; which of them is the baseline, where it was skipped, where its rival failed."""
    return rounded(tournament.evidence_rows(mixed(spark, sf), 8, H, M).drop("cutoff"), 4)


@query("krn_13_decided", f"""WITH RECURSIVE {_MIXED}, {_ENGINES}, u AS (SELECT *, bool_or(base IS NULL AND NOT base_skipped) OVER (PARTITION BY series_id) AS undefined FROM ev), v AS (SELECT * REPLACE (CASE WHEN undefined THEN base_mae ELSE base END AS base, CASE WHEN undefined THEN rival_mae ELSE rival END AS rival) FROM u),
 g AS (SELECT series_id, baseline, bool_or(undefined) AS undefined, count(*) AS cutoffs, count(*) FILTER (base_skipped) AS skipped, count(*) FILTER (NOT base_skipped AND rival_failed) AS failed, count(*) FILTER (NOT base_skipped AND NOT rival_failed) AS n,
  count(*) FILTER (NOT base_skipped AND NOT rival_failed AND rival < base) AS wins, count(*) FILTER (NOT base_skipped AND NOT rival_failed AND rival > base) AS losses, avg(base) FILTER (NOT base_skipped AND NOT rival_failed) AS base_mean, avg(rival) FILTER (NOT base_skipped AND NOT rival_failed) AS challenger_mean, avg(base) FILTER (NOT base_skipped) AS alone FROM v GROUP BY ALL)
 SELECT series_id, baseline, CASE WHEN undefined THEN 'mae' WHEN baseline = 'winters' THEN 'mase_seasonal' ELSE 'mase' END AS metric, cutoffs, skipped, failed, n AS pairs, wins, losses, {r('coalesce(base_mean, alone)', 'base_mean', 4)}, {r('challenger_mean', 'rival_mean', 4)},
  CASE WHEN skipped = cutoffs THEN NULL WHEN n >= 7 AND base_mean <> 0 AND wins > losses AND challenger_mean <= 0.9 * base_mean THEN CASE WHEN baseline = 'winters' THEN 'holt' ELSE 'winters' END ELSE baseline END AS engine FROM g""")
def krn_13_decided(spark, sf):
    """The engine of each series: on the scaled error, or the mean absolute one for the whole series where a scale is zero, with skipped and failed cutoffs counted apart."""
    return rounded(tournament.decided(tournament.evidence_rows(mixed(spark, sf), 8, H, M)), 4)


@query("krn_18_plan_b", f"""WITH RECURSIVE {_MIXED}, {_ENGINES}, ch AS (SELECT en.*, n FROM en JOIN nn USING (series_id) JOIN bl ON bl.series_id = en.series_id AND bl.baseline = en.engine WHERE place = n - 1),
 fc AS (SELECT series_id, engine, n, CAST(h AS INT) AS h, l + tr * f * (1 - pow(f, h)) / (1 - f) + CASE WHEN engine = 'winters' THEN s[CAST((h - 1) % 12 + 1 AS INT)] ELSE 0 END AS mu, s2 * (1 + coalesce((SELECT sum(pow(a + b * f * (1 - pow(f, j)) / (1 - f) + CASE WHEN j % 12 = 0 THEN g ELSE 0 END, 2)) FROM range(1, h) g2(j)), 0)) AS var FROM ch, range(1, 15) g1(h))
 SELECT series_id, engine, CASE WHEN engine = 'winters' THEN 'seasonal' ELSE 'not seasonal' END AS reason, n < 30 AS low_confidence, h, {r('exp(mu + var / 2)', 'value', 3)}, {r('exp(mu - 1.959963984540054 * sqrt(var))', 'lower', 3)}, {r('exp(mu + 1.959963984540054 * sqrt(var))', 'upper', 3)} FROM fc""")
def krn_18_plan_b(spark, sf):
    """The second part of KRN-18: Holt-Winters for series with a season, Holt for the others, each with its reason and forecasts."""
    return rounded(tournament.plan_b(mixed(spark, sf), 14, M), 3)


_VINTAGES = f"""{M1}, vs AS (SELECT series_id, ts, value FROM m1 UNION ALL SELECT series_id || ' seasonal', ts, value * (1 + 0.4::DOUBLE * sin(2 * pi() * month(ts) / 12)) FROM m1),
 vv AS (SELECT series_id, ts, CAST(ts + INTERVAL 1 DAY * (30 * k) AS DATE) AS published, value * (1 + k * CAST(0.01 AS DOUBLE) * (month(ts) - 6)) AS value FROM vs, (VALUES (0), (1), (2)) t(k)),
 ve AS (SELECT series_id, ts, arg_min(value, published) AS first_release, arg_max(value, published) AS current, CAST(row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS INT) AS place FROM vv GROUP BY series_id, ts),
 vn AS (SELECT series_id, CAST(count(*) AS INT) AS n FROM ve GROUP BY 1), vc AS (SELECT DISTINCT ve.series_id, CAST(last_day(ts) + INTERVAL 15 DAY AS DATE) AS cutoff FROM ve JOIN vn USING (series_id), range(0, 10) g(i) WHERE n - {H} - 1 >= 36 AND ve.place = CAST(round_even(36 + i * (n - {H} - 1 - 36) / 9.0::DOUBLE, 0) AS INT)),
 vk AS (SELECT vv.series_id, cutoff, ts, arg_max(value, published) AS known FROM vv JOIN vc ON vc.series_id = vv.series_id AND published <= cutoff AND ts <= cutoff GROUP BY ALL), vt AS (SELECT series_id, cutoff, max(ts) AS t FROM vk GROUP BY ALL),
 mixed AS (SELECT series_id || '|' || cutoff || '|known' AS series_id, ts, known AS value FROM vk UNION ALL SELECT vk.series_id || '|' || cutoff || '|revised', ts, current FROM vk JOIN ve USING (series_id, ts) UNION ALL SELECT series_id, ts, current FROM ve),
 {_PLACED}, tops AS (SELECT series_id, n - 1 AS place FROM nn), {_FILTERS},
 vr0 AS (SELECT series_id, cutoff, avg(dv) * 100 AS revision FROM (SELECT series_id, cutoff, abs(current / known - 1) AS dv FROM vk JOIN ve USING (series_id, ts) QUALIFY row_number() OVER (PARTITION BY series_id, cutoff ORDER BY ts DESC) <= 60) GROUP BY ALL),
 vf AS (SELECT vt.series_id, vt.cutoff, t, dt AS data, engine, own, whole, CASE WHEN whole THEN 2 ELSE 1 END AS k, n, l, tr, s2, s, a, b, g, f FROM (SELECT vt.*, dt, vt.series_id || '|' || cutoff || '|' || dt AS own, ss.seasonal AS whole FROM vt JOIN ss ON ss.series_id = vt.series_id, (VALUES ('known'), ('revised')) q(dt)) vt
  JOIN nn ON nn.series_id = own JOIN en ON en.series_id = own AND en.place = n - 1 JOIN ss sw ON sw.series_id = own WHERE engine = 'holt' OR (whole AND sw.seasonal AND n >= 24)),
 vu AS (SELECT * FROM vf QUALIFY count(*) OVER (PARTITION BY own) = k),
 vx AS (SELECT vu.*, CAST(h AS INT) AS h, fu.first_release, fu.current, la.value AS last, se.value AS sn,
   exp(l + tr * f * (1 - pow(f, h)) / (1 - f) + CASE WHEN engine = 'winters' THEN s[CAST((h - 1) % 12 + 1 AS INT)] ELSE 0 END + s2 * (1 + coalesce((SELECT sum(pow(a + b * f * (1 - pow(f, j)) / (1 - f), 2)) FROM range(1, h) g2(j)), 0)) / 2) AS value
  FROM vu, range(1, {H + 1}) g1(h) JOIN ve te ON te.series_id = vu.series_id AND te.ts = vu.t JOIN vn ON vn.series_id = vu.series_id AND te.place + {H} < vn.n JOIN ve fu ON fu.series_id = vu.series_id AND fu.place = te.place + h JOIN x la ON la.series_id = own AND la.place = vu.n - 1 JOIN x se ON se.series_id = own AND se.place = vu.n - 12 + (h - 1) % 12),
 vm AS (SELECT series_id, cutoff, data, truth, engine, whole, k, avg(abs(value - tr0)) AS mae, avg(abs(last - tr0)) AS rw, avg(abs(sn - tr0)) AS sn FROM (SELECT *, CASE WHEN truth = 'first' THEN first_release ELSE current END AS tr0 FROM vx, (VALUES ('first'), ('current')) q(truth)) GROUP BY ALL),
 vq AS (SELECT *, CASE WHEN naive = 'seasonal' THEN sn ELSE rw END AS ref FROM (SELECT *, CASE WHEN whole AND sum(sn) OVER w < sum(rw) OVER w THEN 'seasonal' ELSE 'random_walk' END AS naive FROM vm JOIN vr0 USING (series_id, cutoff) WINDOW w AS (PARTITION BY series_id, data, truth, engine))),
 vg AS (SELECT series_id, data, truth, engine, naive, k, count(*) AS n, count(*) FILTER (mae < ref) AS wins, count(*) FILTER (mae > ref) AS losses, 1 - sum(mae) / sum(ref) AS skill, avg(revision) AS revision FROM vq GROUP BY ALL),
 vb AS (SELECT *, {_p('wins', 'losses')} AS p FROM vg), cp AS (SELECT *, p < 0.05::DOUBLE / k AND skill > 0 AS beats FROM vb)"""


def _versions(spark, sf) -> DataFrame:
    """Monthly orders, as they are and with a season, published on their date and revised by up to some percent 30 and 60 days later."""
    m = series.monthly_orders(spark, sf)
    wave = F.col("value") * (1 + 0.4 * F.sin(2 * math.pi * F.month("ts") / 12))
    own = m.withColumn("x", F.explode(F.array(F.struct("series_id", "value"), F.struct(F.concat("series_id", F.lit(" seasonal")).alias("series_id"), wave.alias("value"))))).select("x.series_id", "ts", "x.value")
    return own.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select("series_id", "ts", F.expr("date_add(ts, 30 * k)").alias("published"), (F.col("value") * (1 + F.col("k") * 0.01 * (F.month("ts") - 6))).alias("value"))


@query("krn_40_capability", f"WITH RECURSIVE {_VINTAGES} SELECT series_id, data, truth, engine, naive, n, wins, losses, {r('p', 'p')}, {r('skill', 'skill', 5)}, {r('revision', 'revision', 5)}, beats FROM cp")
def krn_40_capability(spark, sf):
    """KRN-40, KRN-20: Holt and Holt-Winters on data as known or as revised, against first releases or today's values: which of the four has an engine that beats the naive forecast."""
    v = settled(_versions(spark, sf))
    c = vintage.capability(vintage.replayed(v, vintage.monthly_cutoffs(v, 10, H), H, M)).drop("k")
    return c.select("series_id", "data", "truth", "engine", "naive", "n", "wins", "losses", (F.round("p", 6) + F.lit(0.0)).alias("p"), *[(F.round(x, 5) + F.lit(0.0)).alias(x) for x in ("skill", "revision")], "beats")


def _cell(d: str, t: str) -> str:
    return f"coalesce(bool_or(beats) FILTER (data = '{d}' AND truth = '{t}'), FALSE)"


@query("krn_40_verdicts", f"""WITH RECURSIVE {_VINTAGES}, g AS (SELECT series_id, max(n) FILTER (data = 'known' AND truth = 'first') AS cutoffs, max(revision) FILTER (data = 'known' AND truth = 'first') AS revision, {', '.join(f"{_cell(d, t)} AS {d}_{t}" for d in ('known', 'revised') for t in ('first', 'current'))} FROM cp GROUP BY 1)
 SELECT * REPLACE ({r('revision', 'revision', 5).replace(' AS revision', '')} AS revision), CASE WHEN revised_current AND NOT known_first THEN 'lost' WHEN known_first AND NOT revised_current THEN 'real time only' WHEN revised_current THEN 'kept' ELSE 'none' END AS verdict FROM g""")
def krn_40_verdicts(spark, sf):
    """Whether an engine's capability with today's data was there with the data of the time."""
    v = settled(_versions(spark, sf))
    return rounded(vintage.verdicts(vintage.capability(vintage.replayed(v, vintage.monthly_cutoffs(v, 10, H), H, M))), 5)


_BY_MEAN = "CASE WHEN challenger < base AND base_cov - challenger_cov <= {gap} THEN 'challenger' ELSE 'base' END"


@query("krn_15_coverage_guard", f"""{PAIRS}, h AS (SELECT series_id, avg(base) AS base, avg(challenger) AS challenger, avg(base_cov) AS base_cov, avg(challenger_cov) AS challenger_cov FROM pr GROUP BY 1)
 SELECT series_id, {r('base_cov - challenger_cov', 'gap')}, {_BY_MEAN.format(gap=30)} AS choice, {_BY_MEAN.format(gap=1)} AS choice_strict FROM h""")
def krn_15(spark, sf):
    """The mean rule with its guard of 30 points of coverage, and with one of 1 point."""
    h = evidence.head_to_head(_pairs(spark, sf), "series_id")
    c = [F.col(n) for n in ("base_mean", "challenger_mean", "base_cov", "challenger_cov")]
    return rounded(h.select("series_id", (c[2] - c[3]).alias("gap"), decisions.by_mean(*c).alias("choice"), decisions.by_mean(*c, gap=1.0).alias("choice_strict")))


def _skill_sql(name: str, both: bool = True, choice: str = "ch") -> str:
    strict = "CASE WHEN sum(snaive) < sum(rw) THEN 'seasonal' ELSE 'random_walk' END" if both else "'random_walk'"
    return f"""{name}x AS (SELECT pr.*, CASE WHEN choice = 'challenger' THEN challenger ELSE base END AS model FROM pr JOIN {choice} USING (series_id)), {name}n AS (SELECT series_id, {strict} AS naive FROM {name}x GROUP BY 1),
 {name}g AS (SELECT series_id, naive, count(*) AS n, count(*) FILTER (model < rival) AS wins, count(*) FILTER (model > rival) AS losses, avg(model) AS model_mean, avg(rival) AS naive_mean FROM (SELECT *, CASE WHEN naive = 'seasonal' THEN snaive ELSE rw END AS rival FROM {name}x JOIN {name}n USING (series_id)) GROUP BY ALL),
 {name} AS (SELECT *, CASE WHEN n < 7 THEN 'not_evaluated' WHEN wins > losses AND naive_mean > 0 AND model_mean <= 0.9 * naive_mean THEN 'adds' ELSE 'adds_nothing' END AS state FROM {name}g)"""


_CHOICE = f"h AS (SELECT series_id, {_H2H} FROM pr GROUP BY 1), ch AS (SELECT series_id, {_robust_sql(incumbent='NULL::VARCHAR')} AS choice FROM h)"


def _chosen(paired):
    h = evidence.head_to_head(paired, "series_id")
    return h.select("series_id", decisions.robust(decisions.columns(*decisions.H2H), F.lit(None).cast("string")).alias("choice"))


@query("krn_19_skill", f"{PAIRS}, {_CHOICE}, {_skill_sql('sk')} SELECT series_id, naive, n, wins, losses, {r('model_mean', 'model_mean', 3)}, {r('naive_mean', 'naive_mean', 3)}, state FROM sk")
def krn_19(spark, sf):
    """Whether the chosen engine adds to the stricter naive forecast."""
    p = settled(_pairs(spark, sf))
    return rounded(decisions.skill(p, _chosen(p)), 3)


@query("krn_47_old_and_new_skill", f"{PAIRS}, {_CHOICE}, {_skill_sql('od', False)}, {_skill_sql('nw')} SELECT series_id, od.state AS old_state, nw.state AS new_state, nw.naive, nw.state = 'adds' AND od.losses > od.wins AS blocked FROM od JOIN nw USING (series_id)")
def krn_47(spark, sf):
    """The verdict against the random walk and against the stricter naive forecast; one that adds but loses most pairs to the other is blocked."""
    p = settled(_pairs(spark, sf))
    c = _chosen(p)
    old = decisions.skill(p, c, both=False).select("series_id", F.col("state").alias("old_state"), (F.col("losses") > F.col("wins")).alias("lost"))
    new = decisions.skill(p, c).select("series_id", F.col("state").alias("new_state"), "naive")
    return old.join(new, "series_id").select("series_id", "old_state", "new_state", "naive", ((F.col("new_state") == "adds") & F.col("lost")).alias("blocked"))


_CAP = f"""e AS (SELECT series_id, place, engine, avg({_ERR}) AS mae, avg(abs(actual - rw)) AS rw, avg(abs(actual - snaive)) AS sn, avg(CASE WHEN actual BETWEEN lower AND upper THEN 100.0 ELSE 0 END) AS cov FROM st GROUP BY ALL),
 ref AS (SELECT series_id, CASE WHEN sum(sn) < sum(rw) THEN 'seasonal' ELSE 'random_walk' END AS naive FROM e WHERE engine = 'base' GROUP BY 1), k AS (SELECT *, CASE WHEN naive = 'seasonal' THEN sn ELSE rw END AS ref FROM e JOIN ref USING (series_id)),
 g AS (SELECT series_id, engine, naive, count(*) FILTER (mae < ref) AS wins, count(*) FILTER (mae > ref) AS losses, 1 - sum(mae) / sum(ref) AS skill, avg(cov) AS coverage FROM k GROUP BY ALL), cap AS (SELECT *, {_p('wins', 'losses')} AS p FROM g)"""


def _capability(stepped):
    inside = F.avg(F.col("actual").between(F.col("lower"), F.col("upper")).cast("double") * 100)
    e = stepped.groupBy("series_id", "place", "engine").agg(
        F.avg(F.abs(F.col("actual") - F.col("value"))).alias("mae"), F.avg(F.abs(F.col("actual") - F.col("rw"))).alias("rw"),
        F.avg(F.abs(F.col("actual") - F.col("snaive"))).alias("sn"), inside.alias("cov"))
    ref = e.where("engine = 'base'").groupBy("series_id").agg(F.when(F.sum("sn") < F.sum("rw"), "seasonal").otherwise("random_walk").alias("naive"))
    k = e.join(ref, "series_id").withColumn("ref", F.when(F.col("naive") == "seasonal", F.col("sn")).otherwise(F.col("rw")))
    g = k.groupBy("series_id", "engine", "naive").agg(
        F.count_if(F.col("mae") < F.col("ref")).alias("wins"), F.count_if(F.col("mae") > F.col("ref")).alias("losses"),
        (1 - F.sum("mae") / F.sum("ref")).alias("skill"), F.avg("cov").alias("coverage"))
    return g.withColumn("p", decisions.sign_p(F.col("wins"), F.col("losses")))


@query("krn_20_capability", f"{STEPS}, {_CAP} SELECT series_id, engine, naive, wins, losses, {r('p', 'p')}, {r('skill', 'skill')}, {r('coverage', 'coverage')}, p < 0.05::DOUBLE / 2 AND skill > 0 AS beats FROM cap")
def krn_20(spark, sf):
    """Engines that beat the stricter naive forecast: a sign test under 0.05 by the number of engines (Bonferroni) and a positive skill."""
    c = _capability(settled(_steps(spark, sf)))
    return rounded(c.select("series_id", "engine", "naive", "wins", "losses", "p", "skill", "coverage", ((F.col("p") < 0.05 / 2) & (F.col("skill") > 0)).alias("beats")))


@query("agg_34_category_verdicts", f"""{STEPS}, {_CAP}, s AS (SELECT series_id, bool_or(p < 0.05::DOUBLE / 2 AND skill > 0) AS has, max(skill) AS skill FROM cap GROUP BY 1)
 SELECT CASE WHEN series_id < 'F' THEN 'a' ELSE 'b' END AS category, count(*) AS series, count(*) FILTER (has) AS capable, count(*) FILTER (has) >= 3 AS three, count(*) FILTER (has) > count(*) / 2 AS majority, bool_or(skill < 0) AS any_negative, bool_and(skill > -1) AS none_catastrophic FROM s GROUP BY 1""")
def agg_34(spark, sf):
    """Counts and thresholds of verdicts by category."""
    s = _capability(settled(_steps(spark, sf))).groupBy("series_id").agg(F.bool_or((F.col("p") < 0.05 / 2) & (F.col("skill") > 0)).alias("has"), F.max("skill").alias("skill"))
    n = F.count_if("has")
    return s.groupBy(F.when(F.col("series_id") < "F", "a").otherwise("b").alias("category")).agg(
        F.count("*").alias("series"), n.alias("capable"), (n >= 3).alias("three"), (n > F.count("*") / 2).alias("majority"),
        F.bool_or(F.col("skill") < 0).alias("any_negative"), F.bool_and(F.col("skill") > -1).alias("none_catastrophic"))


_TRIPLES = """nk AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY place) AS i FROM pr),
 tri AS (SELECT a.series_id, a.i AS a, b.i AS b, c.i AS c, (a.base + b.base + c.base) / 3 AS base, (a.challenger + b.challenger + c.challenger) / 3 AS challenger, (a.base_cov + b.base_cov + c.base_cov) / 3 AS base_cov, (a.challenger_cov + b.challenger_cov + c.challenger_cov) / 3 AS challenger_cov
  FROM nk a JOIN nk b ON a.series_id = b.series_id AND a.i < b.i JOIN nk c ON c.series_id = b.series_id AND b.i < c.i),
 ref AS (SELECT series_id, avg(base) AS base, avg(challenger) AS challenger, avg(base_cov) AS base_cov, avg(challenger_cov) AS challenger_cov FROM pr GROUP BY 1)"""
_PICK = _BY_MEAN.format(gap=30)


def _by_mean(prefix: str = ""):
    return decisions.by_mean(*[F.col(prefix + c) for c in ("base", "challenger", "base_cov", "challenger_cov")])


@query("krn_22_triples", f"""{PAIRS}, {_TRIPLES}, t AS (SELECT series_id, {_PICK} AS pick, CASE WHEN challenger < base THEN 'challenger' ELSE 'base' END AS metric_only, challenger / base - 1 AS gap FROM tri), f AS (SELECT series_id, {_PICK} AS pick FROM ref)
 SELECT series_id, count(*) AS subsets, f.pick AS reference, {r('avg(CASE WHEN t.pick <> f.pick THEN 100.0 ELSE 0 END)', 'disagree_pct')}, {r("avg(CASE WHEN t.pick = 'challenger' THEN 100.0 ELSE 0 END)", 'challenger_pct')}, {r('avg(CASE WHEN abs(gap) <= 0.05 THEN 100.0 ELSE 0 END)', 'within_5pct')}, {r('avg(CASE WHEN abs(gap) <= 0.1 THEN 100.0 ELSE 0 END)', 'within_10pct')},
 {r('avg(CASE WHEN t.pick <> metric_only THEN 100.0 ELSE 0 END)', 'guard_changed_pct')} FROM t JOIN f USING (series_id) GROUP BY ALL""")
def krn_22(spark, sf):
    """KRN-22, AGG-29: every three of the 24 cutoffs against all of them; shares of near ties, and of decisions that the guard changed."""
    p = settled(_pairs(spark, sf))
    t = evidence.triples(p).select("series_id", _by_mean().alias("pick"), F.when(F.col("challenger") < F.col("base"), "challenger").otherwise("base").alias("metric_only"), (F.col("challenger") / F.col("base") - 1).alias("gap"))
    f = p.groupBy("series_id").agg(*[F.avg(c).alias(c) for c in ("base", "challenger", "base_cov", "challenger_cov")]).select("series_id", _by_mean().alias("reference"))

    def share(c):
        return F.avg(c.cast("double") * 100)

    return rounded(t.join(f, "series_id").groupBy("series_id", "reference").agg(
        F.count("*").alias("subsets"), share(F.col("pick") != F.col("reference")).alias("disagree_pct"), share(F.col("pick") == "challenger").alias("challenger_pct"),
        share(F.abs("gap") <= 0.05).alias("within_5pct"), share(F.abs("gap") <= 0.1).alias("within_10pct"), share(F.col("pick") != F.col("metric_only")).alias("guard_changed_pct")))


@query("agg_26_regret", f"""{PAIRS}, {_TRIPLES}, q AS (SELECT series_id, count(*) AS n, sum(base) AS sb, sum(challenger) AS sc FROM pr GROUP BY 1),
 t AS (SELECT tri.series_id, {_PICK} AS pick, (sb - 3 * base) / (n - 3) AS eb, (sc - 3 * challenger) / (n - 3) AS ec FROM tri JOIN q USING (series_id)),
 u AS (SELECT CASE WHEN series_id < 'F' THEN 'a' ELSE 'b' END AS category, 100 * least(1, CASE WHEN least(eb, ec) > 0 THEN CASE WHEN pick = 'challenger' THEN ec ELSE eb END / least(eb, ec) - 1 ELSE 0 END) AS regret FROM t)
 SELECT category, count(*) AS n, {r('avg(regret)', 'mean')}, {r('median(regret)', 'median')}, {r('quantile_cont(regret, 0.9)', 'p90')} FROM u GROUP BY 1""")
def agg_26(spark, sf):
    """AGG-26, KRN-21: what each decision on three cutoffs costs on the 21 held out, in percentage points, pooled by category."""
    p = settled(_pairs(spark, sf))
    q = p.groupBy("series_id").agg(F.count("*").alias("all_n"), F.sum("base").alias("sb"), F.sum("challenger").alias("sc"))
    t = evidence.triples(p).join(F.broadcast(q), "series_id")  # one row a series
    eb, ec = (F.col("sb") - 3 * F.col("base")) / (F.col("all_n") - 3), (F.col("sc") - 3 * F.col("challenger")) / (F.col("all_n") - 3)
    t = t.select("series_id", _by_mean().alias("pick"), eb.alias("eb"), ec.alias("ec"))
    best = F.least("eb", "ec")
    regret = 100 * F.least(F.lit(1.0), F.when(best > 0, F.when(F.col("pick") == "challenger", F.col("ec")).otherwise(F.col("eb")) / best - 1).otherwise(0.0))
    t = t.select(F.when(F.col("series_id") < "F", "a").otherwise("b").alias("category"), regret.alias("regret"))
    return rounded(t.groupBy("category").agg(F.count("*").alias("n"), F.avg("regret").alias("mean"), F.median("regret").alias("median"), F.percentile("regret", F.lit(0.9)).alias("p90")))


@query("agg_30_flips", f"""{PAIRS}, nk AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY place) AS i FROM pr), wd AS (SELECT a.series_id, a.i AS pos, {', '.join(f'avg(b.{c}) AS {c}' for c in ('base', 'challenger', 'base_cov', 'challenger_cov'))} FROM nk a JOIN nk b ON a.series_id = b.series_id AND b.i BETWEEN a.i - 7 AND a.i WHERE a.i >= 8 GROUP BY ALL),
 d AS (SELECT series_id, pos, {_PICK} AS pick FROM wd) SELECT series_id, count(*) AS windows, count(*) FILTER (flip) AS flips, count(DISTINCT pick) AS choices FROM (SELECT *, pick <> lag(pick) OVER (PARTITION BY series_id ORDER BY pos) AS flip FROM d) GROUP BY 1""")
def agg_30(spark, sf):
    """AGG-30, WIN-12: how often the decision flips between windows of eight cutoffs, each a cutoff further."""
    w = W.partitionBy("series_id").orderBy("place")
    k = _pairs(spark, sf).withColumn("at", F.row_number().over(w))
    d = k.select("series_id", "place", "at", *[F.avg(c).over(w.rowsBetween(-7, 0)).alias(c) for c in ("base", "challenger", "base_cov", "challenger_cov")]).where("at >= 8")
    d = d.select("series_id", "place", _by_mean().alias("pick"))
    return d.withColumn("flip", F.col("pick") != F.lag("pick").over(w)).groupBy("series_id").agg(
        F.count("*").alias("windows"), F.count_if("flip").alias("flips"), F.count_distinct("pick").alias("choices"))


@query("agg_35_head_to_head", f"{PAIRS} SELECT series_id, {_H2H.replace('avg(base) AS base_mean', r('avg(base)', 'base_mean', 3)).replace('avg(challenger) AS challenger_mean', r('avg(challenger)', 'challenger_mean', 3)).replace('avg(base_cov) AS base_cov', r('avg(base_cov)', 'base_cov', 3)).replace('avg(challenger_cov) AS challenger_cov', r('avg(challenger_cov)', 'challenger_cov', 3))} FROM pr GROUP BY 1")
def agg_35(spark, sf):
    return rounded(evidence.head_to_head(_pairs(spark, sf), "series_id"), 3)


@query("agg_25_runs", f"{STEPS}, e AS (SELECT series_id, place, engine, avg({_ERR}) AS mae FROM st GROUP BY ALL) SELECT engine, {r('avg(mae)', 'mean', 3)}, {r('stddev_pop(mae)', 'sd', 3)}, count(mae) AS n FROM e GROUP BY 1")
def agg_25(spark, sf):
    """Mean, population deviation and number of the errors of all runs of an engine."""
    e = _steps(spark, sf).groupBy("series_id", "place", "engine").agg(F.avg(F.abs(F.col("actual") - F.col("value"))).alias("mae"))
    return rounded(e.groupBy("engine").agg(F.avg("mae").alias("mean"), F.stddev_pop("mae").alias("sd"), F.count("mae").alias("n")), 3)


@query("agg_27_window_spread", f"""{STEPS}, c AS (SELECT engine, cutoff, series_id, avg(CASE WHEN actual BETWEEN lower AND upper THEN 100.0 ELSE 0 END) AS cov FROM st GROUP BY ALL)
 SELECT engine, {r('min(cov)', 'least')}, {r('quantile_cont(cov, 0.1)', 'p10')}, {r('median(cov)', 'median')}, count(*) FILTER (cov < 80) AS below_80, arg_min(series_id || ' ' || cutoff, (cov, series_id || ' ' || cutoff)) AS worst FROM c GROUP BY 1""")
def agg_27(spark, sf):
    """Coverage of each window of forecasts, and its spread over the cutoffs."""
    c = _steps(spark, sf).groupBy("engine", "cutoff", "series_id").agg(F.avg(F.col("actual").between(F.col("lower"), F.col("upper")).cast("double") * 100).alias("cov"))
    name = F.concat_ws(" ", "series_id", F.col("cutoff").cast("string"))
    return rounded(c.groupBy("engine").agg(
        F.min("cov").alias("least"), F.percentile("cov", F.lit(0.1)).alias("p10"), F.median("cov").alias("median"), F.count_if(F.col("cov") < 80).alias("below_80"), F.min_by(name, F.struct("cov", name)).alias("worst")))


@query("agg_28_forecast_errors", f"{STEPS}, z AS (SELECT engine, (ln(actual) - mu) / se AS s FROM st) SELECT engine, count(*) AS n, {r('avg(s)', 'mean')}, {r('stddev_samp(s)', 'sd')}, {r('kurtosis_pop(s)', 'kurtosis', 5)}, {r(f'avg(CASE WHEN abs(s) <= {Z80} THEN 100.0 ELSE 0 END)', 'coverage80')} FROM z GROUP BY 1")
def agg_28(spark, sf):
    """Standardised errors of the forecasts, and the coverage they give."""
    s = _steps(spark, sf).select("engine", ((F.ln("actual") - F.col("mu")) / F.col("se")).alias("s"))
    g = s.groupBy("engine").agg(F.count("*").alias("n"), F.avg("s").alias("mean"), F.stddev_samp("s").alias("sd"), F.kurtosis("s").alias("kurtosis"), F.avg((F.abs("s") <= float(Z80)).cast("double") * 100).alias("coverage80"))
    return rounded(g.withColumn("kurtosis", F.round("kurtosis", 5)))


@query("krn_42_compare_engines", f"""{STEPS} SELECT engine, h, count(*) AS n, {r('avg(CASE WHEN actual BETWEEN lower AND upper THEN 100.0 ELSE 0 END)', 'coverage')}, {r('avg((upper - lower) / value)', 'width')}, {r('100 * avg(abs(actual - value) / abs(actual))', 'mape')} FROM st WHERE h IN (1, 3, 6) GROUP BY ALL""")
def krn_42(spark, sf):
    """Engines on the same cutoffs: coverage, relative width and error by step."""
    e = _steps(spark, sf).where(F.col("h").isin(1, 3, 6))
    return rounded(e.groupBy("engine", "h").agg(
        F.count("*").alias("n"), F.avg(F.col("actual").between(F.col("lower"), F.col("upper")).cast("double") * 100).alias("coverage"),
        F.avg((F.col("upper") - F.col("lower")) / F.col("value")).alias("width"), (100 * F.avg(F.abs(F.col("actual") - F.col("value")) / F.abs("actual"))).alias("mape")))


@query("krn_43_decomposition", f"""{STEPS} SELECT series_id, cutoff, engine, {r('exp(mu)', 'median', 2)}, {r('exp(var / 2)', 'bias_factor')}, {r('damp', 'cum_phi')}, {r(f'exp({Z80} * se)', 'band_factor')}, {r('abs(ln(value / last)) / move', 'explosion', 5)} FROM st JOIN sc USING (series_id, place) WHERE h = {H}""")
def krn_43(spark, sf):
    """The last step's forecast in parts: median, bias factor, summed damping, band, and how far it goes against the largest move."""
    s = _steps(spark, sf).where(F.col("h") == H)
    return rounded(s.select(
        "series_id", "cutoff", "engine", F.round(F.exp("mu"), 2).alias("median"), F.exp(F.col("var") / 2).alias("bias_factor"), F.col("damp").alias("cum_phi"),
        F.exp(float(Z80) * F.col("se")).alias("band_factor"), F.round(F.abs(F.ln(F.col("value") / F.col("last"))) / F.col("move"), 5).alias("explosion")))


@query("krn_44_jump_scan", f"""{STEPS}, j AS (SELECT series_id, ts, y - lag(y) OVER (PARTITION BY series_id ORDER BY ts) AS jump FROM x), tp AS (SELECT * FROM j WHERE jump IS NOT NULL QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY abs(jump) DESC, ts) <= 5)
 SELECT series_id, ts, {r('any_value(jump)', 'jump')}, engine, count(*) AS forecasts, {r('avg(actual / value - 1)', 'miss')}, count(*) FILTER (actual NOT BETWEEN lower AND upper) AS outside FROM tp JOIN st USING (series_id, ts) GROUP BY series_id, ts, engine""")
def krn_44(spark, sf):
    """Forecasts of the months of the five largest jumps of each series against what came."""
    w = W.partitionBy("series_id")
    j = series.monthly_segments(spark, sf).select("series_id", "ts", (F.ln("value") - F.lag(F.ln("value")).over(w.orderBy("ts"))).alias("jump")).where("jump is not null")
    top = j.withColumn("k", F.row_number().over(w.orderBy(F.desc(F.abs("jump")), "ts"))).where("k <= 5").drop("k")
    x = _steps(spark, sf).select("series_id", "ts", "engine", "actual", "value", "lower", "upper").join(top, ["series_id", "ts"])
    return rounded(x.groupBy("series_id", "ts", "engine").agg(
        F.max("jump").alias("jump"), F.count("*").alias("forecasts"), F.avg(F.col("actual") / F.col("value") - 1).alias("miss"), F.count_if(~F.col("actual").between(F.col("lower"), F.col("upper"))).alias("outside")))


@query("krn_46_random_walk_mase", f"{STEPS}, e AS (SELECT series_id, place, avg(abs(actual - rw)) AS rw, avg(abs(actual - snaive)) AS sn FROM st WHERE engine = 'base' GROUP BY ALL) SELECT series_id, count(*) AS n, {r('avg(rw / season_scale)', 'random_walk')}, {r('avg(sn / season_scale)', 'seasonal')} FROM e JOIN sc USING (series_id, place) GROUP BY 1")
def krn_46(spark, sf):
    """Seasonal scaled errors of both naive forecasts at the stored cutoffs."""
    s = _steps(spark, sf).where("engine = 'base'")
    e = s.groupBy("series_id", "place").agg(F.avg(F.abs(F.col("actual") - F.col("rw"))).alias("rw"), F.avg(F.abs(F.col("actual") - F.col("snaive"))).alias("sn"), F.max("season_scale").alias("scale"))
    return rounded(e.groupBy("series_id").agg(F.count("*").alias("n"), F.avg(F.col("rw") / F.col("scale")).alias("random_walk"), F.avg(F.col("sn") / F.col("scale")).alias("seasonal")))


@query("krn_25_benchmark_verdict", f"""{STEPS}, e AS (SELECT series_id, place, engine, avg({_ERR}) / max(season_scale) AS mase FROM st JOIN sc USING (series_id, place) GROUP BY ALL UNION ALL SELECT series_id, place, 'seasonal', avg(abs(actual - snaive)) / max(season_scale) FROM st JOIN sc USING (series_id, place) WHERE engine = 'base' GROUP BY ALL),
 b AS (SELECT series_id, place, mase AS ref FROM e WHERE engine = 'base'), g AS (SELECT series_id, engine, avg(mase) AS mase, count(*) FILTER (mase < ref) AS wins, count(*) FILTER (mase > ref) AS losses FROM e JOIN b USING (series_id, place) GROUP BY ALL),
 w AS (SELECT *, least(1, 2 * ({_p('greatest(wins, losses)', 'least(wins, losses)')})) AS p FROM g QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY mase, engine) = 1)
 SELECT series_id, engine AS best, {r('mase', 'mase')}, wins, losses, {r('p', 'p')}, CASE WHEN engine <> 'base' AND p < 0.05 AND wins > losses THEN engine ELSE 'base' END AS verdict FROM w""")
def krn_25(spark, sf):
    """The engine of least mean seasonal error replaces the base only with a significant two-sided sign test."""
    s = _steps(spark, sf)
    e = s.groupBy("series_id", "place", "engine").agg((F.avg(F.abs(F.col("actual") - F.col("value"))) / F.max("season_scale")).alias("mase"))
    n = s.where("engine = 'base'").groupBy("series_id", "place").agg((F.avg(F.abs(F.col("actual") - F.col("snaive"))) / F.max("season_scale")).alias("mase")).select("series_id", "place", F.lit("seasonal").alias("engine"), "mase")
    every = e.unionByName(n).withColumn("ref", F.max(F.when(F.col("engine") == "base", F.col("mase"))).over(W.partitionBy("series_id", "place")))
    g = every.groupBy("series_id", "engine").agg(F.avg("mase").alias("mase"), F.count_if(F.col("mase") < F.col("ref")).alias("wins"), F.count_if(F.col("mase") > F.col("ref")).alias("losses"))
    g = g.withColumn("rank", F.row_number().over(W.partitionBy("series_id").orderBy("mase", "engine"))).where("rank = 1").withColumn("p", decisions.sign_p_both(F.col("wins"), F.col("losses")))
    wins = (F.col("engine") != "base") & (F.col("p") < 0.05) & (F.col("wins") > F.col("losses"))
    return rounded(g.select("series_id", F.col("engine").alias("best"), "mase", "wins", "losses", "p", F.when(wins, F.col("engine")).otherwise("base").alias("verdict")))


@query("krn_24_horizon_sweep", f"""{STEPS}, pr AS (SELECT hz.h AS horizon, series_id, place, avg(abs(actual - value)) FILTER (engine = 'base') AS base, avg(abs(actual - value)) FILTER (engine = 'challenger') AS challenger, 0 AS base_cov, 0 AS challenger_cov FROM st, (VALUES (1), (3), (6)) hz(h) WHERE st.h <= hz.h GROUP BY ALL),
 h AS (SELECT horizon, series_id, {_H2H} FROM pr GROUP BY ALL) SELECT horizon, series_id, n, wins, losses, {r('base_mean', 'base_mean', 3)}, {r('challenger_mean', 'challenger_mean', 3)}, {_robust_sql(incumbent='NULL::VARCHAR')} AS choice FROM h""")
def krn_24(spark, sf):
    """The decision by horizon: the first step, three, and six."""
    s = _steps(spark, sf).withColumn("horizon", F.explode(F.array(F.lit(1), F.lit(3), F.lit(6)))).where("h <= horizon")
    e = F.abs(F.col("actual") - F.col("value"))
    p = s.groupBy("horizon", "series_id", "place").agg(F.avg(F.when(F.col("engine") == "base", e)).alias("base"), F.avg(F.when(F.col("engine") == "challenger", e)).alias("challenger"), F.lit(0.0).alias("base_cov"), F.lit(0.0).alias("challenger_cov"))
    h = evidence.head_to_head(p, "horizon", "series_id")
    return rounded(h.select("horizon", "series_id", "n", "wins", "losses", "base_mean", "challenger_mean", decisions.robust(decisions.columns(*decisions.H2H), F.lit(None).cast("string")).alias("choice")), 3)


@query("krn_45_options", f"""{STEPS}, {_PR}, df AS (SELECT c.series_id, c.place, d.place AS pos, d.d FROM cut c JOIN (SELECT series_id, place, y - lag(y) OVER (PARTITION BY series_id ORDER BY place) AS d FROM x) d ON d.series_id = c.series_id AND d.place BETWEEN 1 AND c.place),
 md AS (SELECT series_id, place, median(d) AS m FROM df WHERE pos < place GROUP BY ALL), ad AS (SELECT series_id, place, 1.4826 * median(abs(d - m)) AS spread FROM df JOIN md USING (series_id, place) WHERE pos < place GROUP BY ALL), jp AS (SELECT series_id, place, abs(d) / spread > 1.5 AS jumped FROM df JOIN ad USING (series_id, place) WHERE pos = place),
 e AS (SELECT series_id, place, engine, avg({_ERR}) AS mae, avg(CASE WHEN actual BETWEEN lower AND upper THEN 100.0 ELSE 0 END) AS cov, bool_or(h = {H} AND abs(ln(value / last)) / move > 1) AS flag FROM st JOIN sc USING (series_id, place) GROUP BY ALL)
 SELECT engine, jumped, count(*) AS n, {r('avg(mae / least(base, challenger) - 1)', 'regret')}, {r('avg(cov)', 'coverage')}, count(*) FILTER (flag) AS flags FROM e JOIN pr USING (series_id, place) JOIN jp USING (series_id, place) GROUP BY ALL""")
def krn_45(spark, sf):
    """Each option's regret, coverage and explosion flags (here from 1), at cutoffs after a jump (a last step of 1.5 robust deviations) and at the others."""
    s = _steps(spark, sf)
    flag = (F.col("h") == H) & (F.abs(F.ln(F.col("value") / F.col("last"))) / F.col("move") > 1)
    e = s.groupBy("series_id", "place", "engine").agg(
        F.avg(F.abs(F.col("actual") - F.col("value"))).alias("mae"), F.avg(F.col("actual").between(F.col("lower"), F.col("upper")).cast("double") * 100).alias("cov"),
        F.bool_or(flag).alias("flag"), (F.max("jump") > 1.5).alias("jumped"))
    e = e.withColumn("best", F.min("mae").over(W.partitionBy("series_id", "place")))
    return rounded(e.groupBy("engine", "jumped").agg(F.count("*").alias("n"), F.avg(F.col("mae") / F.col("best") - 1).alias("regret"), F.avg("cov").alias("coverage"), F.count_if("flag").alias("flags")))


@query("krn_51_error_by_step", f"{STEPS} SELECT series_id, cutoff, engine, h, {r('actual - value', 'error', 2)}, {r('100 * (actual / value - 1)', 'error_pct', 5)}, actual BETWEEN lower AND upper AS inside FROM st")
def krn_51(spark, sf):
    s = _steps(spark, sf)
    return rounded(s.select("series_id", "cutoff", "engine", "h", F.round(F.col("actual") - F.col("value"), 2).alias("error"), F.round(100 * (F.col("actual") / F.col("value") - 1), 5).alias("error_pct"), F.col("actual").between(F.col("lower"), F.col("upper")).alias("inside")))


WINDOW = 30
_COLD = f"""{_X.split(' fl AS')[0]} {_grid(8)}, cw AS (SELECT cut.series_id, cut.place AS c, x.place - cut.place + {WINDOW - 1} AS k, y FROM cut JOIN x ON x.series_id = cut.series_id AND x.place BETWEEN cut.place - {WINDOW - 1} AND cut.place),
 fw AS (SELECT a.series_id, a.c, engine, 0 AS k, a.y AS l, b.y - a.y AS tr FROM cw a JOIN cw b ON a.series_id = b.series_id AND a.c = b.c AND b.k = 1, eng WHERE a.k = 0
  UNION ALL SELECT fw.series_id, fw.c, fw.engine, cw.k, l + f * tr + a * (y - l - f * tr), f * tr + a * b * (y - l - f * tr) FROM fw JOIN cw ON cw.series_id = fw.series_id AND cw.c = fw.c AND cw.k = fw.k + 1 JOIN eng ON eng.engine = fw.engine)"""


@query("krn_48_sliding_window", f"{_COLD} SELECT fw.series_id, x.ts AS cutoff, engine, {r('l', 'l')}, {r('tr', 'trend')} FROM fw JOIN x ON x.series_id = fw.series_id AND x.place = fw.c WHERE k = {WINDOW - 1}")
def krn_48(spark, sf):
    """Walk-forward with a window of 30 points that slides: the state that each window alone leaves."""
    w = evidence.walk(series.monthly_segments(spark, sf), 8, H, m=M, window=WINDOW)
    return rounded(w.select("series_id", "cutoff", "engine", "l", F.col("b").alias("trend")))


@query("win_13_independent_windows", f"""{_X}, {_grid()}, o AS (SELECT series_id, place, row_number() OVER (PARTITION BY series_id ORDER BY place) AS i FROM cut),
 gr AS (SELECT series_id, i, 1 AS n, place + {H} AS ending FROM o WHERE i = 1 UNION ALL SELECT o.series_id, o.i, n + CASE WHEN place + 1 > ending THEN 1 ELSE 0 END, CASE WHEN place + 1 > ending THEN place + {H} ELSE ending END FROM gr JOIN o ON o.series_id = gr.series_id AND o.i = gr.i + 1) SELECT series_id, max(n) AS independent FROM gr GROUP BY 1""")
def win_13(spark, sf):
    """Greedy number of windows of six steps after the cutoffs that do not overlap: a fold over the sorted places."""
    rows = evidence.arrays(series.monthly_segments(spark, sf)).select("series_id", F.array_sort(evidence.even(F.col("n"), K, H)).alias("at"))
    start = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("ending"))
    count = F.aggregate("at", start, lambda s, p: F.when(p + 1 > s["ending"], F.struct((s["n"] + 1).alias("n"), (p + H).alias("ending"))).otherwise(s))
    return rows.select("series_id", count["n"].alias("independent"))


@query("ord_04_spacings", f"""{_X}, t AS (SELECT series_id, 'three' AS kind, CAST(round_even(30 + i * (n - {H} - 30) / 2.0::DOUBLE, 0) AS INT) - 1 AS place FROM nn, range(0, 3) g(i) WHERE n - {H} > 30 UNION SELECT series_id, 'grid', CAST(round_even(29 + i * (n - 1 - {H} - 29) / 23.0::DOUBLE, 0) AS INT) FROM nn, range(0, 24) g(i) WHERE n - 1 - {H} >= 29)
 SELECT series_id, kind, place, ts AS cutoff FROM t JOIN x USING (series_id, place)""")
def ord_04(spark, sf):
    """ORD-04, ORD-05: the earlier spacing of three cutoffs, and the grid over the whole history."""
    a = evidence.arrays(series.monthly_segments(spark, sf))
    step = (F.col("n") - H - 30) / 2
    three = F.when(F.col("n") - H > 30, F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.bround(30 + i * step).cast("int") - 1))).otherwise(F.array().cast("array<int>"))
    kinds = F.array(F.struct(F.lit("three").alias("kind"), three.alias("places")), F.struct(F.lit("grid").alias("kind"), evidence.even(F.col("n"), K, H).alias("places")))
    x = a.select("series_id", "dates", F.explode(kinds).alias("k")).select("series_id", "dates", F.col("k.kind").alias("kind"), F.explode("k.places").alias("place"))
    return x.select("series_id", "kind", "place", F.expr("element_at(dates, place + 1)").alias("cutoff"))


@query("mth_03_bonferroni", "WITH t AS (SELECT n_name AS name, (n_nationkey + 1) * 0.0007::DOUBLE AS p, count(*) OVER () AS k FROM nation) SELECT name, round(p, 6) + 0.0 AS p, p < 0.05::DOUBLE / k AS passes FROM t")
def mth_03(spark, sf):
    t = series.table(spark, sf, "nation").select(F.col("n_name").alias("name"), ((F.col("n_nationkey") + 1) * 0.0007).alias("p"))
    return rounded(backtest.bonferroni(t))


#: The variants of the rule: 3 x 4 x 3 x 2 x 2 = 144.
_ALPHAS, _MARGINS, _LEASTS, _GUARDS, _ENGAGED = (None, 0.05, 0.2), (0.0, 0.05, 0.1, 0.2), (1, 7, 12), (False, True), (None, "challenger")
SUBSETS = 400


def _values(xs) -> str:
    return ", ".join("(" + ("NULL" if x is None else repr(x).upper() if isinstance(x, bool) else repr(x)) + ")" for x in xs)


_VARIANTS = f"""va AS (SELECT alpha::DOUBLE AS alpha, margin::DOUBLE AS margin, least, guard, incumbent::VARCHAR AS incumbent FROM (VALUES {_values(_ALPHAS)}) a(alpha), (VALUES {_values(_MARGINS)}) b(margin), (VALUES {_values(_LEASTS)}) c(least), (VALUES {_values(_GUARDS)}) d(guard), (VALUES {_values(_ENGAGED)}) e(incumbent))"""


def variants(spark) -> DataFrame:
    """The 144 variants of the rule, each parameter's values exploded over the others'."""
    def each(xs, kind):
        return F.explode(F.array(*[F.lit(x).cast(kind) for x in xs]))

    return (spark.range(1).select(each(_ALPHAS, "double").alias("alpha")).select("*", each(_MARGINS, "double").alias("margin")).select("*", each(_LEASTS, "int").alias("least"))
            .select("*", each(_GUARDS, "boolean").alias("guard")).select("*", each(_ENGAGED, "string").alias("incumbent")))


@query("join_12_variants", f"WITH {_VARIANTS} SELECT c_mktsegment AS series_id, alpha, margin, CAST(least AS INT) AS least, guard, incumbent FROM va, (SELECT DISTINCT c_mktsegment FROM customer)")
def join_12(spark, sf):
    """The grid of all 144 variants for every series."""
    segments = series.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("series_id")).distinct()
    return segments.join(F.broadcast(variants(spark)))  # a row a variant


_DRAWN = f"""dr AS (SELECT s, pr.* FROM pr, range(0, {SUBSETS}) g(s) QUALIFY row_number() OVER (PARTITION BY s, series_id ORDER BY md5(s || '-' || series_id || '-' || place)) <= 8),
 hs AS (SELECT s, series_id, {_H2H} FROM dr GROUP BY ALL), hf AS (SELECT series_id, {_H2H} FROM pr GROUP BY ALL)"""


@query("krn_23_variant_sweep", f"""{PAIRS}, {_VARIANTS}, {_DRAWN}, ps AS (SELECT *, {_p('wins', 'losses')} AS p_to, {_p('losses', 'wins')} AS p_away FROM hs), pf AS (SELECT *, {_p('wins', 'losses')} AS p_to, {_p('losses', 'wins')} AS p_away FROM hf),
 a AS (SELECT alpha, margin, least, guard, incumbent, s, series_id, CHOICE AS pick FROM ps, va), b AS (SELECT alpha, margin, least, guard, incumbent, series_id, CHOICE AS pick FROM pf, va)
 SELECT a.alpha, a.margin, CAST(a.least AS INT) AS least, a.guard, a.incumbent, count(*) AS decisions, {r("avg(CASE WHEN a.pick = 'challenger' THEN 100.0 ELSE 0 END)", 'challenger_pct')}, {r('avg(CASE WHEN a.pick <> b.pick THEN 100.0 ELSE 0 END)', 'disagree_pct')}
 FROM a JOIN b ON a.series_id = b.series_id AND a.alpha IS NOT DISTINCT FROM b.alpha AND a.margin = b.margin AND a.least = b.least AND a.guard = b.guard AND a.incumbent IS NOT DISTINCT FROM b.incumbent GROUP BY ALL""".replace(
     "CHOICE", _robust_sql("alpha", "margin", "incumbent", "least", "guard").replace(_p("wins", "losses"), "p_to").replace(_p("losses", "wins"), "p_away")))
def krn_23(spark, sf):
    """All variants on 400 hash-drawn subsets of eight cutoffs: how often they choose the challenger, and otherwise than on all cutoffs."""
    p = settled(_pairs(spark, sf))
    draw = F.md5(F.concat_ws("-", F.col("s").cast("string"), "series_id", F.col("place").cast("string")).cast("binary"))
    d = p.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SUBSETS - 1)))).withColumn("k", F.row_number().over(W.partitionBy("s", "series_id").orderBy(draw))).where("k <= 8")
    v = F.broadcast(variants(spark))  # 144 rows
    choice = decisions.robust(decisions.columns(*decisions.H2H), F.col("incumbent"), F.col("margin"), F.col("least"), F.col("alpha"), F.col("guard")).alias("pick")
    names = ["alpha", "margin", "least", "guard", "incumbent"]
    a = evidence.head_to_head(d, "s", "series_id").join(v).select("s", "series_id", *names, choice)
    b = evidence.head_to_head(p, "series_id").join(v).select("series_id", *names, choice).withColumnRenamed("pick", "reference")
    same = [a[n].eqNullSafe(b[n]) for n in ("series_id", *names)]
    x = a.join(b, same).select(*[a[n] for n in names], "pick", "reference")
    return rounded(x.groupBy(*names).agg(F.count("*").alias("decisions"), F.avg((F.col("pick") == "challenger").cast("double") * 100).alias("challenger_pct"), F.avg((F.col("pick") != F.col("reference")).cast("double") * 100).alias("disagree_pct")))
