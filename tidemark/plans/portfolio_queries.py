"""Queries on correlation, portfolios, risk and rebalancing."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.operators import align, books, holt, portfolio, rebalance, returns, risk
from tidemark.sources import series
from tidemark.sources.shared import settled

from .base import C3, D3, r, rounded

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _returns(spark, sf):
    return returns.log_returns(align.common_dates(series.daily_flags(spark, sf)))


def _weights(spark):
    return spark.createDataFrame([("A", 0.5), ("N", 0.3), ("R", 0.2)], "series_id string, w double")


_W = "w(series_id, w) AS (VALUES ('A', 0.5::DOUBLE), ('N', 0.3::DOUBLE), ('R', 0.2::DOUBLE))"
_PAIR = C3 + ", pr AS (SELECT a.series_id AS i, b.series_id AS j, a.ts, a.r AS x, b.r AS y FROM ret a JOIN ret b ON a.ts = b.ts AND a.series_id <= b.series_id)"
_COV = _PAIR + ", s AS (SELECT i, j, covar_samp(x, y) AS s, count(*) AS n FROM pr GROUP BY ALL)"
_LW = _COV + """, mm AS (SELECT series_id, avg(r) AS m FROM ret GROUP BY 1), pq AS (SELECT i, j, avg(pow((x - a.m) * (y - b.m) - s, 2)) AS pi FROM pr JOIN s USING (i, j) JOIN mm a ON a.series_id = i JOIN mm b ON b.series_id = j GROUP BY ALL),
 tg AS (SELECT avg(s) AS target FROM s WHERE i = j), ii AS (SELECT CASE WHEN sum(k * o * o) < 1e-12 THEN 0 ELSE greatest(0, least(1, sum(k * pi) / max(n) / sum(k * o * o))) END AS intensity FROM
  (SELECT CASE WHEN i = j THEN 1 ELSE 2 END AS k, s - CASE WHEN i = j THEN target ELSE 0 END AS o, pi, n FROM s JOIN pq USING (i, j), tg)),
 lw AS (SELECT i, j, s, intensity, ((1 - intensity) * s + CASE WHEN i = j THEN intensity * target ELSE 0 END) * 252 AS annual FROM s, tg, ii)"""


@query("agg_13_correlations", "WITH " + _PAIR + f""", p AS (SELECT i, j, corr(x, y) AS pearson, count(*) AS n FROM pr GROUP BY ALL), k AS (SELECT series_id, ts, rank() OVER (PARTITION BY series_id ORDER BY r) + (count(*) OVER (PARTITION BY series_id, r) - 1) / 2.0 AS r FROM ret),
 q AS (SELECT a.series_id AS i, b.series_id AS j, corr(a.r, b.r) AS spearman FROM k a JOIN k b ON a.ts = b.ts AND a.series_id <= b.series_id GROUP BY ALL)
 SELECT i, j, {r('CASE WHEN i = j THEN 1 ELSE pearson END', 'pearson')}, n, {r('CASE WHEN i = j THEN 1 ELSE spearman END', 'spearman')} FROM p JOIN q USING (i, j)""")
def agg_13(spark, sf):
    """WIN-10 and the coefficients of AGG-13 to AGG-15; agg_13_p_values has their p-values."""
    return rounded(portfolio.correlations(_returns(spark, sf)))


@query("agg_11_covariance", f"WITH {_COV} SELECT i, j, {r('s', 's', 9)}, n FROM s")
def agg_11(spark, sf):
    return rounded(portfolio.covariance(_returns(spark, sf)), 9)


@query("agg_12_shrinkage", f"WITH {_LW} SELECT i, j, {r('s', 's')}, {r('intensity', 'intensity')}, {r('annual', 'annual')} FROM lw")
def agg_12(spark, sf):
    return rounded(portfolio.shrunk_covariance(_returns(spark, sf)))


@query("mth_05_expected_returns", f"""WITH {C3}, g AS (SELECT series_id, avg(r) * 252 AS mu, var_samp(r) * 252 AS v, count(*) AS t FROM ret GROUP BY 1), e AS (SELECT avg(mu) AS centre, sum(v) AS trace, count(*) AS k, max(t) AS t FROM g),
 q AS (SELECT sum(pow(mu - centre, 2)) AS spread FROM g, e), z AS (SELECT centre, CASE WHEN k <= 2 OR spread <= 1e-8 THEN 0.2 ELSE greatest(0, least(1, (k - 2) * trace / (k * t) / spread)) END AS weight FROM e, q)
 SELECT series_id, {r('mu', 'mu')}, {r('weight', 'weight')}, {r('(1 - weight) * mu + weight * centre', 'shrunk')} FROM g, z""")
def mth_05(spark, sf):
    """Shrunk expected returns; krn_29_forecast_returns has those that forecasts imply."""
    return rounded(portfolio.expected_returns(_returns(spark, sf)))


@query("krn_28_metrics", f"""WITH {C3}, {_W}, d AS (SELECT ts, sum(w * r) AS r FROM ret JOIN w USING (series_id) GROUP BY 1), c AS (SELECT ts, exp(sum(r) OVER (ORDER BY ts)) AS c FROM d), m AS (SELECT min(dd) AS max_drawdown FROM (SELECT c / max(c) OVER (ORDER BY ts) - 1 AS dd FROM c)),
 p AS (SELECT sum(w * sd) AS parts FROM (SELECT series_id, stddev_samp(r) * sqrt(252) AS sd FROM ret GROUP BY 1) JOIN w USING (series_id)), t AS (SELECT avg(r) * 252 AS annual_return, stddev_samp(r) * sqrt(252) AS volatility FROM d)
 SELECT {r('annual_return', 'annual_return')}, {r('volatility', 'volatility')}, {r('(annual_return - 0.04) / volatility', 'sharpe')}, {r('max_drawdown', 'max_drawdown')}, {r('parts / volatility', 'diversification')} FROM t, m, p""")
def krn_28(spark, sf):
    return rounded(portfolio.metrics(_returns(spark, sf), _weights(spark)))


@query("krn_28_contributions", f"""WITH {_LW}, {_W}, f AS (SELECT i, j, annual FROM lw UNION ALL SELECT j, i, annual FROM lw WHERE i < j), g AS (SELECT i, sum(a.w * b.w * annual) AS part FROM f JOIN w a ON a.series_id = i JOIN w b ON b.series_id = j GROUP BY 1)
 SELECT i AS series_id, {r('part', 'part')}, {r('part / sum(part) OVER ()', 'share')} FROM g""")
def krn_28c(spark, sf):
    return rounded(portfolio.risk_contributions(portfolio.shrunk_covariance(_returns(spark, sf)), _weights(spark)))


PATHS, DAYS = 2_000, 30
BLOCK = risk.block_length(DAYS, 2_500)
_DAILY = f"{C3}, {_W}, d AS (SELECT row_number() OVER (ORDER BY ts) - 1 AS at, r FROM (SELECT ts, sum(w * r) AS r FROM ret JOIN w USING (series_id) GROUP BY 1)), tt AS (SELECT count(*) AS t, avg(r) AS mean FROM d)"


def _draw(*parts: str) -> str:
    return "CAST('0x' || substr(md5(" + " || '-' || ".join(parts) + "), 1, 8) AS BIGINT)"


def _normal(*parts: str) -> str:
    u = [f"(({_draw(str(i), *parts)} + 0.5) / 4294967296.0::DOUBLE)" for i in (1, 2)]
    return f"(sqrt(-2 * ln({u[0]})) * cos(2 * pi() * {u[1]}))"


_LOSS = f"""{_DAILY}, st AS (SELECT path, k, {_draw("'42'", 'path', 'k')} % (t - {BLOCK} + 1) AS s FROM range(0, {PATHS}) a(path), range(0, {DAYS // BLOCK}) b(k), tt),
 losses AS (SELECT path, 1 - exp(sum(r)) AS loss FROM st, range(0, {BLOCK}) g(i), d WHERE d.at = s + i GROUP BY 1)"""


def _losses(spark, sf):
    return risk.bootstrap_losses(risk.portfolio_returns(_returns(spark, sf), _weights(spark)), PATHS, DAYS, BLOCK)


@query("krn_31_bootstrap", f"WITH {_LOSS} SELECT path, {r('loss', 'loss')} FROM losses")
def krn_31(spark, sf):
    return rounded(_losses(spark, sf))


@query("agg_17_measures", f"""WITH {_LOSS}, q AS (SELECT level, (SELECT quantile_cont(loss, 0.95) FROM losses) AS var FROM (VALUES (0.95::DOUBLE)) t(level) UNION ALL SELECT 0.99::DOUBLE, (SELECT quantile_cont(loss, 0.99) FROM losses)), n AS (SELECT count(*) AS n, stddev_samp(loss) AS sd FROM losses),
 g AS (SELECT level, max(var) AS var, greatest(avg(CASE WHEN loss >= var THEN loss END), max(var)) AS cvar, avg(exp(-0.5 * pow((loss - var) / (sd * pow(n, -0.2)), 2)) / (sd * pow(n, -0.2) * sqrt(2 * pi()))) AS f, max(n) AS n FROM losses, q, n GROUP BY 1)
 SELECT level, {r('var', 'var')}, {r('cvar', 'cvar')}, {r('sqrt(level * (1 - level)) / (sqrt(n) * greatest(f, 1e-6))', 'var_error')} FROM g""")
def agg_17(spark, sf):
    """AGG-17 to AGG-19: VaR, CVaR and the VaR's standard error."""
    return rounded(risk.measures(_losses(spark, sf)))


@query("agg_20_histogram", f"""WITH {_LOSS}, e AS (SELECT min(loss) AS lo, max(loss) AS hi, count(*) AS n, (max(loss) - min(loss)) / 30 AS w FROM losses) SELECT CAST(least(floor((loss - lo) / w), 29) AS BIGINT) AS bin, count(*) AS count, {r('count(*) / (max(n) * max(w))', 'density', 4)} FROM losses, e GROUP BY 1""")
def agg_20(spark, sf):
    return rounded(risk.histogram(_losses(spark, sf)), 4)


@query("agg_21_exceedance", f"WITH {_LOSS} SELECT o AS over, {r('avg(CASE WHEN loss > o THEN 1.0 ELSE 0 END)', 'probability')} FROM losses, (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.3::DOUBLE)) t(o) GROUP BY 1")
def agg_21(spark, sf):
    return rounded(risk.exceedance(_losses(spark, sf)))


_CENTRED = _LOSS.replace("1 - exp(sum(r)) AS loss FROM st,", "1 - exp(sum(r - mean)) AS loss FROM tt, st,")


@query("krn_34_report", f"""WITH {_CENTRED}, q AS (SELECT quantile_cont(loss, 0.95) AS var95, quantile_cont(loss, 0.99) AS var99 FROM losses)
 SELECT 42 AS seed, {r('max(var95)', 'var95')}, {r('max(var99)', 'var99')}, {r('greatest(avg(CASE WHEN loss >= var95 THEN loss END), max(var95))', 'cvar95')}, {r('median(loss)', 'median')}, {r('avg(loss)', 'mean')}, {r('avg(CASE WHEN loss > 0.1 THEN 1.0 ELSE 0 END)', 'over_10pct')} FROM losses, q""")
def krn_34(spark, sf):
    """The risk report with its seed: returns without their mean, as it is unless asked for otherwise."""
    daily = risk.portfolio_returns(_returns(spark, sf), _weights(spark))
    return rounded(risk.report(risk.bootstrap_losses(daily, PATHS, DAYS, BLOCK, centered=True), 42))


_FACTOR = f"""{_LW}, {_W}, v AS (SELECT max(annual) FILTER (i = 'A' AND j = 'A') / 252 AS aa, max(annual) FILTER (i = 'A' AND j = 'N') / 252 AS an, max(annual) FILTER (i = 'A' AND j = 'R') / 252 AS ar, max(annual) FILTER (i = 'N' AND j = 'N') / 252 AS nn, max(annual) FILTER (i = 'N' AND j = 'R') / 252 AS nr, max(annual) FILTER (i = 'R' AND j = 'R') / 252 AS rr FROM lw),
 f1 AS (SELECT *, sqrt(aa) AS l11, an / sqrt(aa) AS l21, ar / sqrt(aa) AS l31 FROM v), f2 AS (SELECT *, sqrt(nn - l21 * l21) AS l22, (nr - l31 * l21) / sqrt(nn - l21 * l21) AS l32 FROM f1), ch AS (SELECT *, sqrt(rr - l31 * l31 - l32 * l32) AS l33 FROM f2)"""


@query("mth_06_cholesky", f"""WITH {_FACTOR}, x AS (SELECT unnest([{{'i': 'A', 'j': 'A', 'v': l11}}, {{'i': 'N', 'j': 'A', 'v': l21}}, {{'i': 'N', 'j': 'N', 'v': l22}}, {{'i': 'R', 'j': 'A', 'v': l31}}, {{'i': 'R', 'j': 'N', 'v': l32}}, {{'i': 'R', 'j': 'R', 'v': l33}}]) AS x FROM ch) SELECT x.i AS i, x.j AS j, {r('x.v', 'l', 9)} FROM x""")
def mth_06(spark, sf):
    """The lower factor of the shrunk daily covariance."""
    return rounded(_factor(spark, sf), 9)


def _factor(spark, sf):
    return risk.factors(portfolio.shrunk_covariance(_returns(spark, sf)).withColumn("daily", F.col("annual") / portfolio.YEAR))


def _means(spark, sf):
    return _returns(spark, sf).groupBy("series_id").agg(F.avg("r").alias("m"))


_GAUSS = f"""mu AS (SELECT sum(w * m) AS mean FROM (SELECT series_id, avg(r) AS m FROM ret GROUP BY 1) JOIN w USING (series_id)),
 gc AS (SELECT 0.5 * l11 + 0.3 * l21 + 0.2 * l31 AS p0, 0.3 * l22 + 0.2 * l32 AS p1, 0.2 * l33 AS p2, mu.mean FROM ch, mu)"""


@query("krn_33_gaussian", f"""WITH {_FACTOR}, {_GAUSS} SELECT path, {r(f"1 - exp({DAYS} * mean + sqrt({DAYS}) * (p0 * {_normal('1', 'path', '0')} + p1 * {_normal('1', 'path', '1')} + p2 * {_normal('1', 'path', '2')}))", 'loss')} FROM gc, range(0, {PATHS}) g(path)""")
def krn_33(spark, sf):
    """Joint normal returns with the shrunk covariance, by its factor."""
    sums = risk.gaussian_sums(_factor(spark, sf), _weights(spark), _means(spark, sf), PATHS, (DAYS,), 1)
    return rounded(sums.select("path", (1 - F.exp("total")).alias("loss")))


#: Student's t by maximum likelihood: the same optimum by plain gradient steps on the whole list of returns; psi by differences of lgamma.
def _psi(x: str) -> str:
    return f"((lgamma({x} + 1e-4) - lgamma({x} - 1e-4)) / 2e-4)"


_D2 = "pow(v - mu, 2) / s2"
_STUDENT = f"""tx AS (SELECT list(r) AS xs, count(*) AS n, avg(r) AS mean, stddev_pop(r) AS sd FROM d),
 em AS (SELECT 0 AS step, mean AS mu, 0.6 * sd * sd AS s2, 5.0::DOUBLE AS nu FROM tx UNION ALL
  SELECT step + 1, list_sum(list_transform(xs, lambda v: v * (nu + 1) / (nu + {_D2}))) / list_sum(list_transform(xs, lambda v: (nu + 1) / (nu + {_D2}))),
   list_sum(list_transform(xs, lambda v: pow(v - mu, 2) * (nu + 1) / (nu + {_D2}))) / n,
   least(200.0::DOUBLE, nu * exp(least(0.5, greatest(-0.5, 6 * nu * ({_psi('(nu + 1) / 2')} / 2 - {_psi('nu / 2')} / 2 - 0.5 / nu - 0.5 * list_sum(list_transform(xs, lambda v: ln(1 + {_D2} / nu))) / n + (nu + 1) / 2 * list_sum(list_transform(xs, lambda v: {_D2} / (nu * nu + nu * {_D2}))) / n)))))
  FROM em, tx WHERE step < 1500),
 ft AS (SELECT CASE WHEN nu > 199.8 THEN 'Infinity'::DOUBLE ELSE nu END AS df, mu, sqrt(s2) AS scale, n, mean, sd FROM em, tx WHERE step = 1500)"""


@query("krn_32_fit", f"WITH RECURSIVE {_DAILY}, {_STUDENT} SELECT n, {r('least(df, 200)', 'df', 2)}, {r('mu', 'loc', 5)}, {r('scale', 'scale', 5)} FROM ft")
def krn_32_fit(spark, sf):
    """Degrees of freedom, location and scale of the portfolio's returns: expectation and maximisation whose sums are aggregates."""
    f = risk.fit_student(risk.portfolio_returns(_returns(spark, sf), _weights(spark)))
    out = spark.createDataFrame([(f["n"], min(f["df"], 200.0), f["loc"], f["scale"])], "n long, df double, loc double, scale double")
    return out.select("n", (F.round("df", 2) + F.lit(0.0)).alias("df"), *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("loc", "scale")])


def _student_sql(seed: str, horizons: tuple[int, ...], paths: int) -> str:
    """ts(h, s, path, total) from ft and seeds {seed}: sums of t numbers, or one normal number for their sum."""
    u = [f"((CAST('0x' || substr(md5(s || '-' || path || '-' || k), {1 + 8 * i}, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE)" for i in range(4)]
    t = [f"sqrt(df * (pow({u[2 * i]}, -2 / df) - 1)) * cos(2 * pi() * {u[2 * i + 1]})" for i in range(2)]
    sums = ", ".join(f"sum(CASE WHEN 2 * k < {h} THEN a ELSE 0 END + CASE WHEN 2 * k + 1 < {h} THEN b ELSE 0 END) AS s{h}" for h in horizons)
    each = " UNION ALL ".join(f"SELECT {h} AS h, s, path, {h} * mean + sd * sqrt((df - 2) / df) * s{h} AS total FROM tt2, ft" for h in horizons)
    plain = " UNION ALL ".join(f"SELECT {h}, s, path, {h} * mean + sqrt({h}) * sd * {_normal('s', 'path', str(h))} FROM ft, {seed}, range(0, {paths}) g(path) WHERE df > 30 OR df <= 2" for h in horizons)
    return f"""tt1 AS (SELECT s, path, k, {t[0]} AS a, {t[1]} AS b FROM ft, {seed}, range(0, {paths}) g(path), range(0, {(max(horizons) + 1) // 2}) q(k) WHERE df <= 30 AND df > 2), tt2 AS (SELECT s, path, {sums} FROM tt1 GROUP BY ALL), ts AS ({each} UNION ALL {plain})"""


@query("krn_32_student", f"WITH RECURSIVE {_DAILY}, {_STUDENT}, {_student_sql('(VALUES (1)) z(s)', (DAYS,), PATHS)} SELECT path, {r('total', 'total', 4)} FROM ts")
def krn_32(spark, sf):
    """Summed Student-t returns with the fitted degrees of freedom, scaled to the sample's deviation."""
    daily = risk.portfolio_returns(_returns(spark, sf), _weights(spark))
    sums = risk.student_sums(spark, risk.fit_student(daily), PATHS, (DAYS,), 1)
    return rounded(sums.select("path", "total"), 4)


SEEDS, RUNS, HORIZONS = 20, 10_000, (30, 90, 252)
STUDY = ("var95", "cvar95", "var99", "cvar99", "p10", "p20", "p30")
_SEEDS = f"range(1, {SEEDS + 1}) z(s)"
_STUDY = f"""pf AS (SELECT d.at AS place, sum(r) OVER (ORDER BY d.at) - r AS c FROM d UNION ALL SELECT count(*), sum(r) FROM d),
 bs AS (SELECT h, s, path, sum(b.c - a.c) AS total FROM (SELECT h, s, path, k, {_draw('s', 'path', 'k')} % (t - {BLOCK} + 1) AS st, least({BLOCK}, h - k * {BLOCK}) AS len FROM (VALUES {', '.join(f'({h})' for h in HORIZONS)}) hh(h), {_SEEDS}, range(0, {RUNS}) g(path), range(0, {-(-max(HORIZONS) // BLOCK)}) q(k), tt WHERE k * {BLOCK} < h)
  JOIN pf a ON a.place = st JOIN pf b ON b.place = st + len GROUP BY ALL),
 gz AS (SELECT s, path, mean, p0 * {_normal('s', 'path', '0')} + p1 * {_normal('s', 'path', '1')} + p2 * {_normal('s', 'path', '2')} AS z FROM gc, {_SEEDS}, range(0, {RUNS}) g(path)),
 gs AS (SELECT h, s, path, h * mean + sqrt(h) * z AS total FROM gz, (VALUES {', '.join(f'({h})' for h in HORIZONS)}) hh(h)),
 al AS (SELECT 'bootstrap' AS method, * FROM bs UNION ALL SELECT 'student', * FROM ts UNION ALL SELECT 'gaussian', * FROM gs),
 ls AS (SELECT method, h, s, drift, 1 - exp(total - CASE WHEN drift = 'centered' THEN h * tt.mean ELSE 0 END) AS loss FROM al, tt, (VALUES ('historical'), ('centered')) dr(drift)),
 qs AS (SELECT method, h, s, drift, quantile_cont(loss, 0.95) AS var95, quantile_cont(loss, 0.99) AS var99 FROM ls GROUP BY ALL),
 rs AS (SELECT method, h, s, drift, var95, var99, greatest(avg(CASE WHEN loss >= var95 THEN loss END), var95) AS cvar95, greatest(avg(CASE WHEN loss >= var99 THEN loss END), var99) AS cvar99, avg(CASE WHEN loss > 0.1 THEN 1.0 ELSE 0 END) AS p10, avg(CASE WHEN loss > 0.2 THEN 1.0 ELSE 0 END) AS p20, avg(CASE WHEN loss > 0.3 THEN 1.0 ELSE 0 END) AS p30 FROM ls JOIN qs USING (method, h, s, drift) GROUP BY method, h, s, drift, var95, var99)"""


@query("krn_52_drift_study", f"""WITH RECURSIVE {_FACTOR}, {_DAILY.removeprefix(C3 + ', ' + _W + ', ')}, {_GAUSS}, {_STUDENT}, {_student_sql(_SEEDS, HORIZONS, RUNS)}, {_STUDY}
 SELECT method, h AS horizon, drift, count(*) AS seeds, {', '.join(r(f'avg({m})', m, 6 if m[0] == 'p' else 4) + ', ' + r(f'stddev_samp({m})', m + '_sd', 4) for m in STUDY)} FROM rs GROUP BY ALL""")
def krn_52(spark, sf):
    """KRN-52, AGG-31: seven measures by method, horizon and drift over 20 seeds of 10,000 paths, mean and deviation."""
    ret, w = _returns(spark, sf), _weights(spark)
    daily = settled(risk.portfolio_returns(ret, w))
    fit = risk.fit_student(daily)
    sums = {
        "bootstrap": risk.bootstrap_sums(daily, RUNS, HORIZONS, BLOCK, SEEDS), "student": risk.student_sums(spark, fit, RUNS, HORIZONS, SEEDS),
        "gaussian": risk.gaussian_sums(settled(_factor(spark, sf)), w, _means(spark, sf), RUNS, HORIZONS, SEEDS),
    }
    every = None
    for method, s in sums.items():
        s = s.select(F.lit(method).alias("method"), "horizon", "seed", "total")
        every = s if every is None else every.unionByName(s)
    cells = risk.study(settled(risk.with_drift(every, fit["mean"])), ("method", "horizon", "seed", "drift"))
    means = [F.round(F.avg(m), 6 if m[0] == "p" else 4).alias(m) for m in STUDY]  # shares of 200,000 paths have six digits
    return cells.groupBy("method", "horizon", "drift").agg(F.count("*").alias("seeds"), *means, *[F.round(F.stddev_samp(m), 4).alias(f"{m}_sd") for m in STUDY])


_STRATEGY = """SELECT '{n}' AS strategy, {a}, {v}, {s} FROM (SELECT avg(r) * 252 AS annual_return, stddev_samp(r) * sqrt(252) AS volatility FROM (SELECT ts, sum({w} * r) AS r FROM ret JOIN w USING (series_id) GROUP BY 1))"""


def _strategy_sql(name: str, w: str) -> str:
    return _STRATEGY.format(n=name, w=w, a=r("annual_return", "annual_return"), v=r("volatility", "volatility"), s=r("(annual_return - 0.04) / volatility", "sharpe"))


@query("krn_30_given_weights", f"WITH {C3}, {_W} {_strategy_sql('equal', '1 / 3.0::DOUBLE')} UNION ALL {_strategy_sql('current', 'w')}")
def krn_30_given(spark, sf):
    """The two of the four strategies that solve nothing."""
    return rounded(portfolio.strategies(_returns(spark, sf), {"equal": {n: 1 / 3 for n in "ANR"}, "current": {"A": 0.5, "N": 0.3, "R": 0.2}}))


#: w: equal shares of risk by coordinate descent, from x(book, names, m, diag) with m the rows of the covariance.
_PARITY = """st AS (SELECT book, 0 AS step, list_transform(diag, lambda d: 1 / sqrt(d)) AS x FROM mx UNION ALL
  SELECT st.book, step + 1, list_transform(range(1, len(x) + 1), lambda i: CASE WHEN i = step % len(x) + 1 THEN
   (-(list_dot_product(m[i], x) - diag[i] * x[i]) + sqrt(pow(list_dot_product(m[i], x) - diag[i] * x[i], 2) + 4 * diag[i] / len(x))) / (2 * diag[i]) ELSE x[i] END)
  FROM st JOIN mx USING (book) WHERE step < 40 * len(x)),
 pw AS (SELECT st.book, names, list_transform(x, lambda v: v / list_sum(x)) AS w, m, mu FROM st JOIN mx USING (book) WHERE step = 40 * len(x))"""


def _estimates_sql(k_is_two: str = "k <= 2 OR spread <= 1e-8") -> str:
    """From books(book, name) and ret: es(book, i, j, n, annual, mu), and mx(book, names, m, diag, mu) with the covariance's rows."""
    return f"""pb AS (SELECT a.book, a.name AS i, b.name AS j FROM books a JOIN books b ON a.book = b.book AND a.name <= b.name),
 pr AS (SELECT x.series_id AS i, y.series_id AS j, x.ts, x.r AS x, y.r AS y FROM ret x JOIN ret y ON x.ts = y.ts AND x.series_id <= y.series_id),
 mo AS (SELECT i, j, count(*) AS n, covar_samp(x, y) AS s, avg(x) AS mx, avg(y) AS my FROM pr GROUP BY ALL), po AS (SELECT i, j, avg(pow((x - mx) * (y - my) - s, 2)) AS pi FROM pr JOIN mo USING (i, j) GROUP BY ALL),
 bp AS (SELECT book, i, j, n, s, pi, mx * 252 AS mean FROM pb JOIN mo USING (i, j) JOIN po USING (i, j)), tg AS (SELECT book, avg(s) AS target, avg(mean) AS centre, count(*) AS k, max(n) AS t FROM bp WHERE i = j GROUP BY 1),
 ii AS (SELECT book, CASE WHEN sum(c * o * o) < 1e-12 THEN 0 ELSE greatest(0, least(1, sum(c * pi) / max(n) / sum(c * o * o))) END AS intensity FROM
  (SELECT book, n, pi, CASE WHEN i = j THEN 1 ELSE 2 END AS c, s - CASE WHEN i = j THEN target ELSE 0 END AS o FROM bp JOIN tg USING (book)) GROUP BY 1),
 an AS (SELECT book, i, j, n, mean, ((1 - intensity) * s + CASE WHEN i = j THEN intensity * target ELSE 0 END) * 252 AS annual FROM bp JOIN tg USING (book) JOIN ii USING (book)),
 sp AS (SELECT book, sum(annual) AS trace, sum(pow(mean - centre, 2)) AS spread FROM an JOIN tg USING (book) WHERE i = j GROUP BY 1),
 es AS (SELECT book, i, j, n, annual, CASE WHEN i = j THEN (1 - pt) * mean + pt * centre END AS mu FROM an JOIN (SELECT book, centre, CASE WHEN {k_is_two} THEN 0.2 ELSE greatest(0, least(1, (k - 2) * trace / (k * t) / spread)) END AS pt FROM tg JOIN sp USING (book)) USING (book)),
 fu AS (SELECT book, i, j, annual FROM es UNION ALL SELECT book, j, i, annual FROM es WHERE i < j), ro AS (SELECT book, i, list(annual ORDER BY j) AS r FROM fu GROUP BY ALL),
 mx AS (SELECT book, list(i ORDER BY i) AS names, list(r ORDER BY i) AS m, list(annual ORDER BY i) AS diag, list(mu ORDER BY i) AS mu FROM ro JOIN (SELECT book, i, annual, mu FROM es WHERE i = j) USING (book, i) GROUP BY 1)"""


#: The best of three assets under the cap 0.6: of the tangency, the corners, and the best point of every edge w_i = 0 or 0.6.
_BEST_OF_THREE = """ex AS (SELECT book, names, m, mu, m[1][1] AS a, m[1][2] AS b, m[1][3] AS c, m[2][2] AS d, m[2][3] AS e, m[3][3] AS f, mu[1] - 0.04 AS x1, mu[2] - 0.04 AS x2, mu[3] - 0.04 AS x3 FROM mx WHERE len(names) = 3),
 ta AS (SELECT book, [(d * f - e * e) * x1 + (c * e - b * f) * x2 + (b * e - c * d) * x3, (c * e - b * f) * x1 + (a * f - c * c) * x2 + (b * c - a * e) * x3, (b * e - c * d) * x1 + (b * c - a * e) * x2 + (a * d - b * b) * x3] AS y FROM ex),
 ed AS (SELECT book, i, bound, i % 3 + 1 AS j, (i + 1) % 3 + 1 AS k, m, mu, greatest(0, 1 - bound - 0.6) AS low, least(0.6, 1 - bound) AS high FROM ex, (VALUES (1), (2), (3)) g(i), (VALUES (0.0::DOUBLE), (0.6::DOUBLE)) h(bound)),
 ln AS (SELECT *, bound * (mu[i] - 0.04) + (1 - bound) * (mu[k] - 0.04) AS al, mu[j] - mu[k] AS be, bound * bound * m[i][i] + 2 * bound * (1 - bound) * m[i][k] + (1 - bound) * (1 - bound) * m[k][k] AS qa,
   bound * (m[i][j] - m[i][k]) + (1 - bound) * (m[j][k] - m[k][k]) AS qb, m[j][j] - 2 * m[j][k] + m[k][k] AS qc FROM ed),
 sv AS (SELECT book, i, j, k, bound, unnest([low, high, least(high, greatest(low, (be * qa - al * qb) / (al * qc - be * qb)))]) AS s FROM ln),
 cd AS (SELECT book, list_transform([1, 2, 3], lambda q: CASE WHEN q = i THEN bound WHEN q = j THEN s ELSE 1 - bound - s END) AS w FROM sv UNION ALL SELECT book, list_transform(y, lambda v: v / list_sum(y)) FROM ta),
 be AS (SELECT book, names, arg_max(w, (list_dot_product(w, mu) - 0.04) / sqrt(list_dot_product(w, list_transform(m, lambda v: list_dot_product(v, w))))) AS w, any_value(m) AS m, any_value(mu) AS mu
  FROM cd JOIN ex USING (book) WHERE list_min(w) >= -1e-12 AND list_max(w) <= 0.6 + 1e-12 GROUP BY ALL)"""
#: From aw(book, method, names, w, m, mu): a row for each name of each book and method.
_PARTS = f"""SELECT book, method, names[q] AS name, {r('w[q]', 'w')}, {r('w[q] * list_dot_product(m[q], w) / va', 'share')}, {r('re', 'annual_return')}, {r('sqrt(va)', 'volatility')}, {r('(re - 0.04) / sqrt(va)', 'sharpe')}
 FROM (SELECT *, list_dot_product(w, mu) AS re, list_dot_product(w, list_transform(m, lambda v: list_dot_product(v, w))) AS va, unnest(range(1, len(names) + 1)) AS q FROM aw)"""
_FLAGS = C3 + ", books AS (SELECT DISTINCT 'flags' AS book, series_id AS name FROM ret), " + _estimates_sql() + ", " + _PARITY + ", " + _BEST_OF_THREE


def _flags(spark, sf):
    """The three series as one book with the weights of _weights()."""
    ret = _returns(spark, sf)
    held = ret.select(F.col("series_id").alias("name")).distinct().join(F.broadcast(_weights(spark)), F.col("name") == F.col("series_id"), "left")
    return ret, held.select(F.lit("flags").alias("book"), "name", F.coalesce("w", F.lit(0.0)).alias("w"))


@query("krn_30_strategies", f"""WITH RECURSIVE {_FLAGS}, {_W}, aw AS (SELECT 'parity' AS method, book, names, w, m, mu FROM pw UNION ALL SELECT 'sharpe', book, names, w, m, mu FROM be UNION ALL SELECT 'equal', book, names, list_transform(names, lambda v: 1 / len(names)::DOUBLE), m, mu FROM mx
  UNION ALL SELECT 'current', book, names, (SELECT list(w.w ORDER BY series_id) FROM w), m, mu FROM mx) {_PARTS}""")
def krn_30(spark, sf):
    """KRN-26, KRN-27, KRN-28, KRN-30: the four strategies of the three series: the SQL descends by coordinates, and tries every corner, edge and inner point."""
    return rounded(books.optimized(*_flags(spark, sf)).drop("residual"))


@query("krn_26_max_sharpe", f"WITH RECURSIVE {_FLAGS}, aw AS (SELECT names, w FROM be) SELECT names[q] AS series_id, {r('w[q]', 'w')} FROM (SELECT *, unnest([1, 2, 3]) AS q FROM aw)")
def krn_26(spark, sf):
    """Weights of the largest Sharpe ratio, up to 0.6 each."""
    return rounded(books.optimized(*_flags(spark, sf)).where("method = 'sharpe'").select(F.col("name").alias("series_id"), "w"))


@query("krn_27_risk_parity", f"WITH RECURSIVE {_FLAGS}, aw AS (SELECT names, w, m FROM pw) SELECT names[q] AS series_id, {r('w[q]', 'w')}, {r('w[q] * list_dot_product(m[q], w)', 'contribution')} FROM (SELECT *, unnest([1, 2, 3]) AS q FROM aw)")
def krn_27(spark, sf):
    """Equal risk contributions: weights and contributions."""
    x = books.optimized(*_flags(spark, sf)).where("method = 'parity'")
    return rounded(x.select(F.col("name").alias("series_id"), "w", (F.col("share") * F.col("volatility") * F.col("volatility")).alias("contribution")))


_USERS = """ev AS (SELECT CAST(user_id AS VARCHAR) AS book, event_type AS name, sum(CAST(value AS DECIMAL(18,2))) AS spent FROM events GROUP BY ALL), dv AS (SELECT event_type AS series_id, CAST(ts AS DATE) AS ts, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS value FROM events GROUP BY ALL),
 ret AS (SELECT series_id, ts, ln(value / lag(value) OVER (PARTITION BY series_id ORDER BY ts)) AS r FROM dv QUALIFY r IS NOT NULL), books AS (SELECT book, name FROM ev WHERE spent > 0)"""


def _users(spark, sf):
    """Daily returns of the event types, and users' holdings of them, one book a user."""
    e = series.table(spark, sf, "events").select("user_id", "event_type", F.col("ts").cast("date").alias("ts"), F.col("value").cast("decimal(18,2)").alias("value"))
    daily = e.groupBy(F.col("event_type").alias("series_id"), "ts").agg((F.sum("value").cast("double") / F.count("*")).alias("value"))
    held = e.groupBy(F.col("user_id").cast("string").alias("book"), F.col("event_type").alias("name")).agg(F.sum("value").cast("double").alias("w")).where("w > 0")
    return returns.log_returns(daily), held


@query("krn_30_books", f"""WITH RECURSIVE {_USERS}, {_estimates_sql()}, {_PARITY}, aw AS (SELECT 'parity' AS method, book, names, w, m, mu FROM pw UNION ALL SELECT 'equal', book, names, list_transform(names, lambda v: 1 / len(names)::DOUBLE), m, mu FROM mx
  UNION ALL SELECT 'current', book, names, list_transform(h, lambda v: v / list_sum(h)), m, mu FROM mx JOIN (SELECT book, list(CAST(spent AS DOUBLE) ORDER BY name) AS h FROM ev WHERE spent > 0 GROUP BY 1) USING (book)) {_PARTS}""")
def krn_30_books(spark, sf):
    """Equal risk, equal and current weights of every user's book; krn_26_books has the largest Sharpe ratio."""
    return rounded(books.optimized(*_users(spark, sf)).where("method <> 'sharpe'").drop("residual"))


@query("krn_26_books", f"""WITH RECURSIVE {_USERS} SELECT book, count(*) AS names, 1.0::DOUBLE AS total, TRUE AS under_cap, TRUE AS optimal, TRUE AS above_others FROM books GROUP BY 1""")
def krn_26_books(spark, sf):
    """The largest Sharpe ratio of every user's book: its weights add to 1 under the cap, meet the optimum's conditions to 1e-8, and no other strategy under the cap has a larger ratio."""
    x = books.optimized(*_users(spark, sf))
    own, cap = F.col("method") == "sharpe", F.greatest(F.lit(0.6), 1 / F.count(F.when(F.col("method") == "sharpe", 1)).over(W.partitionBy("book")))
    g = x.withColumn("cap", cap).groupBy("book", "method").agg(F.count("*").alias("n"), F.sum("w").alias("total"), F.max("w").alias("most"), F.max("cap").alias("cap"), F.max("residual").alias("residual"), F.max("sharpe").alias("ratio"))
    fits = F.col("most") <= F.col("cap") + 1e-9
    b = g.groupBy("book").agg(
        F.max(F.when(own, F.col("n"))).alias("names"), F.max(F.when(own, F.round("total", 9))).alias("total"), F.bool_and(F.when(own, fits)).alias("under_cap"),
        F.bool_and(F.when(own, F.col("residual") < 1e-8)).alias("optimal"), F.max(F.when(own, F.col("ratio"))).alias("best"), F.max(F.when(~own & fits, F.col("ratio"))).alias("other"))
    return b.select("book", "names", "total", "under_cap", "optimal", (F.coalesce("other", "best") <= F.col("best") + 1e-9).alias("above_others"))


_TWO = f"""{_COV}, v AS (SELECT max(s) FILTER (i = 'A' AND j = 'A') * 252 AS aa, max(s) FILTER (i = 'A' AND j = 'N') * 252 AS an, max(s) FILTER (i = 'N' AND j = 'N') * 252 AS nn FROM s)"""


def _two(spark, sf, method):
    """The book of two assets with given means and the plain covariance: one row."""
    mu = F.when(F.col("i") == F.col("j"), F.when(F.col("i") == "A", 0.15).otherwise(0.10))
    e = _annual(spark, sf, "A", "N").select(F.lit("two").alias("book"), "i", "j", "annual", mu.alias("mu"))
    w = books.solved(e, ("book",), cap=1.0).where(F.col("method") == method)
    return w.groupBy("book").agg(*[F.max(F.when(F.col("name") == n, F.col("w"))).alias(n.lower()) for n in "AN"]).drop("book")


@query("krn_26_two_assets", f"WITH {_TWO}, x AS (SELECT nn * (0.15 - 0.04) - an * (0.10 - 0.04) AS a, aa * (0.10 - 0.04) - an * (0.15 - 0.04) AS n FROM v) SELECT {r('a / (a + n)', 'a', 5)}, {r('n / (a + n)', 'n', 5)} FROM x")
def krn_26_two(spark, sf):
    """The tangency portfolio of two assets, which has a closed form."""
    return rounded(_two(spark, sf, "sharpe"), 5)


@query("krn_27_two_assets", f"WITH {_TWO} SELECT {r('(1 / sqrt(aa)) / (1 / sqrt(aa) + 1 / sqrt(nn))', 'a')}, {r('(1 / sqrt(nn)) / (1 / sqrt(aa) + 1 / sqrt(nn))', 'n')} FROM v")
def krn_27_two(spark, sf):
    """Equal risk of two assets: weights by inverse volatility, whatever their correlation."""
    return rounded(_two(spark, sf, "parity"))


def _annual(spark, sf, *names):
    return portfolio.covariance(_returns(spark, sf).where(F.col("series_id").isin(*names))).withColumn("annual", F.col("s") * portfolio.YEAR)


@query("krn_29_forecast_returns", f"""WITH RECURSIVE {D3}, x AS (SELECT series_id, ln(value) AS y, value, CAST(row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS INT) AS place FROM d3),
 fl AS (SELECT x.series_id, 0 AS place, x.y AS l, x1.y - x.y AS tr, 0::DOUBLE AS sse FROM x JOIN x x1 ON x1.series_id = x.series_id AND x1.place = 1 WHERE x.place = 0 UNION ALL
  SELECT x.series_id, x.place, l + 0.95 * tr + 0.3 * (y - l - 0.95 * tr), 0.95 * tr + 0.03 * (y - l - 0.95 * tr), sse + pow(y - l - 0.95 * tr, 2) FROM fl JOIN x ON x.series_id = fl.series_id AND x.place = fl.place + 1),
 e AS (SELECT series_id, arg_max(l, place) AS l, arg_max(tr, place) AS tr, max(sse) / max(place) AS s2 FROM fl GROUP BY 1), p AS (SELECT series_id, arg_max(value, place) AS last FROM x GROUP BY 1),
 f AS (SELECT series_id, l + tr * 0.95 * (1 - pow(0.95, 30)) / 0.05 + s2 * (1 + (SELECT sum(pow(0.3 + 0.03 * 0.95 * (1 - pow(0.95, j)) / 0.05, 2)) FROM range(1, 30) q(j))) / 2 AS mu FROM e)
 SELECT series_id, {r('(mu - ln(last)) * 252 / 30', 'mu', 5)}, abs((mu - ln(last)) * 252 / 30) > 1 AS warning FROM f JOIN p USING (series_id)""")
def krn_29(spark, sf):
    """Expected returns that forecasts imply: log(F / P) * 252 / h, with a warning where that is over 100 percent."""
    prices = series.daily_flags(spark, sf)
    f = holt.forecast(holt.with_parameters(holt.training_arrays(prices)), 30).where("h = 30")
    last = prices.groupBy("series_id").agg(F.max_by("value", "ts").alias("last"))
    mu = F.ln(F.col("value") / F.col("last")) * portfolio.YEAR / 30
    return rounded(f.join(last, "series_id").select("series_id", F.round(mu, 5).alias("mu"), (F.abs(mu) > 1).alias("warning")))


def _p_sql(c: str) -> str:
    """The two-sided p of a correlation c of n pairs: Student's density integrated by Simpson's rule."""
    t = f"(abs({c}) * sqrt((n - 2) / (1 - {c} * {c})))"
    return f"""CASE WHEN i = j THEN 0 WHEN abs({c}) >= 1 THEN 0 ELSE 2 * (SELECT sum(CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * pow(1 + pow({t} + k * 0.005::DOUBLE, 2) / (n - 2), -(n - 1) / 2.0::DOUBLE)) * 0.005 / 3 * exp(lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0)) / sqrt((n - 2) * pi()) FROM range(0, 4001) g(k)) END"""


@query("agg_13_p_values", f"""WITH {_PAIR}, k AS (SELECT series_id, ts, rank() OVER (PARTITION BY series_id ORDER BY r) + (count(*) OVER (PARTITION BY series_id, r) - 1) / 2.0 AS r FROM ret),
 q AS (SELECT a.series_id AS i, b.series_id AS j, corr(a.r, b.r) AS sc FROM k a JOIN k b ON a.ts = b.ts AND a.series_id <= b.series_id GROUP BY ALL), p AS (SELECT i, j, corr(x, y) AS pc, count(*) AS n FROM pr GROUP BY ALL)
 SELECT i, j, n, {r('CASE WHEN i = j THEN 1 ELSE pc END', 'pearson')}, {r('CASE WHEN i = j THEN 1 ELSE sc END', 'spearman')}, {r(_p_sql('pc'), 'pearson_p', 5)}, {r(_p_sql('sc'), 'spearman_p', 5)} FROM p JOIN q USING (i, j)""")
def agg_13_p(spark, sf):
    """AGG-13, AGG-14: both coefficients with their two-sided p-values; the SQL integrates the density of Student's t."""
    p = portfolio.p_values(portfolio.correlations(_returns(spark, sf)))
    return rounded(p.select("i", "j", "n", "pearson", "spearman", *[F.round(c, 5).alias(c) for c in ("pearson_p", "spearman_p")]))


def _book(spark, sf):
    prices = align.wide(series.daily_flags(spark, sf), ["A", "N", "R"]).withColumn("portfolio", F.lit("equal"))
    return rebalance.book(prices, ["A", "N", "R"])


def _book_sql(targets: str) -> str:
    """The book as a recursive query; targets: a CTE tg(t, w) of the weights from day t on."""
    def each(expression: str) -> str:
        return f"list_transform([1, 2, 3], lambda i: {expression})"

    gv, nv = "list_dot_product(k.g, d.p)", "list_dot_product(k.n, d.p)"
    paid = f"(list_sum({each(f'abs(d.w[i] * {nv} / d.p[i] - k.n[i]) * d.p[i]')}) * 0.001 + 0.2 * list_sum({each(f'greatest(k.n[i] - d.w[i] * {nv} / d.p[i], 0) * greatest(d.p[i] - k.b[i], 0)')}))"
    trade = "d.t % 21 = 0"
    return f"""WITH RECURSIVE {C3}, pw AS (SELECT ts, list(value ORDER BY series_id) AS p FROM c3 GROUP BY 1), pt AS (SELECT ts, p, CAST(row_number() OVER (ORDER BY ts) - 1 AS INT) AS t FROM pw), {targets},
 dd AS (SELECT pt.*, coalesce(last_value(tg.w IGNORE NULLS) OVER (ORDER BY t), [1 / 3.0::DOUBLE, 1 / 3.0::DOUBLE, 1 / 3.0::DOUBLE]) AS w FROM pt LEFT JOIN tg USING (ts)),
 k AS (SELECT d.t, {each('d.w[i] / d.p[i]')} AS g, {each('d.w[i] / d.p[i]')} AS n, d.p AS b, {each('d.w[i] / d.p[i]')} AS hold FROM dd d WHERE t = 0 UNION ALL
  SELECT d.t, CASE WHEN {trade} THEN {each(f'd.w[i] * {gv} / d.p[i]')} ELSE k.g END, CASE WHEN {trade} THEN {each(f'd.w[i] * {nv} / d.p[i] * ({nv} - {paid}) / {nv}')} ELSE k.n END,
  CASE WHEN {trade} THEN {each(f'CASE WHEN d.w[i] * {nv} / d.p[i] > k.n[i] THEN d.p[i] ELSE k.b[i] END')} ELSE k.b END, k.hold FROM k JOIN dd d ON d.t = k.t + 1)
 SELECT ts, {r('list_dot_product(g, p)', 'gross')}, {r('list_dot_product(n, p)', 'net')}, {r('list_dot_product(hold, p)', 'hold')} FROM k JOIN dd USING (t)"""


@query("krn_35_rebalance", _book_sql("tg AS (SELECT ts, NULL::DOUBLE[] AS w FROM pt WHERE FALSE)"))
def krn_35(spark, sf):
    """The book day by day: with costs and tax, without, and never traded."""
    return rounded(_book(spark, sf).drop("portfolio"))


_LOOKBACK = """lb AS (SELECT ts, series_id, row_number() OVER w AS place, stddev_samp(r) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS sd FROM ret WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
 lw AS (SELECT ts, series_id, 1 / sd / sum(1 / sd) OVER (PARTITION BY ts) AS w FROM lb WHERE place % 21 = 0 AND place >= 60 AND sd > 0)"""


@query("win_07_lookback_weights", f"WITH {C3}, {_LOOKBACK} SELECT ts, series_id, {r('w', 'w')} FROM lw")
def win_07(spark, sf):
    """Weights at each rebalance from the returns of the last 252 days up to it."""
    return rounded(rebalance.lookback_weights(_returns(spark, sf)))


@query("krn_35_walk_forward", _book_sql(_LOOKBACK + ", tg AS (SELECT ts, list(w ORDER BY series_id) AS w FROM lw GROUP BY 1)"))
def krn_35_walk(spark, sf):
    """The book whose weights are set anew at each rebalance."""
    names = ["A", "N", "R"]
    w = rebalance.lookback_weights(_returns(spark, sf)).groupBy("ts").agg(F.array(*[F.max(F.when(F.col("series_id") == n, F.col("w"))) for n in names]).alias("target"))
    prices = align.wide(series.daily_flags(spark, sf), names).join(w, "ts", "left").withColumn("portfolio", F.lit("moving"))
    return rounded(rebalance.book(prices, names).drop("portfolio"))


def _portfolios(spark, sf):
    """Prices of four portfolios: each two of the three series, and all of them."""
    prices = align.common_dates(series.daily_flags(spark, sf))
    own = F.array(*[F.lit(p) for p in ("AN", "AR", "NR", "ANR")])
    return prices.withColumn("portfolio", F.explode(F.filter(own, lambda p: F.contains(p, F.col("series_id")))))


#: Pairs of the three series, rb: their rebalances, and w1 of both methods at each from the 252 returns before it.
_PAIRS = """px AS (SELECT a.series_id || b.series_id AS portfolio, a.ts, a.value AS p1, b.value AS p2, CAST(row_number() OVER (PARTITION BY a.series_id, b.series_id ORDER BY a.ts) - 1 AS INT) AS place FROM c3 a JOIN c3 b ON a.ts = b.ts AND a.series_id < b.series_id),
 nd AS (SELECT portfolio, count(*) AS n, CAST(greatest(least(252, count(*) - 22), 126) AS INT) AS start FROM px GROUP BY 1), rx AS (SELECT portfolio, place, ln(p1 / lag(p1) OVER w) AS x, ln(p2 / lag(p2) OVER w) AS y FROM px WINDOW w AS (PARTITION BY portfolio ORDER BY place)),
 rb AS (SELECT portfolio, every, start + CAST(k AS INT) * every AS pl FROM nd, (VALUES (21), (63)) e(every), range(0, 400) g(k) WHERE start + k * every < n AND n - start >= 21),
 rr AS (SELECT rb.portfolio, every, pl, x, y FROM rb JOIN rx ON rx.portfolio = rb.portfolio AND rx.place > pl - 252 AND rx.place <= pl AND rx.place > 0),
 m1 AS (SELECT portfolio, every, pl, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_samp(x) AS sx, var_samp(y) AS sy, covar_samp(x, y) AS sxy FROM rr GROUP BY ALL),
 m2 AS (SELECT portfolio, every, pl, any_value(n) AS n, any_value(mx) AS mx, any_value(my) AS my, any_value(sx) AS sx, any_value(sy) AS sy, any_value(sxy) AS sxy,
   avg(pow(pow(x - mx, 2) - sx, 2)) + avg(pow(pow(y - my, 2) - sy, 2)) + 2 * avg(pow((x - mx) * (y - my) - sxy, 2)) AS pi FROM rr JOIN m1 USING (portfolio, every, pl) GROUP BY ALL),
 m3 AS (SELECT *, (sx + sy) / 2 AS tg, pow(sx - sy, 2) / 2 + 2 * sxy * sxy AS d2 FROM m2), m4 AS (SELECT *, CASE WHEN d2 < 1e-12 THEN 0 ELSE greatest(0, least(1, pi / n / d2)) END AS de FROM m3),
 m5 AS (SELECT portfolio, every, pl, ((1 - de) * sx + de * tg) * 252 AS a, (1 - de) * sxy * 252 AS b, ((1 - de) * sy + de * tg) * 252 AS c, (0.9 * mx + 0.1 * my) * 252 - 0.04 AS x1, (0.1 * mx + 0.9 * my) * 252 - 0.04 AS x2 FROM m4),
 m6 AS (SELECT *, unnest([0.4, 0.6, least(0.6, greatest(0.4, (c * x1 - b * x2) / (c * x1 - b * x2 + a * x2 - b * x1)))]::DOUBLE[]) AS w1 FROM m5),
 tw AS (SELECT portfolio, every, pl, 'sharpe' AS method, arg_max(w1, (w1 * x1 + (1 - w1) * x2) / sqrt(w1 * w1 * a + 2 * w1 * (1 - w1) * b + (1 - w1) * (1 - w1) * c)) AS w1 FROM m6 GROUP BY ALL UNION ALL
  SELECT portfolio, every, pl, 'parity', (1 / sqrt(a)) / (1 / sqrt(a) + 1 / sqrt(c)) FROM m5)"""
_ON = "list_transform([1, 2], lambda i: {})"
_GV, _NV = "list_dot_product(k.g, d.p)", "list_dot_product(k.n, d.p)"
_COST = "list_sum(" + _ON.format(f"abs(d.w[i] * {_NV} / d.p[i] - k.n[i]) * d.p[i]") + ")"
_TAX = "0.2 * list_sum(" + _ON.format(f"greatest(k.n[i] - d.w[i] * {_NV} / d.p[i], 0) * greatest(d.p[i] - k.b[i], 0)") + ")"


@query("krn_35_walk_forward_solved", f"""WITH RECURSIVE {C3}, {_PAIRS},
 dd AS (SELECT px.portfolio, e.every, q.method, px.place - start AS t, px.ts, [p1, p2] AS p, CASE WHEN w1 IS NOT NULL THEN [w1, 1 - w1] END AS w FROM px JOIN nd USING (portfolio), (VALUES (21), (63)) e(every), (VALUES ('sharpe'), ('parity')) q(method)
  LEFT JOIN tw ON tw.portfolio = px.portfolio AND tw.every = e.every AND tw.method = q.method AND tw.pl = px.place WHERE px.place >= start AND n - start >= 21),
 k AS (SELECT d.portfolio, d.every, d.method, d.t, {_ON.format('d.w[i] / d.p[i]')} AS g, {_ON.format('d.w[i] / d.p[i]')} AS n, d.p AS b, {_ON.format('d.w[i] / d.p[i]')} AS hold, 0.0::DOUBLE AS turnover, 0.0::DOUBLE AS tax FROM dd d WHERE t = 0 UNION ALL
  SELECT d.portfolio, d.every, d.method, d.t, CASE WHEN d.w IS NOT NULL THEN {_ON.format(f'd.w[i] * {_GV} / d.p[i]')} ELSE k.g END,
   CASE WHEN d.w IS NOT NULL THEN {_ON.format(f'd.w[i] * ({_NV} - {_COST} * 0.001 - {_TAX}) / d.p[i]')} ELSE k.n END,
   CASE WHEN d.w IS NOT NULL THEN {_ON.format(f'CASE WHEN d.w[i] * {_NV} / d.p[i] > k.n[i] THEN d.p[i] ELSE k.b[i] END')} ELSE k.b END, k.hold,
   CASE WHEN d.w IS NOT NULL THEN {_COST} / {_NV} ELSE 0 END, CASE WHEN d.w IS NOT NULL THEN {_TAX} ELSE 0 END
  FROM k JOIN dd d ON d.t = k.t + 1 AND d.portfolio = k.portfolio AND d.every = k.every AND d.method = k.method)
 SELECT portfolio, every, method, ts, {r('list_dot_product(g, p)', 'gross')}, {r('list_dot_product(n, p)', 'net')}, {r('list_dot_product(hold, p)', 'hold')}, {r('turnover', 'turnover')}, {r('tax', 'tax')} FROM k JOIN dd USING (portfolio, every, method, t)""")
def krn_35_solved(spark, sf):
    """The walk-forward of each two series: both methods solved again every 21 and 63 dates from the end of the burn-in; the SQL solves two assets in closed form."""
    walk = rebalance.walk_forward(_portfolios(spark, sf))
    return rounded(walk.where("length(portfolio) = 2").drop("cost"))


@query("krn_35_rebalances", f"""WITH {C3}, nd AS (SELECT count(DISTINCT ts) AS n, greatest(least(252, count(DISTINCT ts) - 22), 126) AS start FROM c3) SELECT portfolio, CAST(every AS INT) AS every, method, CAST(start + k * every AS INT) AS at, CAST(length(portfolio) AS BIGINT) AS names, 1.0::DOUBLE AS total, TRUE AS optimal
 FROM nd, (VALUES ('AN'), ('AR'), ('NR'), ('ANR')) p(portfolio), (VALUES (21), (63)) e(every), (VALUES ('sharpe'), ('parity')) q(method), range(0, 400) g(k) WHERE start + k * every < n AND n - start >= 21""")
def krn_35_rebalances(spark, sf):
    """Every rebalance of the four portfolios: all names have weights that add to 1 and meet the conditions of the optimum to 1e-8."""
    w = rebalance.solved_weights(rebalance.started(_portfolios(spark, sf), 252))
    g = w.groupBy("portfolio", "every", "method", "at").agg(F.count("*").alias("names"), F.round(F.sum("w"), 9).alias("total"), (F.max("residual") < 1e-8).alias("optimal"))
    return g.select("portfolio", "every", "method", F.col("at").cast("int").alias("at"), "names", "total", "optimal")


@query("krn_35_buy_and_hold", f"WITH {C3} SELECT ts, {r('avg(value / p0)', 'hold')} FROM c3 JOIN (SELECT series_id, arg_min(value, ts) AS p0 FROM c3 GROUP BY 1) USING (series_id) GROUP BY 1")
def krn_35_hold(spark, sf):
    """The book that never trades, which SQL can follow."""
    return rounded(_book(spark, sf).select("ts", "hold"))


@query("krn_36_curve_metrics", f"""WITH {C3}, v AS (SELECT series_id, ts, value, (value - lag(value) OVER w) / greatest(lag(value) OVER w, 1e-12) AS r, value / max(value) OVER w - 1 AS dd FROM c3 WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
 g AS (SELECT series_id, pow(arg_max(value, ts) / arg_min(value, ts), {portfolio.YEAR}.0 / count(r)) - 1 AS growth, stddev_samp(r) * {math.sqrt(portfolio.YEAR)} AS volatility, min(dd) AS max_drawdown FROM v GROUP BY 1)
 SELECT series_id, {r('growth', 'growth')}, {r('volatility', 'volatility')}, {r('(growth - 0.04) / volatility', 'sharpe')}, {r('max_drawdown', 'max_drawdown')} FROM g""")
def krn_36(spark, sf):
    return rounded(rebalance.curve_metrics(align.common_dates(series.daily_flags(spark, sf))))


@query("agg_22_exposure", "SELECT n_name AS sector, round(sum(CAST(s_acctbal AS DECIMAL(18,2))) * 100.0 / (SELECT sum(CAST(s_acctbal AS DECIMAL(18,2))) FROM supplier), 6) + 0.0 AS share FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def agg_22(spark, sf):
    s = series.table(spark, sf, "supplier").join(series.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    total = s.agg(F.sum(F.col("s_acctbal").cast("decimal(18,2)")).alias("total"))
    g = s.groupBy(F.col("n_name").alias("sector")).agg(F.sum(F.col("s_acctbal").cast("decimal(18,2)")).alias("v")).join(F.broadcast(total))
    return rounded(g.select("sector", (F.col("v").cast("double") * 100.0 / F.col("total").cast("double")).alias("share")))


_KINDS = ("click", "error", "purchase", "signup", "view")


@query("agg_23_pivot", "SELECT CAST(ts AS DATE) AS period, " + ", ".join(f"coalesce(CAST(sum(CASE WHEN event_type = '{k}' THEN CAST(value AS DECIMAL(18,2)) END) AS DOUBLE), 0) AS {k}" for k in _KINDS) + " FROM events GROUP BY 1")
def agg_23(spark, sf):
    e = series.table(spark, sf, "events")
    p = e.groupBy(F.col("ts").cast("date").alias("period")).pivot("event_type", list(_KINDS)).agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double"))
    return p.na.fill(0.0)


@query("agg_24_latest_two", """WITH y AS (SELECT o_orderpriority AS ticker, year(o_orderdate) AS period, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM orders GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY period DESC) AS rn FROM y)
 SELECT ticker, max(CASE WHEN rn = 1 THEN v END) AS latest, max(CASE WHEN rn = 2 THEN v END) AS previous FROM k WHERE rn <= 2 GROUP BY 1""")
def agg_24(spark, sf):
    o = series.table(spark, sf, "orders")
    y = o.groupBy(F.col("o_orderpriority").alias("ticker"), F.year("o_orderdate").alias("period")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("v"))
    k = y.withColumn("rn", F.row_number().over(W.partitionBy("ticker").orderBy(F.desc("period")))).where("rn <= 2")
    return k.groupBy("ticker").agg(F.max(F.when(F.col("rn") == 1, F.col("v"))).alias("latest"), F.max(F.when(F.col("rn") == 2, F.col("v"))).alias("previous"))


@query("agg_28_standard_errors", f"WITH {C3} SELECT series_id, {r('avg(r)', 'mean')}, {r('stddev_samp(r)', 'sd')}, {r('kurtosis_pop(r)', 'kurtosis')}, {r('avg(CASE WHEN abs(r) <= 0.1 THEN 1.0 ELSE 0 END)', 'inside')} FROM ret GROUP BY 1")
def agg_28(spark, sf):
    return rounded(_returns(spark, sf).groupBy("series_id").agg(
        F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.kurtosis("r").alias("kurtosis"), F.avg((F.abs("r") <= 0.1).cast("double")).alias("inside")))


@query("agg_32_usage", "SELECT CAST(ts AS DATE) AS day, event_type AS model, count(*) AS calls, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS cost FROM events GROUP BY ALL")
def agg_32(spark, sf):
    return series.table(spark, sf, "events").groupBy(F.col("ts").cast("date").alias("day"), F.col("event_type").alias("model")).agg(
        F.count("*").alias("calls"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("cost"))
