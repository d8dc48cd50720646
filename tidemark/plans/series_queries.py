"""Queries on sources, returns, alignment, seasons and dates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions import calendar
from tidemark.operators import align, returns, seasonality, store, texts, trees, vintage
from tidemark.sources import series
from tidemark.sources.shared import settled
from tidemark.sources.series import table

from .base import D3, H5, M1, M5, r, rounded

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


OVER = "OVER (PARTITION BY series_id ORDER BY ts)"


@query("src_01_daily_close", """SELECT event_type AS series_id, CAST(ts AS DATE) AS ts, value FROM events WHERE value IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) = 1""")
def src_01(spark, sf):
    """The last value of each day: a daily close."""
    e = table(spark, sf, "events").where("value is not null")
    return e.groupBy(F.col("event_type").alias("series_id"), F.col("ts").cast("date").alias("day")).agg(
        F.max_by("value", F.struct("ts", "event_id")).alias("value")).withColumnRenamed("day", "ts")


@query("src_02_newest_observations", f"WITH {M5} SELECT series_id, ts, value FROM m5 QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) <= 12")
def src_02(spark, sf):
    """The newest 12 observations, values read from text, unreadable ones dropped."""
    text = series.monthly_segments(spark, sf).withColumn("value", F.col("value").cast("string"))
    return align.visible(text.withColumn("value", F.expr("try_cast(value as double)")).where("value is not null"), 12)


@query("src_03_metadata", """SELECT n_name AS series_id, r_name AS grouping, CASE WHEN r_name IS NULL THEN 'no metadata' END AS note
  FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 3""")
def src_03(spark, sf):
    """Metadata by a left join: what is missing is null with a note."""
    n, g = table(spark, sf, "nation"), table(spark, sf, "region").where("r_regionkey < 3")
    return n.join(g, F.col("n_regionkey") == F.col("r_regionkey"), "left").select(
        F.col("n_name").alias("series_id"), F.col("r_name").alias("grouping"), F.when(F.col("r_name").isNull(), "no metadata").alias("note"))


@query("src_04_preferred_label", """WITH x AS (SELECT p_brand, p_type, CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM part GROUP BY 1, 2),
  k AS (SELECT *, CASE WHEN p_type LIKE 'PROMO%' THEN 1 WHEN p_type LIKE 'SMALL%' THEN 2 ELSE 3 END AS pref FROM x)
  SELECT p_brand AS ticker, p_type AS label, round(abs(v) / 1e3, 6) + 0.0 AS value FROM k QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY pref, p_type) = 1""")
def src_04(spark, sf):
    """The first matching label of a preference list, in thousands."""
    x = table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.sum(F.col("p_retailprice").cast("decimal(18,2)")).cast("double").alias("v"))
    pref = F.when(F.col("p_type").like("PROMO%"), 1).when(F.col("p_type").like("SMALL%"), 2).otherwise(3)
    first = x.groupBy("p_brand").agg(F.min_by(F.struct("p_type", "v"), F.struct(pref, "p_type")).alias("x"))
    return rounded(first.select(F.col("p_brand").alias("ticker"), F.col("x.p_type").alias("label"), (F.abs("x.v") / 1e3).alias("value")))


@query("src_07_cache", """SELECT user_id AS key, event_id AS entry, ts AS cached_at, epoch(TIMESTAMP '2024-01-30 00:00:00') - epoch(date_trunc('second', ts)) < 604800 AS hit FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def src_07(spark, sf):
    """The newest cache entry of each key, and whether it is still valid."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("entry"), F.col("ts").alias("cached_at"))
    return store.fresh(e, "2024-01-30 00:00:00", 604_800)


@query("src_08_routing", """SELECT c_name AS id, coalesce(CASE WHEN c_custkey % 7 = 0 THEN 'equity' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'macro' END,
  CASE WHEN n_name IS NOT NULL THEN 'macro' END, 'equity') AS route FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey = 1""")
def src_08(spark, sf):
    """Where an id is looked up: the caller's word, then the catalog, then known metadata, else equity."""
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation").where("n_regionkey = 1").select("n_nationkey", "n_name")
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return j.select(F.col("c_name").alias("id"), F.coalesce(
        F.when(F.col("c_custkey") % 7 == 0, "equity"), F.when(F.col("c_mktsegment") == "BUILDING", "macro"), F.when(F.col("n_name").isNotNull(), "macro"), F.lit("equity")).alias("route"))


@query("src_09_candidates", """SELECT p_brand AS concept, p_partkey AS candidate, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS INT) AS place
  FROM part WHERE lower(p_type) LIKE '%economy%' QUALIFY place <= 5""")
def src_09(spark, sf):
    """The first five candidates of each concept."""
    w = W.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    p = table(spark, sf, "part").where(F.lower("p_type").contains("economy"))
    return p.select(F.col("p_brand").alias("concept"), F.col("p_partkey").alias("candidate"), F.row_number().over(w).alias("place")).where("place <= 5")


@query("src_12_selection", """WITH w AS (SELECT p_partkey, p_brand, p_type, p_retailprice, CASE WHEN p_size < 10 THEN 'short' WHEN p_type LIKE '%LARGE%' THEN 'topic' WHEN p_retailprice > 1500 THEN 'price' END AS why FROM part),
  o AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC, p_partkey) AS t FROM w WHERE why IS NULL QUALIFY t = 1)
  SELECT p_brand AS category, p_partkey AS id FROM o QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 5""")
def src_12(spark, sf):
    """Selection by popularity: excluded for the first reason that holds, one of each release, five of each category."""
    why = F.when(F.col("p_size") < 10, "short").when(F.col("p_type").contains("LARGE"), "topic").when(F.col("p_retailprice") > 1500, "price")
    p = table(spark, sf, "part").where(why.isNull())
    by = [F.desc("p_retailprice"), "p_partkey"]
    p = p.withColumn("t", F.row_number().over(W.partitionBy("p_brand", "p_type").orderBy(*by))).where("t = 1")
    p = p.withColumn("t", F.row_number().over(W.partitionBy("p_brand").orderBy(*by))).where("t <= 5")
    return p.select(F.col("p_brand").alias("category"), F.col("p_partkey").alias("id"))


@query("src_13_root", """WITH RECURSIVE t AS (SELECT c_custkey AS id, CASE WHEN c_custkey > 9 THEN c_custkey // 10 END AS parent FROM customer),
  up AS (SELECT id, id AS node, parent FROM t UNION ALL SELECT up.id, t.id, t.parent FROM up JOIN t ON up.parent = t.id)
  SELECT id, node AS root FROM up WHERE parent IS NULL""")
def src_13(spark, sf):
    """The root ancestor of each node of a tree (parent: the number without its last digit)."""
    t = table(spark, sf, "customer").selectExpr("c_custkey as id", "case when c_custkey > 9 then c_custkey div 10 end as parent")
    return trees.roots(t)


@query("prj_01_log_returns", f"WITH {D3} SELECT series_id, ts, {r(f'ln(value / lag(value) {OVER})', 'r')} FROM d3 QUALIFY lag(value) {OVER} IS NOT NULL")
def prj_01(spark, sf):
    return rounded(returns.log_returns(series.daily_flags(spark, sf)))


@query("prj_02_simple_returns", f"WITH {M5}, x AS (SELECT *, lag(value) {OVER} AS b FROM m5) SELECT series_id, ts, {r('(value - b) / greatest(b, 1e-12)', 'r')} FROM x WHERE b IS NOT NULL")
def prj_02(spark, sf):
    return rounded(returns.simple_returns(series.monthly_segments(spark, sf)))


def _shifted(spark, sf):
    """M5 with one segment brought under zero."""
    return series.monthly_segments(spark, sf).withColumn("value", F.when(F.col("series_id") == "BUILDING", F.col("value") - 9e6).otherwise(F.col("value")))


_SHIFT = M5 + ", s AS (SELECT series_id, ts, CASE WHEN series_id = 'BUILDING' THEN value - 9e6 ELSE value END AS value FROM m5)"


@query("prj_03_changes", f"""WITH {_SHIFT}, x AS (SELECT *, lag(value) {OVER} AS b, min(value) OVER (PARTITION BY series_id) > 0 AS pos FROM s)
  SELECT series_id, ts, {r('CASE WHEN pos THEN ln(CASE WHEN pos THEN value / b END) ELSE (value - b) / b END', 'r')} FROM x WHERE b IS NOT NULL AND b <> 0""")
def prj_03(spark, sf):
    return rounded(returns.stationary_changes(_shifted(spark, sf)))


@query("prj_04_differences", f"""WITH {_SHIFT}, x AS (SELECT series_id, ts, CASE WHEN pos THEN ln(CASE WHEN pos THEN value END) ELSE value END AS v FROM
  (SELECT *, min(value) OVER (PARTITION BY series_id) > 0 AS pos FROM s)) SELECT series_id, ts, {r(f'v - lag(v) {OVER}', 'd')} FROM x QUALIFY lag(v) {OVER} IS NOT NULL""")
def prj_04(spark, sf):
    return rounded(returns.model_differences(_shifted(spark, sf)))


@query("prj_06_base_100", f"WITH {M5} SELECT series_id, ts, {r(f'value / first_value(value) {OVER} * 100', 'value')} FROM m5")
def prj_06(spark, sf):
    return rounded(returns.base_100(series.monthly_segments(spark, sf)))


@query("prj_08_growth", f"""WITH {M5}, e AS (SELECT series_id, min(ts) AS a, max(ts) AS b, arg_min(value, ts) AS va, arg_max(value, ts) AS vb FROM m5 GROUP BY 1)
  SELECT series_id, {r("date_diff('day', a, b) / 365.25", 'years')}, {r("(pow(vb / va, 1 / (date_diff('day', a, b) / 365.25)) - 1) * 100", 'growth')} FROM e""")
def prj_08(spark, sf):
    """PRJ-08, PRJ-09: years between two dates and annual growth."""
    e = series.monthly_segments(spark, sf).groupBy("series_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.min_by("value", "ts").alias("va"), F.max_by("value", "ts").alias("vb"))
    years = calendar.projection_years(F.col("a"), F.col("b"))
    return rounded(e.select("series_id", years.alias("years"), calendar.annual_growth(F.col("va"), F.col("vb"), years).alias("growth")))


@query("prj_10_inertia", f"""WITH {M5}, x AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS k FROM m5 QUALIFY k <= 20),
  g AS (SELECT series_id, max(CASE WHEN k = 1 THEN value END) AS v1, max(CASE WHEN k = 10 THEN value END) AS v10, max(CASE WHEN k = 11 THEN value END) AS v11, max(CASE WHEN k = 20 THEN value END) AS v20 FROM x GROUP BY 1)
  SELECT series_id, {r('(v1 - v10) / v10', 'recent')}, {r('(v11 - v20) / v20', 'older')}, CASE WHEN abs((v1 - v10) / v10) < 0.01 THEN 'flat' WHEN v1 > v10 AND (v1 - v10) / v10 > (v11 - v20) / v20 THEN 'rising faster'
   WHEN v1 > v10 THEN 'rising' WHEN (v1 - v10) / v10 < (v11 - v20) / v20 THEN 'falling faster' ELSE 'falling' END AS label FROM g""")
def prj_10(spark, sf):
    """The last 20 points in halves: slopes and a label."""
    w = W.partitionBy("series_id").orderBy(F.desc("ts"))
    x = series.monthly_segments(spark, sf).withColumn("k", F.row_number().over(w)).where("k <= 20")
    v = {k: F.max(F.when(F.col("k") == k, F.col("value"))) for k in (1, 10, 11, 20)}
    g = x.groupBy("series_id").agg(((v[1] - v[10]) / v[10]).alias("recent"), ((v[11] - v[20]) / v[20]).alias("older"))
    a, b = F.col("recent"), F.col("older")
    label = F.when(F.abs(a) < 0.01, "flat").when((a > 0) & (a > b), "rising faster").when(a > 0, "rising").when(a < b, "falling faster").otherwise("falling")
    return rounded(g.withColumn("label", label))


@query("fil_02_visible", f"WITH {D3} SELECT series_id, ts, {r('value', 'value')} FROM d3 QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) <= 130")
def fil_02(spark, sf):
    return rounded(align.visible(series.daily_flags(spark, sf), 130))


@query("fil_02_visible_days", f"WITH {M5} SELECT series_id, ts, value FROM m5 QUALIFY ts >= max(ts) OVER (PARTITION BY series_id) - INTERVAL 731 DAY")
def fil_02_days(spark, sf):
    return align.visible(series.monthly_segments(spark, sf), 0, days=731)


@query("fil_05_excluded", f"WITH {D3}, n AS (SELECT series_id, count(*) AS n FROM d3 GROUP BY 1) SELECT series_id, n, CASE WHEN n < 1000 THEN 'too short' END AS reason FROM n")
def fil_05(spark, sf):
    """Series that do not enter, and why."""
    return series.daily_flags(spark, sf).groupBy("series_id").agg(F.count("*").alias("n")).withColumn("reason", F.when(F.col("n") < 1000, "too short"))


@query("fil_07_ids", "SELECT upper(trim(c_mktsegment)) AS id, CAST(min(c_custkey) AS BIGINT) AS first FROM customer GROUP BY 1")
def fil_07(spark, sf):
    """Ids trimmed, in upper case and once each, in the order they came."""
    return table(spark, sf, "customer").groupBy(F.upper(F.trim("c_mktsegment")).alias("id")).agg(F.min("c_custkey").alias("first"))


@query("fil_08_overlap", f"WITH {M1} SELECT ts, year(ts) * 12 + month(ts) - 1 + 12 >= 1998 * 12 AND year(ts) * 12 + month(ts) - 1 < 1999 * 12 AS touches FROM m1")
def fil_08(spark, sf):
    """Whether the twelve months after a date touch 1998."""
    m = F.year("ts") * 12 + F.month("ts") - 1
    return series.monthly_orders(spark, sf).select("ts", ((m + 12 >= 1998 * 12) & (m < 1999 * 12)).alias("touches"))


@query("join_01_common_dates", f"""WITH {D3} SELECT series_id, ts, {r('value', 'value')} FROM d3 WHERE ts IN (SELECT ts FROM d3 GROUP BY ts HAVING count(DISTINCT series_id) = 3)""")
def join_01(spark, sf):
    return rounded(align.common_dates(series.daily_flags(spark, sf)))


@query("join_02_keep_last", """SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS ts, arg_max(o_totalprice, o_orderkey) AS value FROM orders GROUP BY 1, 2""")
def join_02(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").cast("date").alias("ts"), F.col("o_totalprice").alias("value"), "o_orderkey")
    return align.keep_last(o, "o_orderkey")


@query("join_03_lower_frequency", f"""WITH {M1}, {D3}, x AS (SELECT * FROM m1 UNION ALL SELECT * FROM d3), m AS (SELECT series_id, last_day(ts) AS t, arg_max(value, ts) AS value FROM x GROUP BY 1, 2)
  SELECT series_id, t AS ts, {r('value', 'value')} FROM m WHERE t IN (SELECT t FROM m GROUP BY t HAVING count(DISTINCT series_id) = 4)""")
def join_03(spark, sf):
    both = series.monthly_orders(spark, sf).unionByName(series.daily_flags(spark, sf))
    return rounded(align.lower_to_months(settled(both)).select("series_id", "ts", "value"))


@query("join_04_side_by_side", f"""WITH {D3}, a AS (SELECT * FROM d3 WHERE series_id = 'A'), b AS (SELECT * FROM d3 WHERE series_id = 'N')
  SELECT coalesce(a.ts, b.ts) AS ts, {r('a.value', 'a')}, {r('b.value', 'b')} FROM a FULL JOIN b ON a.ts = b.ts ORDER BY 1 DESC LIMIT 250""")
def join_04(spark, sf):
    d = series.daily_flags(spark, sf)
    return rounded(align.side_by_side(d.where("series_id = 'A'"), d.where("series_id = 'N'")))


@query("join_05_year_before", f"""WITH {M5}, l AS (SELECT series_id, max(ts) AS last_ts, arg_max(value, ts) AS last_value FROM m5 GROUP BY 1),
  b AS (SELECT m5.series_id, max(ts) AS before_ts, arg_max(value, ts) AS before_value FROM m5 JOIN l USING (series_id) WHERE ts <= last_ts - INTERVAL 365 DAY GROUP BY 1)
  SELECT series_id, last_ts, {r('last_value', 'last_value')}, before_ts, {r('before_value', 'before_value')}, {r('last_value - before_value', 'change')}, {r('(last_value / before_value - 1) * 100', 'change_pct')} FROM l LEFT JOIN b USING (series_id)""")
def join_05(spark, sf):
    """JOIN-05, KRN-37: as-of a year before the last date."""
    return rounded(align.year_before(series.monthly_segments(spark, sf)))


def _vintages(spark, sf):
    """V1: each observation published on its date and revised 30 and 60 days later."""
    m = series.monthly_orders(spark, sf)
    return m.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select(
        "series_id", "ts", F.expr("date_add(ts, 30 * k)").alias("published"), (F.col("value") * (1 + F.col("k") * 0.001 * (F.month("ts") - 6))).alias("value"))


@query("join_08_vintages", f"""WITH {M1}, v AS (SELECT series_id, ts, CAST(ts + INTERVAL 1 DAY * (30 * k) AS DATE) AS published, value * (1 + k * CAST(0.001 AS DOUBLE) * (month(ts) - 6)) AS value FROM m1, (VALUES (0), (1), (2)) t(k)),
  c(cutoff) AS (VALUES (DATE '1997-06-30'), (DATE '1999-01-15')),
  k AS (SELECT series_id, cutoff, ts, arg_max(value, published) AS known FROM v JOIN c ON ts <= cutoff AND published <= cutoff GROUP BY ALL),
  e AS (SELECT series_id, ts, arg_min(value, published) AS first_release, arg_max(value, published) AS current FROM v GROUP BY ALL)
  SELECT series_id, ts, cutoff, {r('known', 'known', 4)}, {r('first_release', 'first_release', 4)}, {r('current', 'current', 4)} FROM k JOIN e USING (series_id, ts)""")
def join_08(spark, sf):
    """JOIN-08, SRC-11: what was known at a cutoff, the first release and today's value."""
    cutoffs = spark.sql("select explode(array(date'1997-06-30', date'1999-01-15')) as cutoff")
    return rounded(vintage.as_published(_vintages(spark, sf), cutoffs), 4)


@query("join_09_facts", """SELECT s_name AS entity, n_name AS fact, CASE WHEN n_name IS NULL THEN 'not found' ELSE 'found' END AS state FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey <> 2""")
def join_09(spark, sf):
    n = table(spark, sf, "nation").where("n_regionkey <> 2")
    return table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("s_name").alias("entity"), F.col("n_name").alias("fact"), F.when(F.col("n_name").isNull(), "not found").otherwise("found").alias("state"))


@query("join_10_membership", """SELECT o_orderkey AS item FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 49)""")
def join_10(spark, sf):
    li = table(spark, sf, "lineitem").where("l_quantity >= 49").select("l_orderkey")
    return table(spark, sf, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select(F.col("o_orderkey").alias("item"))


@query("join_11_counts", """SELECT c_custkey AS id, coalesce(o.n, 0) AS n_orders, coalesce(x.n, 0) AS n_events FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey
  LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) x ON user_id = c_custkey""")
def join_11(spark, sf):
    """Counts of two kinds of children, each aggregated before it is joined."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n_orders"))
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n_events"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id")).join(o, "id", "left").join(e, "id", "left").na.fill(0)


@query("join_12_grid", "SELECT c_mktsegment AS series_id, a.x AS margin, b.x AS least, c.x AS cutoffs FROM (SELECT DISTINCT c_mktsegment FROM customer), (VALUES (0.0::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE)) a(x), (VALUES (3), (5), (7)) b(x), (VALUES (8), (24)) c(x)")
def join_12(spark, sf):
    """A grid of parameters for every series."""
    a = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("series_id")).distinct()
    for name, values in (("margin", (0.0, 0.05, 0.1)), ("least", (3, 5, 7)), ("cutoffs", (8, 24))):
        a = a.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return a


@query("join_14_compare", f"""WITH {M1}, y AS (SELECT ts, CASE WHEN month(ts) = 6 THEN value * 1.0000001 ELSE value END AS value FROM m1 WHERE month(ts) <> 2)
  SELECT coalesce(m1.ts, y.ts) AS path, CASE WHEN y.ts IS NULL THEN 'missing' ELSE 'different' END AS what FROM m1 FULL JOIN y ON m1.ts = y.ts
  WHERE m1.ts IS NULL OR y.ts IS NULL OR abs(m1.value - y.value) > 1e-9 * greatest(1, abs(m1.value), abs(y.value))""")
def join_14(spark, sf):
    """Two results compared within a relative tolerance."""
    a = series.monthly_orders(spark, sf).select("ts", F.col("value").alias("a"))
    b = a.where(F.month("ts") != 2).select("ts", F.when(F.month("ts") == 6, F.col("a") * 1.0000001).otherwise(F.col("a")).alias("b"))
    j = a.join(b, "ts", "full_outer").where("a is null or b is null or abs(a - b) > 1e-9 * greatest(1D, abs(a), abs(b))")
    return j.select(F.col("ts").alias("path"), F.when(F.col("b").isNull(), "missing").otherwise("different").alias("what"))


@query("win_03_drawdown", f"""WITH {M5}, x AS (SELECT series_id, ts, ln(value / lag(value) {OVER}) AS r FROM m5 QUALIFY r IS NOT NULL), c AS (SELECT *, exp(sum(r) {OVER}) AS curve FROM x)
  SELECT series_id, ts, {r('r', 'r')}, {r('curve', 'curve')}, {r(f'curve / max(curve) {OVER} - 1', 'drawdown')} FROM c""")
def win_03(spark, sf):
    """WIN-02, WIN-03: wealth curve and drawdown."""
    return rounded(returns.wealth(returns.log_returns(series.monthly_segments(spark, sf))))


@query("win_04_equity_drawdown", f"WITH {M5} SELECT series_id, ts, {r(f'(value - greatest(max(value) {OVER}, 1e-12)) / greatest(max(value) {OVER}, 1e-12)', 'drawdown')} FROM m5")
def win_04(spark, sf):
    return rounded(returns.equity_drawdown(series.monthly_segments(spark, sf)))


_DIFF = M5 + f", d AS (SELECT series_id, ts, ln(value) - lag(ln(value)) {OVER} AS d FROM m5 QUALIFY d IS NOT NULL)"


@query("win_05_autocorrelation", f"""WITH {_DIFF}, x AS (SELECT series_id, ts, d - avg(d) OVER (PARTITION BY series_id) AS x, row_number() {OVER} AS k FROM d),
  s AS (SELECT series_id, sum(x * x) AS s0, count(*) AS n FROM x GROUP BY 1), p AS (SELECT a.series_id, CAST(a.k - b.k AS INT) AS lag, sum(a.x * b.x) AS s FROM x a JOIN x b ON a.series_id = b.series_id AND a.k - b.k BETWEEN 1 AND 12 GROUP BY ALL)
  SELECT series_id, lag, n, {r('s / s0', 'acf')} FROM p JOIN s USING (series_id)""")
def win_05(spark, sf):
    return rounded(seasonality.autocorrelation(returns.model_differences(series.monthly_segments(spark, sf)), 12))


@query("win_06_horizon_move", f"WITH {M5} SELECT series_id, {r('max(m)', 'max_move')} FROM (SELECT series_id, abs(ln(lead(value, 12) {OVER} / value)) AS m FROM m5) GROUP BY 1")
def win_06(spark, sf):
    return rounded(returns.horizon_move(series.monthly_segments(spark, sf), 12))


@query("win_08_rebalance_days", f"WITH {M5} SELECT series_id, ts, (row_number() {OVER} - 1) % 21 = 0 AND row_number() {OVER} > 1 AS flag FROM m5")
def win_08(spark, sf):
    k = F.row_number().over(series.by_series()) - 1
    return series.monthly_segments(spark, sf).select("series_id", "ts", ((k % 21 == 0) & (k > 0)).alias("flag"))


@query("win_09_frequency", f"""WITH {M1}, {D3}, x AS (SELECT * FROM m1 UNION ALL SELECT * FROM d3), g AS (SELECT series_id, date_diff('day', lag(ts) {OVER}, ts) AS gap FROM x)
  SELECT series_id, CAST(median(gap) AS DOUBLE) AS median_gap, count(*) AS n, CASE WHEN count(*) < 3 THEN 'irregular' WHEN median(gap) <= 4 THEN 'daily' WHEN median(gap) BETWEEN 5 AND 10 THEN 'weekly' WHEN median(gap) BETWEEN 25 AND 35 THEN 'monthly'
   WHEN median(gap) BETWEEN 80 AND 100 THEN 'quarterly' WHEN median(gap) BETWEEN 350 AND 380 THEN 'annual' ELSE 'irregular' END AS frequency FROM g GROUP BY 1""")
def win_09(spark, sf):
    """WIN-09, DAT-04: frequency from the median gap."""
    return align.frequency(series.monthly_orders(spark, sf).unionByName(series.daily_flags(spark, sf)))


@query("win_14_jump", f"""WITH {_DIFF}, k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS rn FROM d), m AS (SELECT series_id, median(d) AS mid FROM k WHERE rn > 1 GROUP BY 1),
  s AS (SELECT series_id, 1.4826 * median(abs(d - mid)) AS scale FROM k JOIN m USING (series_id) WHERE rn > 1 GROUP BY 1)
  SELECT series_id, {r('d', 'last_step')}, {r('scale', 'scale')}, abs(d) > 4 * scale AS jump FROM k JOIN s USING (series_id) WHERE rn = 1""")
def win_14(spark, sf):
    return rounded(returns.jump_flag(series.monthly_segments(spark, sf)))


@query("win_15_top_moves", f"""WITH {_DIFF}, x AS (SELECT *, lead(ts) {OVER} AS next_ts FROM d) SELECT series_id, ts, {r('d', 'd')}, next_ts,
  CAST(row_number() OVER (PARTITION BY series_id ORDER BY round(abs(d), 9) DESC, ts) AS INT) AS place FROM x QUALIFY place <= 5""")
def win_15(spark, sf):
    return rounded(returns.top_moves(series.monthly_segments(spark, sf)))


@query("krn_06_seasonal_test", f"""WITH {M1}, s AS (SELECT series_id, ts, value * (1 + CAST(0.2 AS DOUBLE) * sin(2 * pi() * month(ts) / 12)) AS value FROM m1), d AS (SELECT series_id, ts, ln(value) - lag(ln(value)) {OVER} AS d FROM s QUALIFY d IS NOT NULL),
  x AS (SELECT d - avg(d) OVER () AS x, row_number() OVER (ORDER BY ts) AS k FROM d), s0 AS (SELECT sum(x * x) AS s0, count(*) AS n FROM x),
  a AS (SELECT a.k - b.k AS lag, sum(a.x * b.x) / max(s0) AS acf, max(n) AS n FROM x a JOIN x b ON a.k - b.k BETWEEN 1 AND 12, s0 GROUP BY 1)
  SELECT 'orders' AS series_id, 'monthly' AS frequency, 12 AS period, {r('max(CASE WHEN lag = 12 THEN acf END)', 'acf_at_period')}, {r('1.645 * sqrt((1 + 2 * sum(CASE WHEN lag < 12 THEN acf * acf ELSE 0 END)) / max(n))', 'threshold')},
  max(CASE WHEN lag = 12 THEN acf END) > 1.645 * sqrt((1 + 2 * sum(CASE WHEN lag < 12 THEN acf * acf ELSE 0 END)) / max(n)) AND max(n) >= 36 AS is_seasonal FROM a""")
def krn_06(spark, sf):
    s1 = series.monthly_orders(spark, sf).withColumn("value", F.col("value") * (1 + 0.2 * F.sin(2 * F.pi() * F.month("ts") / 12)))
    return rounded(seasonality.seasonal_test(s1))


@query("agg_05_seasonal_scale", f"WITH {M5} SELECT series_id, {r('avg(d)', 'scale')} FROM (SELECT series_id, abs(value - lag(value, 12) {OVER}) AS d FROM m5) GROUP BY 1")
def agg_05(spark, sf):
    return rounded(seasonality.seasonal_scale(series.monthly_segments(spark, sf), 12))


@query("set_01_dates", f"""WITH {D3}, a AS (SELECT DISTINCT ts FROM d3 WHERE series_id = 'A'), b AS (SELECT DISTINCT ts FROM d3 WHERE series_id = 'N')
  SELECT coalesce(a.ts, b.ts) AS ts, CASE WHEN a.ts IS NULL THEN 'right' WHEN b.ts IS NULL THEN 'left' ELSE 'both' END AS side FROM a FULL JOIN b ON a.ts = b.ts""")
def set_01(spark, sf):
    """SET-01 to SET-04: union, intersection and differences of date keys."""
    d = series.daily_flags(spark, sf)
    return align.date_sets(d.where("series_id = 'A'"), d.where("series_id = 'N'"))


@query("set_02_symmetric_difference", f"""WITH {H5}, a AS (SELECT ts FROM h5 WHERE series_id = 'click'), b AS (SELECT ts FROM h5 WHERE series_id = 'purchase') (SELECT ts FROM a EXCEPT SELECT ts FROM b) UNION (SELECT ts FROM b EXCEPT SELECT ts FROM a)""")
def set_02(spark, sf):
    h = series.hourly_events(spark, sf)
    a, b = h.where("series_id = 'click'").select("ts"), h.where("series_id = 'purchase'").select("ts")
    return a.subtract(b).union(b.subtract(a))


@query("set_05_pool", f"WITH {M5}, {M1} SELECT * FROM m5 UNION ALL SELECT * FROM m1")
def set_05(spark, sf):
    return series.monthly_segments(spark, sf).unionByName(series.monthly_orders(spark, sf))


@query("str_02_redaction", r"""SELECT event_id, regexp_replace(regexp_replace('u?token=' || CAST(user_id AS VARCHAR) || '&k=' || md5(props), '((?:api_key|apikey|token|secret)=)[^&\s]+', '\1***', 'g'), '\b[0-9a-f]{32,}\b', '***', 'g') AS text FROM events""")
def str_02(spark, sf):
    e = table(spark, sf, "events")
    text = F.concat(F.lit("u?token="), F.col("user_id").cast("string"), F.lit("&k="), F.md5("props"))
    return e.select("event_id", texts.redacted(text).alias("text"))


_CLAIM = "CASE p_size % 4 WHEN 0 THEN p_name || ' 2x fund' WHEN 1 THEN 'inverse 1,5x ' || p_name WHEN 2 THEN p_name || ' bear' ELSE p_name END"


@query("str_03_claims", rf"""WITH x AS (SELECT p_partkey AS id, {_CLAIM} AS t, p_size FROM part),
  y AS (SELECT id, p_size, CAST(nullif(replace(regexp_extract(lower(t), '(?:^|[^0-9a-z.,])([0-9]{{1,2}}(?:[.,][0-9])?)x(?:[^a-z]|$)', 1), ',', '.'), '') AS DOUBLE) AS said, regexp_matches(lower(t), '\b(inverse|short|bear)\b') AS inv FROM x),
  z AS (SELECT *, p_size % 5 <> 0 AS found, CASE WHEN p_size % 3 = 0 THEN 2.0::DOUBLE END AS fact, p_size % 2 = 1 AS is_inv FROM y)
  SELECT id, said, inv AS says_inverse, array_to_string(list_filter([CASE WHEN NOT found THEN 'not_found' END, CASE WHEN found AND said <> fact THEN 'other_leverage' END, CASE WHEN found AND said IS NOT NULL AND fact IS NULL THEN 'not_leveraged' END,
   CASE WHEN found AND inv AND NOT is_inv THEN 'not_inverse' END, CASE WHEN found AND NOT inv AND is_inv THEN 'inverse_unsaid' END], lambda v: v IS NOT NULL), ',') AS problems FROM z""")
def str_03(spark, sf):
    """STR-03 to STR-05: leverage and direction that a name claims, against the facts."""
    t = F.when(F.col("p_size") % 4 == 0, F.concat("p_name", F.lit(" 2x fund"))).when(F.col("p_size") % 4 == 1, F.concat(F.lit("inverse 1,5x "), "p_name")).when(
        F.col("p_size") % 4 == 2, F.concat("p_name", F.lit(" bear"))).otherwise(F.col("p_name"))
    x = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_size", texts.leverage(t).alias("said"), texts.says_inverse(t).alias("says_inverse"))
    found = texts.problems(F.col("said"), F.when(F.col("p_size") % 3 == 0, 2.0), F.col("says_inverse"), F.col("p_size") % 2 == 1, F.col("p_size") % 5 != 0)
    return x.select("id", "said", "says_inverse", F.array_join(found, ",").alias("problems"))


_THEMES = "CASE " + " ".join("WHEN " + " OR ".join(f"t LIKE '% {w} %'" for w in words) + f" THEN '{theme}'" for theme, words in texts.THEMES) + " ELSE 'general' END"


@query("str_07_router", f"SELECT conv_id, turn, {_THEMES} AS theme FROM (SELECT conv_id, turn, ' ' || lower(coalesce(text, '')) || ' ' AS t FROM conversations)")
def str_07(spark, sf):
    """The first theme whose word is in a turn of a conversation; str_07_rules has stored rules."""
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", texts.theme(F.coalesce("text", F.lit(""))).alias("theme"))


@query("str_08_failures", """WITH x AS (SELECT event_id, CAST(floor(value) AS INT) AS status, lower(event_type || ' ' || props) AS m FROM events)
 SELECT event_id, CASE WHEN status = 429 OR m LIKE '%rate limit%' OR m LIKE '%quota%' THEN 'quota' WHEN status IN (401, 403) THEN 'auth' WHEN status >= 500 THEN 'server' WHEN m LIKE '%timeout%' OR m LIKE '%timed out%' THEN 'timeout' ELSE 'other' END AS kind FROM x""")
def str_08(spark, sf):
    """The kind of each event read as a failure: its value as the status, its type and properties as the message."""
    e = table(spark, sf, "events")
    return e.select("event_id", texts.failure_kind(F.floor("value").cast("int"), F.concat_ws(" ", "event_type", "props")).alias("kind"))


@query("str_11_rpartition", "SELECT DISTINCT n_name || '_x_' || CAST(n_regionkey AS VARCHAR) AS key, n_name || '_x' AS ticker, CAST(n_regionkey AS VARCHAR) AS period FROM nation")
def str_11(spark, sf):
    k = F.concat("n_name", F.lit("_x_"), F.col("n_regionkey").cast("string"))
    x = table(spark, sf, "nation").select(k.alias("key")).distinct()
    period = F.substring_index("key", "_", -1)
    return x.select("key", F.expr("substring(key, 1, length(key) - length(substring_index(key, '_', -1)) - 1)").alias("ticker"), period.alias("period"))


@query("dat_01_business_days", f"""WITH {M5}, l AS (SELECT series_id, max(ts) AS t FROM m5 GROUP BY 1), x AS (SELECT series_id, CAST(t + INTERVAL 1 DAY * k AS DATE) AS ts FROM l, range(1, 100) q(k))
  SELECT series_id, CAST(row_number() {OVER} AS INT) AS h, ts FROM x WHERE isodow(ts) < 6 QUALIFY h <= 60""")
def dat_01(spark, sf):
    last = series.monthly_segments(spark, sf).groupBy("series_id").agg(F.max("ts").alias("ts"))
    return calendar.business_days(last, 60)


@query("dat_03_months", f"""WITH {M5}, l AS (SELECT series_id, max(ts) AS t FROM m5 GROUP BY 1), x AS (SELECT series_id, CAST(k AS INT) AS h, t, year(t) * 12 + month(t) - 1 + k AS m FROM l, range(1, 25) q(k))
  SELECT series_id, h, make_date(CAST(m // 12 AS INT), CAST(m % 12 + 1 AS INT), least(day(t), 28)) AS ts FROM x""")
def dat_03(spark, sf):
    last = series.monthly_segments(spark, sf).groupBy("series_id").agg(F.max("ts").alias("ts"))
    return calendar.months_ahead(last, 24)


_PERIODS = {"daily": "o_orderdate", "weekly": "date_trunc('week', o_orderdate)", "monthly": "date_trunc('month', o_orderdate)", "quarterly": "date_trunc('quarter', o_orderdate)", "annual": "date_trunc('year', o_orderdate)"}


@query("dat_05_horizons", f"""WITH p AS ({' UNION ALL '.join(f"SELECT DISTINCT o_orderpriority || ' {k}' AS series_id, CAST({v} AS DATE) AS ts FROM orders" for k, v in _PERIODS.items())}), g AS (SELECT series_id, count(*) AS n, median(gap) AS g FROM (SELECT series_id, date_diff('day', lag(ts) OVER (PARTITION BY series_id ORDER BY ts), ts) AS gap FROM p) GROUP BY 1),
 f AS (SELECT series_id, CASE WHEN n < 3 THEN 'irregular' WHEN g <= 4 THEN 'daily' WHEN g BETWEEN 5 AND 10 THEN 'weekly' WHEN g BETWEEN 25 AND 35 THEN 'monthly' WHEN g BETWEEN 80 AND 100 THEN 'quarterly' WHEN g BETWEEN 350 AND 380 THEN 'annual' ELSE 'irregular' END AS f FROM g)
 SELECT series_id, f, h, y, n, CAST(h AS VARCHAR) || ' ' || u || CASE WHEN h = 1 THEN '' ELSE 's' END AS label FROM f JOIN (VALUES ('daily', 60, 252, 186, 'day'), ('weekly', 13, 52, 49, 'week'), ('monthly', 12, 12, 48, 'month'), ('quarterly', 4, 4, 40, 'quarter'), ('annual', 2, 1, 38, 'year'), ('irregular', 60, 252, 186, 'day')) t(f, h, y, n, u) USING (f)""")
def dat_05(spark, sf):
    """DAT-05, KRN-17, STR-10: order dates by priority and period as series: the frequency found from their gaps, its horizon, steps a year, least history and label."""
    o = table(spark, sf, "orders")
    kinds = F.array(*[F.struct(F.lit(k).alias("k"), F.expr(v).cast("date").alias("ts")) for k, v in _PERIODS.items()])
    p = o.select("o_orderpriority", F.explode(kinds).alias("x")).select(F.concat_ws(" ", "o_orderpriority", "x.k").alias("series_id"), "x.ts").distinct()
    x = align.frequency(p).select("series_id", F.col("frequency").alias("f"))
    h = calendar.horizon(F.col("f"))
    return x.select("series_id", "f", h.alias("h"), calendar.per_year(F.col("f")).alias("y"), calendar.least_history(h).alias("n"), calendar.horizon_label(h, F.col("f")).alias("label"))


@query("mut_01_current", """WITH l AS (SELECT user_id AS id, event_id AS version, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, value FROM events)
  SELECT id, version, value FROM l QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1 AND op <> 'delete'""")
def mut_01(spark, sf):
    """MUT-01, MUT-03: the live rows of a log of changes."""
    log = table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("version"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), "value")
    return store.current(log)


@query("jsn_01_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def jsn_01(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("krn_16_stale", """SELECT o_orderkey AS series_id, o_orderkey % 12 < 10 OR date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') > 30 OR o_totalprice >= 200000 AS stale FROM orders""")
def krn_16(spark, sf):
    d = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("series_id"), (F.col("o_orderkey") % 12).alias("version"), F.col("o_orderdate").cast("date").alias("evaluated_at"),
        F.col("o_totalprice").alias("n_now"), F.lit(200000.0 / 1.2).alias("n_then"))
    return store.stale(d, "2001-08-01").select("series_id", "stale")
