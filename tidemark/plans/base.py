"""What registered queries share: rounding, and the series' SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """df with its doubles rounded, so that the order of sums does not show."""
    return df.select(*[(F.round(f"`{n}`", digits) + F.lit(0.0)).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


def r(expression: str, name: str, digits: int = DIGITS) -> str:
    return f"round(CAST({expression} AS DOUBLE), {digits}) + 0.0 AS {name}"


_LAST = "(SELECT max(last_day(CAST(o_orderdate AS DATE))) FROM orders)"
M1 = f"""m1 AS (SELECT 'orders' AS series_id, last_day(CAST(o_orderdate AS DATE)) AS ts, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value
  FROM orders WHERE last_day(CAST(o_orderdate AS DATE)) < {_LAST} GROUP BY 2)"""
M5 = f"""m5 AS (SELECT c_mktsegment AS series_id, last_day(CAST(o_orderdate AS DATE)) AS ts, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE last_day(CAST(o_orderdate AS DATE)) < {_LAST} GROUP BY 1, 2)"""
D3 = """d3 AS (SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS ts,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS value FROM lineitem GROUP BY 1, 2)"""
H5 = """h5 AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts,
  CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS value FROM events GROUP BY 1, 2)"""
#: Aligned D3 and its log returns.
C3 = D3 + """, c3 AS (SELECT * FROM d3 WHERE ts IN (SELECT ts FROM d3 GROUP BY ts HAVING count(DISTINCT series_id) = (SELECT count(DISTINCT series_id) FROM d3))),
 ret AS (SELECT series_id, ts, ln(value / lag(value) OVER (PARTITION BY series_id ORDER BY ts)) AS r FROM c3 QUALIFY r IS NOT NULL)"""
