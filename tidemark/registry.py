"""All registered queries and their SQL."""

from __future__ import annotations

from .plans import decision_queries, forecast_queries, portfolio_queries, report_queries, series_queries

_PARTS = (forecast_queries, decision_queries, series_queries, portfolio_queries, report_queries)
QUERIES: dict = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
SQL: dict = {k: v for p in _PARTS for k, v in p.SQL.items()}


def flagship(spark, sf_dir):
    return forecast_queries.flagship(spark, sf_dir)
