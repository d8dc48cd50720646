"""The comparison of a query's rows with those of its SQL."""

from __future__ import annotations

import datetime
import math
from decimal import Decimal
from pathlib import Path

import duckdb
import numpy as np


def plain(value):
    """A value in a form that compares alike from Spark and DuckDB; floats at 9 digits."""
    if value is None or isinstance(value, bool | np.bool_):
        return None if value is None else bool(value)
    if isinstance(value, float | np.floating | Decimal):
        value = float(value)
        return None if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, int | np.integer):
        return int(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return datetime.datetime(value.year, value.month, value.day).isoformat()
    if isinstance(value, list | tuple | np.ndarray):
        return tuple(plain(v) for v in value)
    return str(value)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(([plain(r[i]) for i in order] for r in values), key=repr)


def same(mine, theirs):
    """Whether two lists of rows agree, floats to nine digits or 1e-9."""
    if len(mine) != len(theirs):
        return False
    for a, b in zip(mine, theirs, strict=True):
        for x, y in zip(a, b, strict=True):
            if isinstance(x, float) and isinstance(y, int | float):
                if not math.isclose(x, y, rel_tol=1e-8, abs_tol=1e-9):
                    return False
            elif x != y:
                return False
    return True


def by_sql(sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    out = con.execute(sql)
    return rows([c[0] for c in out.description], out.fetchall())


def by_spark(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])
