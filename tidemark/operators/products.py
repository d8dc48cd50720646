"""Sums of products of each two series, by blocks of dates and series.

A task takes the rows of one block of dates for two blocks of series as two matrices and
multiplies them; partial sums of the same two series are added by Spark. A row goes to as
many tasks as there are blocks of series, not to every other series of its date.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sums over the dates on which both series have a value: x is of i, y of j.
SUMS = ("n", "x", "y", "xy", "xx", "yy", "xxy", "xyy", "xxyy")


def pair_products(returns: DataFrame, by: tuple[str, ...] = (), days: int = 128, blocks: int = 8) -> DataFrame:
    """(by..., i, j, n, x, y, xy, xx, yy, xxy, xyy, xxyy) of each two series i <= j with a common date.

    returns(by..., series_id, ts, r), at most one row for a series and date; null and NaN
    returns are none. A block of dates is `days` long, series are dealt to `blocks` by hash;
    a task holds one block of dates of a share 2 / blocks of the series.
    """
    own = [F.col(b) for b in by]
    rows = returns.where(F.col("r").isNotNull() & ~F.isnan("r")).select(
        *own, "series_id", F.col("ts").cast("timestamp").alias("ts"), F.col("r").cast("double").alias("r"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (days * 86_400_000_000)).alias("_span"),
        F.pmod(F.xxhash64("series_id"), F.lit(blocks)).cast("int").alias("_own"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.select(*own, "series_id", "ts", "r", "_span", "_own", F.least("_own", "_other").alias("_a"), F.greatest("_own", "_other").alias("_b"))
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in returns.select(*by).schema], "i string, j string, n long", *[f"{s} double" for s in SUMS[1:]]])

    def matrices(pdf: pd.DataFrame, days_of: pd.Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        names, at = np.unique(pdf["series_id"].to_numpy(dtype=object).astype(str), return_inverse=True)
        values, there = np.zeros((len(days_of), len(names))), np.zeros((len(days_of), len(names)))
        day = days_of.get_indexer(pdf["ts"])
        values[day, at], there[day, at] = pdf["r"].to_numpy(), 1.0
        return names, values, there

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = int(pdf["_a"].iloc[0]), int(pdf["_b"].iloc[0])
        days_of = pd.Index(pdf["ts"].unique())
        left, x, mx = matrices(pdf[pdf["_own"] == a], days_of)
        right, y, my = (left, x, mx) if a == b else matrices(pdf[pdf["_own"] == b], days_of)
        sums = dict(zip(SUMS, (mx.T @ my, x.T @ my, mx.T @ y, x.T @ y, (x * x).T @ my, mx.T @ (y * y), (x * x).T @ y, x.T @ (y * y), (x * x).T @ (y * y)), strict=True))
        p, q = np.nonzero(sums["n"] > 0) if a != b else np.nonzero(np.triu(sums["n"]) > 0)
        i, j = left[p], right[q]
        turn = i > j  # i is the lesser name
        flat = {s: m[p, q] for s, m in sums.items()}
        mirrored = {"x": "y", "y": "x", "xx": "yy", "yy": "xx", "xxy": "xyy", "xyy": "xxy"}
        out = {"i": np.where(turn, j, i), "j": np.where(turn, i, j), **{s: np.where(turn, flat[mirrored.get(s, s)], v) for s, v in flat.items()}}
        out["n"] = out["n"].astype(np.int64)
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in by}, **out}, columns=[*by, "i", "j", *SUMS])

    keys = [*by, "_span", "_a", "_b"]
    parts = rows.groupBy(*keys).applyInPandas(run, schema)
    return parts.groupBy(*by, "i", "j").agg(*[F.sum(s).alias(s) for s in SUMS])


def _mean(s: str) -> Column:
    return F.col(s) / F.col("n")


def correlation() -> Column:
    """Pearson's coefficient from the sums; null where a side does not vary."""
    vx, vy = (F.greatest(_mean(f"{s}{s}") - _mean(s) * _mean(s), F.lit(0.0)) for s in "xy")
    flat = (vx <= 1e-15 * _mean("xx")) | (vy <= 1e-15 * _mean("yy"))
    c = (_mean("xy") - _mean("x") * _mean("y")) / F.sqrt(vx * vy)
    return F.when(~flat, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def covariance() -> Column:
    """The sample covariance from the sums; null for one date."""
    return F.when(F.col("n") > 1, (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / (F.col("n") - 1))


def product_variance() -> Column:
    """The mean of ((x - mean x) (y - mean y) - covariance)^2, multiplied out."""
    mx, my, s = _mean("x"), _mean("y"), covariance()
    fourth = (
        _mean("xxyy") - 2 * my * _mean("xxy") - 2 * mx * _mean("xyy") + my * my * _mean("xx") + mx * mx * _mean("yy")
        + 4 * mx * my * _mean("xy") - 3 * mx * mx * my * my
    )
    return fourth - 2 * s * (_mean("xy") - mx * my) + s * s
