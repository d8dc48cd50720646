"""Damped Holt smoothing: the filter as a fold over a series, forecasts with analytic intervals, a bounded fit."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Start of the fit and fallback: smoothing of level and trend, damping.
DEFAULT = (0.3, 0.1, 0.95)


def training_arrays(points: DataFrame) -> DataFrame:
    """series_id, last_ts, n, use_log, y: the values in order, as logs if all are positive."""
    rows = points.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("ts", "value"))).alias("p"), F.min("value").alias("least"), F.max("ts").alias("last_ts"))
    values = F.transform("p", lambda p: p["value"])
    return rows.select("series_id", "last_ts", F.size("p").alias("n"), (F.col("least") > 0).alias("use_log"),
                       F.when(F.col("least") > 0, F.transform(values, lambda v: F.ln(v))).otherwise(values).alias("y"), (F.col("least") < 0).alias("has_negative"))


def smooth(y: Column, alpha, beta, phi, clip: Column | None = None, clip_level: bool = True) -> Column:
    """The filter's state after a series: struct(l, b, sse, n). clip: errors beyond it are drawn in (the robust variant), with clip_level=False for the trend alone."""
    alpha, beta, phi = (F.lit(float(v)) if isinstance(v, float | int) else v for v in (alpha, beta, phi))
    start = F.struct(F.element_at(y, 1).alias("l"), (F.element_at(y, 2) - F.element_at(y, 1)).alias("b"), F.lit(0.0).alias("sse"), F.lit(0).alias("n"))

    def step(s, v):
        guess = s["l"] + phi * s["b"]
        e = v - guess
        used = e if clip is None else F.greatest(F.least(e, clip), -clip)
        return F.struct((guess + alpha * (used if clip_level else e)).alias("l"), (phi * s["b"] + alpha * beta * used).alias("b"), (s["sse"] + e * e).alias("sse"), (s["n"] + 1).alias("n"))

    return F.aggregate(F.slice(y, F.lit(2), F.size(y)), start, step)


def forecast(fitted: DataFrame, horizon: int, level: float = 0.95) -> DataFrame:
    """Steps 1 to horizon from fitted(series_id, use_log, has_negative, state, alpha, beta, phi): h, value, lower, upper.

    The variance of step h adds the squared weights of the errors on the way; logs give a
    lognormal mean and bounds; otherwise the lower bound is not under zero unless the
    series went there.
    """
    z = NormalDist().inv_cdf((1 + level) / 2)
    s2 = F.when((F.col("state.n") > 1) & (F.col("state.sse") > 0), F.col("state.sse") / F.col("state.n")).otherwise(1e-4)
    h = fitted.withColumn("s2", s2).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    damp = F.expr("phi * (1 - pow(phi, h)) / (1 - phi)")
    # the weight of an error j steps back is alpha + alpha beta (phi + ... + phi^j)
    weights = F.expr("aggregate(filter(sequence(0, h - 1), j -> j > 0), 0D, (s, j) -> s + pow(alpha + alpha * beta * phi * (1 - pow(phi, j)) / (1 - phi), 2))")
    h = h.withColumns({"mu": F.col("state.l") + damp * F.col("state.b"), "var": F.col("s2") * (1 + weights)})
    sd = F.sqrt("var")
    return h.select(
        "series_id", "h",
        F.when(F.col("use_log"), F.exp(F.col("mu") + F.col("var") / 2)).otherwise(F.col("mu")).alias("value"),
        F.when(F.col("use_log"), F.exp(F.col("mu") - z * sd)).when(F.col("has_negative"), F.col("mu") - z * sd).otherwise(F.greatest(F.col("mu") - z * sd, F.lit(0.0))).alias("lower"),
        F.when(F.col("use_log"), F.exp(F.col("mu") + z * sd)).otherwise(F.col("mu") + z * sd).alias("upper"),
        *[c for c in fitted.columns if c in ("cutoff", "engine", "last_ts")],
    )


def with_parameters(series: DataFrame, alpha: float = DEFAULT[0], beta: float = DEFAULT[1], phi: float = DEFAULT[2]) -> DataFrame:
    return series.withColumns({"alpha": F.lit(alpha), "beta": F.lit(beta), "phi": F.lit(phi), "state": smooth(F.col("y"), alpha, beta, phi)})


def grid_fit(series: DataFrame, alphas: tuple[float, ...], betas: tuple[float, ...], phis: tuple[float, ...]) -> DataFrame:
    """series with the alpha, beta, phi and sse of least squared error among the combinations of a small grid: the filter's fold for each, in one row."""
    errors = [F.struct(smooth(F.col("y"), a, b, f)["sse"].alias("sse"), *[F.lit(v).alias(n) for n, v in (("alpha", a), ("beta", b), ("phi", f))])
              for a in alphas for b in betas for f in phis]
    return series.withColumn("best", F.array_min(F.array(*errors))).select(*series.columns, "best.*")


def _sse(y: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Squared error of one series for many (alpha, beta, phi) at once."""
    a, b, f = p.T
    level, trend, out = np.full(len(p), y[0]), np.full(len(p), y[1] - y[0]), np.zeros(len(p))
    for v in y[1:]:
        guess = level + f * trend
        e = v - guess
        level, trend = guess + a * e, f * trend + a * b * e
        out += e * e
    return out


def fit(series: DataFrame, rounds: int = 6) -> DataFrame:
    """alpha, beta and phi of least squared error for each series, within [0.01, 0.99], [0.01, 0.99] and [0.80, 0.98].

    A grid of candidates goes through the filter together and closes in on the best; the
    start is always among them, so the error is never above its.
    """
    low, high = np.array([0.01, 0.01, 0.80]), np.array([0.99, 0.99, 0.98])

    def best(y: np.ndarray) -> np.ndarray:
        if len(y) < 3:
            return np.array(DEFAULT)
        at, span = np.array(DEFAULT), (high - low) / 2
        for k in range(rounds):
            grid = np.stack(np.meshgrid(*[np.linspace(-1, 1, 9 if k == 0 else 5)] * 3), -1).reshape(-1, 3)
            middle = (low + high) / 2 if k == 0 else at
            cand = np.vstack([at, np.clip(middle + grid * span, low, high)])
            at = cand[np.argmin(_sse(y, cand))]
            span = span / 3
        return at

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            p = np.array([best(np.asarray(y, dtype=float)) for y in pdf["y"]]).reshape(len(pdf), 3)
            yield pdf[["series_id"]].assign(alpha=p[:, 0], beta=p[:, 1], phi=p[:, 2])

    found = series.select("series_id", "y").mapInPandas(run, "series_id string, alpha double, beta double, phi double")
    joined = series.join(found, "series_id")
    return joined.withColumn("state", smooth(F.col("y"), F.col("alpha"), F.col("beta"), F.col("phi")))


def robust_scale(series: DataFrame) -> DataFrame:
    """1.4826 times the median absolute deviation of the steps of y."""
    w = W.partitionBy("series_id").orderBy("k")
    d = series.select("series_id", F.posexplode("y").alias("k", "y")).withColumn("d", F.col("y") - F.lag("y").over(w)).where("d is not null")
    d = d.join(d.groupBy("series_id").agg(F.median("d").alias("m")), "series_id")
    return d.groupBy("series_id").agg((1.4826 * F.median(F.abs(F.col("d") - F.col("m")))).alias("scale"))


def _season_fold(y: Column, start: Column, alpha, beta, gamma, phi, m: int) -> Column:
    """The state struct(l, b, s, sse, n) after a series, from a start struct(l, b, s); s begins with the season of the point to come."""
    begin = F.struct(start["l"].alias("l"), start["b"].alias("b"), start["s"].alias("s"), F.lit(0.0).alias("sse"), F.lit(0).alias("n"))

    def step(c, v):
        guess = c["l"] + phi * c["b"]
        e = v - guess - F.element_at(c["s"], 1)
        season = F.concat(F.slice(c["s"], 2, m - 1), F.array(F.element_at(c["s"], 1) + gamma * e))
        return F.struct((guess + alpha * e).alias("l"), (phi * c["b"] + beta * e).alias("b"), season.alias("s"), (c["sse"] + e * e).alias("sse"), (c["n"] + 1).alias("n"))

    return F.aggregate(y, begin, step)


def with_season(series: DataFrame, alpha: float, beta: float, gamma: float, phi: float, m: int) -> DataFrame:
    """series with the state of the damped trend with an additive season of m: struct(l, b, s, sse, n).

    The start is the first season's mean, the mean step to the second season, and the first
    season's deviations; series of fewer than two seasons give no rows.
    """
    y = F.col("y")

    def mean(first: int) -> Column:
        return F.aggregate(F.slice(y, first, m), F.lit(0.0), lambda a, v: a + v) / m

    begun = series.where(F.size("y") >= 2 * m).withColumns({"m1": mean(1), "m2": mean(m + 1)})
    start = F.struct(F.col("m1").alias("l"), ((F.col("m2") - F.col("m1")) / m).alias("b"), F.transform(F.slice(y, 1, m), lambda v: v - F.col("m1")).alias("s"))
    return begun.withColumns({"state": _season_fold(y, start, alpha, beta, gamma, phi, m), "alpha": F.lit(alpha), "beta": F.lit(beta), "gamma": F.lit(gamma), "phi": F.lit(phi)}).drop("m1", "m2")


def seasonal_forecast(fitted: DataFrame, horizon: int, m: int, level: float = 0.95) -> DataFrame:
    """Steps 1 to horizon of with_season(): value, lower and upper by the exact variance; logs give the lognormal mean."""
    z = NormalDist().inv_cdf((1 + level) / 2)
    h = fitted.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    weights = F.expr(f"aggregate(filter(sequence(0, h - 1), j -> j > 0), 0D, (t, j) -> t + pow(alpha + beta * phi * (1 - pow(phi, j)) / (1 - phi) + if(j % {m} = 0, gamma, 0D), 2))")
    mu = F.expr(f"state.l + state.b * phi * (1 - pow(phi, h)) / (1 - phi) + element_at(state.s, (h - 1) % {m} + 1)")
    h = h.withColumns({"mu": mu, "var": F.col("state.sse") / F.col("state.n") * (1 + weights)})
    sd, log = F.sqrt("var"), F.col("use_log")
    return h.select(
        "series_id", "h", F.when(log, F.exp(F.col("mu") + F.col("var") / 2)).otherwise(F.col("mu")).alias("value"),
        F.when(log, F.exp(F.col("mu") - z * sd)).otherwise(F.col("mu") - z * sd).alias("lower"), F.when(log, F.exp(F.col("mu") + z * sd)).otherwise(F.col("mu") + z * sd).alias("upper"))


def _responses(y: np.ndarray, p: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """One-step errors of one series from a start of zeros, and what a unit of each part of the start (level, trend, and m - 1 seasons, the last being minus their sum) adds to them, for many (alpha, beta, gamma, phi) at once.

    Errors are linear in the start, so one pass over the series serves every start.
    """
    a, b, g, f = (x[:, None] for x in p.T)
    k = m + 2  # the series itself, level, trend, m - 1 seasons
    level, trend, season = np.zeros((len(p), k)), np.zeros((len(p), k)), np.zeros((m, len(p), k))
    level[:, 1], trend[:, 2] = 1, 1
    for j in range(m - 1):
        season[j, :, 3 + j], season[m - 1, :, 3 + j] = 1, -1
    out = np.zeros((len(y), len(p), k))
    seen = np.zeros(k)
    seen[0] = 1
    for t, v in enumerate(y):
        guess = level + f * trend
        e = v * seen - guess - season[t % m]
        level, trend = guess + a * e, f * trend + b * e
        season[t % m] = season[t % m] + g * e
        out[t] = e
    return out[:, :, 0].T, np.moveaxis(out[:, :, 1:], 0, 1)


def _best_starts(y: np.ndarray, p: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared error of one series for many (alpha, beta, gamma, phi), each from the start that is best for it, and those starts: level, trend, m seasons."""
    errors, parts = _responses(y, p, m)
    sse, starts = np.zeros(len(p)), np.zeros((len(p), m + 2))
    for i, (e, z) in enumerate(zip(errors, parts, strict=True)):
        x = np.linalg.lstsq(z, -e, rcond=1e-10)[0]
        left = e + z @ x
        sse[i], starts[i, :m + 1], starts[i, m + 1] = left @ left, x, -x[2:].sum()
    return sse, starts


def _seasonal_sse(y: np.ndarray, p: np.ndarray, m: int) -> np.ndarray:
    """Squared error of one series for (alpha, beta, gamma, phi) from the first season's mean, mean step and deviations."""
    errors, parts = _responses(y, p, m)
    level = y[:m].mean()
    start = np.r_[level, (y[m:2 * m].mean() - level) / m, (y[:m] - level)[:-1]]
    return ((errors + parts @ start) ** 2).sum(1)


def fit_season(series: DataFrame, m: int, rounds: int = 8) -> DataFrame:
    """alpha, beta, gamma, phi and the start (l0, b0, s0) of each series by maximum likelihood: sse, and sse_start, that of the default parameters from the first season.

    For given parameters the best start is a least squares fit, so the search is over the
    four parameters alone: a grid that closes in on the best. A start is identified by
    seasons that add to 0. Series of fewer than two seasons give no rows.
    """
    low, high, first = np.array([0.01, 0.0, 0.0, 0.80]), np.array([0.99, 0.5, 0.99, 0.98]), np.array([0.3, 0.05, 0.2, 0.95])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for series_id, y in zip(pdf["series_id"], pdf["y"], strict=True):
                y = np.asarray(y, dtype=float)
                at, span = first, (high - low) / 2
                for k in range(rounds):
                    grid = np.stack(np.meshgrid(*[np.linspace(-1, 1, 5 if k == 0 else 3)] * 4), -1).reshape(-1, 4)
                    cand = np.vstack([at, np.clip(((low + high) / 2 if k == 0 else at) + grid * span, low, high)])
                    at, span = cand[np.argmin(_best_starts(y, cand, m)[0])], span / 2
                sse, start = _best_starts(y, at[None], m)
                out.append((series_id, *map(float, at), float(start[0, 0]), float(start[0, 1]), start[0, 2:].tolist(), float(sse[0]), float(_seasonal_sse(y, first[None], m)[0])))
            yield pd.DataFrame(out, columns=["series_id", "alpha", "beta", "gamma", "phi", "l0", "b0", "s0", "sse", "sse_start"])

    return series.where(F.size("y") >= 2 * m).select("series_id", "y").mapInPandas(
        run, "series_id string, alpha double, beta double, gamma double, phi double, l0 double, b0 double, s0 array<double>, sse double, sse_start double")


def with_fitted_season(series: DataFrame, m: int) -> DataFrame:
    """series with the parameters of fit_season() and the state that its start and they leave, for seasonal_forecast()."""
    x = series.join(fit_season(series, m), "series_id")
    return x.withColumn("state", _season_fold(F.col("y"), F.struct(F.col("l0").alias("l"), F.col("b0").alias("b"), F.col("s0").alias("s")), F.col("alpha"), F.col("beta"), F.col("gamma"), F.col("phi"), m))
