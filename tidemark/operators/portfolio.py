"""Correlation, covariance, shrinkage, weights and their metrics over returns(series_id, ts, r)."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import products
from .returns import wealth

YEAR = 252


def ranked(returns: DataFrame) -> DataFrame:
    """Returns replaced by their rank in the series, ties by their mean rank."""
    w = W.partitionBy("series_id").orderBy("r")
    peers = F.count("*").over(W.partitionBy("series_id", "r"))
    return returns.select("series_id", "ts", (F.rank().over(w) + (peers - 1) / 2).alias("r"))


def correlations(returns: DataFrame) -> DataFrame:
    """Pearson and Spearman coefficient of each two series, 0 where undefined, 1 on the diagonal.

    Ranks are of the whole series, so both want returns on common dates.
    """
    both = returns.withColumn("kind", F.lit("pearson")).unionByName(ranked(returns).withColumn("kind", F.lit("spearman")))
    c = F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.coalesce(products.correlation(), F.lit(0.0)))
    each = products.pair_products(both, ("kind",)).select("kind", "i", "j", "n", c.alias("c"))
    return each.groupBy("i", "j").agg(
        F.max(F.when(F.col("kind") == "pearson", F.col("c"))).alias("pearson"), F.max("n").alias("n"), F.max(F.when(F.col("kind") == "spearman", F.col("c"))).alias("spearman"))


def student_p(r: float, n: int) -> float:
    """Two-sided p-value of a correlation of n pairs: the regularised incomplete beta function by its continued fraction."""
    if n < 3:
        return 1.0
    if abs(r) >= 1:
        return 0.0
    df = n - 2
    t2 = r * r * df / (1 - r * r)
    return _beta(df / (df + t2), df / 2, 0.5)


def _beta(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for k in range(300):
        m = k // 2
        num = 1.0 if k == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if k % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or 1e-30)
        c = 1 + num / c or 1e-30
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def p_values(correlated: DataFrame) -> DataFrame:
    """correlations() with two-sided p-values: 0 on the diagonal, 1 where a coefficient is undefined."""
    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([student_p(a, int(b)) for a, b in zip(r, n, strict=True)], dtype=float)

    def of(c: str):
        return F.when(F.col("i") == F.col("j"), 0.0).otherwise(p(F.col(c), F.col("n"))).alias(f"{c}_p")

    return correlated.select("*", of("pearson"), of("spearman"))


def strategies(returns: DataFrame, weights: dict[str, dict[str, float]], rate: float = 0.04) -> DataFrame:
    """Annual return, volatility and Sharpe ratio of each strategy's fixed weights."""
    rows = [(s, n, float(w)) for s, own in weights.items() for n, w in own.items()]
    w = returns.sparkSession.createDataFrame(rows, "strategy string, series_id string, w double")
    daily = returns.join(F.broadcast(w), "series_id").groupBy("strategy", "ts").agg(F.sum(F.col("w") * F.col("r")).alias("r"))  # a row for each strategy and asset
    g = daily.groupBy("strategy").agg((F.avg("r") * YEAR).alias("annual_return"), (F.stddev_samp("r") * math.sqrt(YEAR)).alias("volatility"))
    return g.withColumn("sharpe", F.try_divide(F.col("annual_return") - rate, "volatility"))


def covariance(returns: DataFrame) -> DataFrame:
    """Sample covariance of each two series, i <= j."""
    return products.pair_products(returns).select("i", "j", products.covariance().alias("s"), "n")


def shrunk(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """pairs(by..., i, j, s, n, pi) with intensity and annual: covariances shrunk towards the mean variance times the identity.

    The intensity is the summed variance of the products over the squared distance to the
    target, in [0, 1], and 0 when that distance is negligible; each `by` is a matrix of its own.
    """
    same = F.col("i") == F.col("j")
    both = F.when(same, 1).otherwise(2)
    whole = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))  # one row for each two series
    t = pairs.withColumn("target", F.avg(F.when(same, F.col("s"))).over(whole))
    off = F.col("s") - F.when(same, F.col("target")).otherwise(0.0)
    sums = t.withColumns({"d2": F.sum(both * off * off).over(whole), "all_pi": F.sum(both * F.col("pi")).over(whole), "t": F.max("n").over(whole)})
    share = F.when(F.col("d2") < 1e-12, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("all_pi") / F.col("t") / F.col("d2"))))
    mixed = (1 - F.col("intensity")) * F.col("s") + F.when(same, F.col("intensity") * F.col("target")).otherwise(0.0)
    return sums.withColumn("intensity", share).withColumn("annual", mixed * YEAR).drop("target", "d2", "all_pi", "t")


def shrunk_covariance(returns: DataFrame) -> DataFrame:
    """The covariance of all series, shrunk."""
    pairs = products.pair_products(returns).select("i", "j", products.covariance().alias("s"), "n", products.product_variance().alias("pi"))
    return shrunk(pairs).select("i", "j", "s", "intensity", "annual")


def expected_returns(returns: DataFrame) -> DataFrame:
    """Annual means shrunk to their common mean; the weight is (K - 2) trace / (K T spread) in [0, 1], and 0.2 for K <= 2 or no spread."""
    g = returns.groupBy("series_id").agg((F.avg("r") * YEAR).alias("mu"), (F.var_samp("r") * YEAR).alias("v"), F.count("*").alias("t"))
    every = g.agg(F.avg("mu").alias("centre"), F.sum("v").alias("trace"), F.count("*").alias("k"), F.max("t").alias("t_all"))
    x = g.join(F.broadcast(every))
    spread = x.groupBy().agg(F.sum(F.pow(F.col("mu") - F.col("centre"), 2)).alias("spread"))
    x = x.join(F.broadcast(spread))
    w = F.when((F.col("k") <= 2) | (F.col("spread") <= 1e-8), 0.2).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("k") - 2) * F.col("trace") / (F.col("k") * F.col("t_all")) / F.col("spread"))))
    return x.select("series_id", "mu", w.alias("weight"), ((1 - w) * F.col("mu") + w * F.col("centre")).alias("shrunk"))


def normalized(weights: DataFrame, names: DataFrame) -> DataFrame:
    """Weights of the named series that add to 1: missing ones are 0, and all are equal if nothing positive is left."""
    x = names.select("series_id").join(weights, "series_id", "left").withColumn("w", F.greatest(F.coalesce("w", F.lit(0.0)), F.lit(0.0)))
    t = x.agg(F.sum("w").alias("total"), F.count("*").alias("k"))
    return x.join(F.broadcast(t)).select("series_id", F.when(F.col("total") > 0, F.col("w") / F.col("total")).otherwise(1 / F.col("k")).alias("w"))


def normalized_books(weights: DataFrame, names: DataFrame) -> DataFrame:
    """As normalized(), for each book of names(book, name) and weights(book, name, w)."""
    x = names.join(weights, ["book", "name"], "left").withColumn("w", F.greatest(F.coalesce("w", F.lit(0.0)), F.lit(0.0)))
    whole = W.partitionBy("book")
    return x.select("book", "name", F.when(F.sum("w").over(whole) > 0, F.try_divide("w", F.sum("w").over(whole))).otherwise(1 / F.count("*").over(whole)).alias("w"))


def metrics(returns: DataFrame, weights: DataFrame, rate: float = 0.04) -> DataFrame:
    """Return, volatility, Sharpe ratio, worst drawdown and diversification of a portfolio with fixed weights, one row."""
    r = returns.join(F.broadcast(weights), "series_id")
    daily = r.groupBy("ts").agg(F.sum(F.col("w") * F.col("r")).alias("r")).withColumn("series_id", F.lit("portfolio"))
    single = r.groupBy("series_id").agg((F.max("w") * F.stddev_samp("r") * math.sqrt(YEAR)).alias("part")).agg(F.sum("part").alias("parts"))
    total = daily.agg((F.avg("r") * YEAR).alias("annual_return"), (F.stddev_samp("r") * math.sqrt(YEAR)).alias("volatility"))
    worst = wealth(daily.select("series_id", "ts", "r")).agg(F.min("drawdown").alias("max_drawdown"))
    return total.join(F.broadcast(single)).join(F.broadcast(worst)).select(
        "annual_return", "volatility", F.try_divide(F.col("annual_return") - rate, "volatility").alias("sharpe"), "max_drawdown",
        F.try_divide("parts", "volatility").alias("diversification"))


def risk_contributions(cov: DataFrame, weights: DataFrame) -> DataFrame:
    """Share of each series in the portfolio's variance, from annual covariances (i <= j)."""
    full = cov.select("i", "j", "annual").union(cov.where("i < j").select("j", "i", "annual"))
    wi, wj = weights.withColumnsRenamed({"series_id": "i", "w": "wi"}), weights.withColumnsRenamed({"series_id": "j", "w": "wj"})
    g = full.join(F.broadcast(wi), "i").join(F.broadcast(wj), "j").groupBy("i").agg(F.sum(F.col("wi") * F.col("wj") * F.col("annual")).alias("part"))
    return g.select(F.col("i").alias("series_id"), "part", (F.col("part") / F.sum("part").over(W.partitionBy(F.lit(1)))).alias("share"))


def matrix(cov: DataFrame) -> tuple[list[str], np.ndarray]:
    """Names and matrix of annual covariances: K by K for at most a few dozen assets."""
    rows = cov.select("i", "j", "annual").collect()
    names = sorted({r["i"] for r in rows})
    at = {n: k for k, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for r in rows:
        m[at[r["i"]], at[r["j"]]] = m[at[r["j"]], at[r["i"]]] = r["annual"]
    return names, m


def risk_parity(cov: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Long-only weights with equal risk contributions: Newton's method on x'Cx / 2 - sum(log x) / K."""
    k = len(cov)
    x = 1 / np.sqrt(np.diag(cov)) / math.sqrt(k)
    for _ in range(rounds):
        g = cov @ x - 1 / (k * x)
        step = np.linalg.solve(cov + np.diag(1 / (k * x * x)), g)
        size = math.sqrt(max(step @ g * k, 0))
        if size < 1e-13:
            break
        x = x - step / (1 + size if size > 0.25 else 1)  # the barrier's damped step keeps x positive
    return x / x.sum()


def parity_residual(w: np.ndarray, cov: np.ndarray) -> float:
    """How far the shares of risk are from 1 / K."""
    parts = w * (cov @ w)
    return float(np.abs(parts / parts.sum() - 1 / len(w)).max())


def capped_simplex(v: np.ndarray, cap: float) -> np.ndarray:
    """The nearest point with entries in [0, cap] that add to 1."""
    low, high = v.min() - 1, v.max()
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if np.minimum(np.maximum(v - mid, 0), cap).sum() > 1 else (low, mid)
    return np.minimum(np.maximum(v - (low + high) / 2, 0), cap)


def _slope(w: np.ndarray, mu: np.ndarray, cov: np.ndarray, rate: float) -> np.ndarray:
    vol = math.sqrt(w @ cov @ w)
    return mu / vol - (mu @ w - rate) * (cov @ w) / vol**3


def sharpe_residual(w: np.ndarray, mu: np.ndarray, cov: np.ndarray, cap: float, rate: float = 0.04, near: float = 1e-9) -> float:
    """How far weights are from the first-order conditions of the largest Sharpe ratio, in units of the slopes.

    Free weights have one slope, those at 0 none above it, those at the cap none below it.
    """
    cap = max(cap, 1 / len(w))
    g = _slope(w, mu, cov, rate)
    can_rise, can_fall = w < cap - near, w > near
    gap = max(0.0, float(g[can_rise].max() - g[can_fall].min())) if can_rise.any() and can_fall.any() else 0.0
    return max(gap / max(1e-12, float(np.abs(g).max())), abs(float(w.sum()) - 1))


def _polished(w: np.ndarray, mu: np.ndarray, cov: np.ndarray, cap: float, rate: float) -> np.ndarray:
    """w with its free weights moved by Newton's method until their slopes are one."""
    free = (w > 1e-7) & (w < cap - 1e-7)
    w = np.where(w <= 1e-7, 0.0, np.where(w >= cap - 1e-7, cap, w))
    if free.sum() < 1:
        return w
    for _ in range(12):
        v = math.sqrt(w @ cov @ w)
        c, e = cov @ w, mu @ w - rate
        h = -(np.outer(mu, c) + np.outer(c, mu)) / v**3 - e * cov / v**3 + 3 * e * np.outer(c, c) / v**5
        m = int(free.sum())
        system = np.block([[h[np.ix_(free, free)], -np.ones((m, 1))], [np.ones((1, m)), np.zeros((1, 1))]])
        try:
            step = np.linalg.solve(system, np.r_[-_slope(w, mu, cov, rate)[free], 1 - w.sum()])[:-1]
        except np.linalg.LinAlgError:
            return w
        new = w.copy()
        new[free] += step
        if not np.isfinite(step).all() or new.min() < 0 or new.max() > cap:
            return w
        w = new
        if np.abs(step).max() < 1e-15:
            break
    return w


def _corner(mu: np.ndarray, cap: float) -> np.ndarray:
    """The weights up to cap of the largest mean return: the best names at the cap, the next one with the rest."""
    w, left = np.zeros(len(mu)), 1.0
    for i in np.argsort(-mu, kind="stable"):
        w[i] = min(cap, left)
        left = max(0.0, left - w[i])
    return w


def _order(w: np.ndarray) -> tuple[int, list[float]]:
    """What orders corners of one ratio: the first name left out, and the weights read on from there and round."""
    out = int((w > 0).argmin())
    return out, np.roll(w, -out).tolist()


def _best_corner(mu: np.ndarray, cov: np.ndarray, cap: float, rate: float, near: float = 1e-12) -> np.ndarray:
    """The corner of the weights up to cap with the largest Sharpe ratio, by trying all of them.

    A corner has as many names at the cap as fit, and one with the rest. Where means and
    covariances are shrunk all the way, all corners have one ratio; of those that are `near`
    the largest, relative to it, the first by _order() is taken.
    """
    k, full = len(mu), min(len(mu), int(1 / cap + 1e-9))
    rest = max(0.0, 1 - full * cap)
    best, value = None, -np.inf
    for at_cap in itertools.combinations(range(k), full):
        at = list(at_cap)
        others = np.setdiff1d(np.arange(k), at)
        excess, variance = np.full(len(others) or 1, cap * mu[at].sum() - rate), np.full(len(others) or 1, cap * cap * cov[np.ix_(at, at)].sum())
        if len(others):
            excess = excess + rest * mu[others]
            variance = variance + 2 * cap * rest * cov[np.ix_(at, others)].sum(0) + rest * rest * np.diag(cov)[others]
        ratio = excess / np.sqrt(variance)
        top = max(value, float(ratio.max()))
        if value < top - near * abs(top):
            best = None
        value = top
        tied = np.flatnonzero(ratio >= top - near * abs(top))
        if len(tied):
            new = np.zeros(k)
            new[at] = cap
            if len(others):
                new[others[tied[-1]]] = rest  # of one choice at the cap, the last name comes first
            best = new if best is None else min(best, new, key=_order)
    return best / best.sum()


def max_sharpe(mu: np.ndarray, cov: np.ndarray, cap: float = 1.0, rate: float = 0.04, starts: int = 10, seed: int = 42, exact: float = 1e-10, most: int = 200_000) -> np.ndarray:
    """Long-only weights up to cap (at least 1 / K) of the largest Sharpe ratio.

    Where some weights have an excess return above 0, the ratio has one optimum among those:
    projected gradients from there find which weights are at a bound, Newton's method the
    free ones; a start that meets the conditions to `exact` is the last. Where none has, the
    ratio is largest at a corner, and all are tried. Over `most` choices of names at the cap
    the best of `starts` searches and of the corner with the largest return is taken, which
    need not be the largest: with a cap of a half or more that is never so for up to `most` names.
    """
    k = len(mu)
    cap = max(cap, 1 / k)
    rng = np.random.default_rng(seed)
    corner = _corner(mu, cap)
    if mu @ corner <= rate and math.comb(k, min(k, int(1 / cap + 1e-9))) <= most:
        return _best_corner(mu, cov, cap, rate)
    best, value = np.full(k, 1 / k), -np.inf
    for s in range(starts):
        w = capped_simplex(np.full(k, 1 / k) if s == 0 else rng.dirichlet(np.ones(k)), cap)
        if s == 0 and mu @ w <= rate:
            w = corner
        step = 1.0
        now = (mu @ w - rate) / math.sqrt(w @ cov @ w)
        for i in range(2_000):
            new = capped_simplex(w + step * _slope(w, mu, cov, rate), cap)
            then = (mu @ new - rate) / math.sqrt(new @ cov @ new)
            if then > now + 1e-15:
                w, now, step = new, then, step * 1.5
            else:
                step /= 2
                if step < 1e-14:
                    break
            if (i in (4, 9, 19) or i % 40 == 39) and sharpe_residual(sharper := _polished(w, mu, cov, cap, rate), mu, cov, cap, rate) < exact:
                w = sharper
                break
        sharper = _polished(w, mu, cov, cap, rate)
        if sharpe_residual(sharper, mu, cov, cap, rate) <= sharpe_residual(w, mu, cov, cap, rate):
            w = sharper
        now = (mu @ w - rate) / math.sqrt(w @ cov @ w)
        if now > value:
            best, value = w, now
        if value > 0 and sharpe_residual(best, mu, cov, cap, rate) < exact:
            break
    return best
