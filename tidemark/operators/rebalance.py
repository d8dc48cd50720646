"""Rebalancing of a portfolio through time, with costs and tax."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import books, products
from .portfolio import YEAR


def lookback_weights(returns: DataFrame, every: int = 21, lookback: int = 252, least: int = 60) -> DataFrame:
    """(ts, series_id, w) at every `every`-th date: weights by inverse volatility of up to `lookback` returns that end there, from `least` returns on."""
    w = W.partitionBy("series_id").orderBy("ts")
    x = returns.withColumns({"place": F.row_number().over(w), "sd": F.stddev_samp("r").over(w.rowsBetween(1 - lookback, 0))})
    x = x.where((F.col("place") % every == 0) & (F.col("place") >= least) & (F.col("sd") > 0))
    return x.select("ts", "series_id", (1 / F.col("sd") / F.sum(1 / F.col("sd")).over(W.partitionBy("ts"))).alias("w"))


def started(prices: DataFrame, burn_in: int, least: int = 126, evaluated: int = 21) -> DataFrame:
    """prices(portfolio, series_id, ts, value) on each portfolio's common dates: (portfolio, ts, place, p, start), p in the order of names.

    start is the place of the first date after the burn-in, of which at least 22 dates are
    left out and `least` are kept; portfolios with fewer than `evaluated` dates after it go.
    """
    names = prices.groupBy("portfolio").agg(F.count_distinct("series_id").alias("k"))  # a row a portfolio
    wide = prices.where("value > 0").groupBy("portfolio", "ts").agg(F.array_sort(F.collect_list(F.struct("series_id", "value"))).alias("p"))
    wide = wide.join(names, "portfolio").where(F.size("p") == F.col("k")).drop("k")
    x = wide.withColumn("place", F.row_number().over(W.partitionBy("portfolio").orderBy("ts")) - 1)
    days = F.count("*").over(W.partitionBy("portfolio"))
    x = x.withColumn("days", days).withColumn("start", F.greatest(F.least(F.lit(burn_in), F.col("days") - 22), F.lit(least)))
    return x.where(F.col("days") - F.col("start") >= evaluated).drop("days")


def rolling_estimates(begun: DataFrame, every: tuple[int, ...] = (21, 63), lookback: int = 252) -> DataFrame:
    """The estimates of books.estimates() for each portfolio, cadence and rebalance: (portfolio, every, at, i, j, n, annual, intensity, mu).

    A rebalance at place `at` sees the `lookback` returns up to that date, or all there are.
    Products are summed once for each block of `every` dates; a rebalance adds the blocks of
    its lookback, so no return is read again for the next one. lookback is a multiple of every.
    """
    if any(lookback % e for e in every):
        raise ValueError("lookback must be a multiple of the dates between rebalances")
    w = W.partitionBy("portfolio", "series_id").orderBy("place")
    each = begun.select("portfolio", "ts", "place", "start", F.explode("p").alias("x")).select("portfolio", "ts", "place", "start", "x.*")
    returns = each.withColumn("r", F.ln(F.col("value") / F.lag("value").over(w))).where("place > 0")
    rows = returns.withColumn("every", F.explode(F.array(*[F.lit(e) for e in every])))
    rows = rows.withColumn("block", F.floor((F.col("place") - 1 - F.col("start")) / F.col("every")).cast("int"))
    sums = products.pair_products(rows, ("portfolio", "every", "block"), days=36_500, blocks=1)
    back = W.partitionBy("portfolio", "every", "i", "j").orderBy("block")
    out = None
    for e in every:
        some = sums.where(F.col("every") == e).withColumns({s: F.sum(s).over(back.rangeBetween(1 - lookback // e, 0)) for s in products.SUMS})
        out = some if out is None else out.unionByName(some)
    start = begun.groupBy("portfolio").agg(F.max("start").alias("start"), F.max("place").alias("last"))  # a row a portfolio
    out = out.join(start, "portfolio").withColumn("at", F.col("start") + (F.col("block") + 1) * F.col("every")).where("at >= start and at <= last")
    return books.estimates(out.drop("block", "start", "last"), ("portfolio", "every", "at"))


def solved_weights(begun: DataFrame, every: tuple[int, ...] = (21, 63), lookback: int = 252, cap: float = 0.6, rate: float = 0.04) -> DataFrame:
    """(portfolio, every, at, name, method, w, share, residual) at every rebalance: the largest Sharpe ratio and equal shares of risk, from returns before it."""
    return books.solved(rolling_estimates(begun, every, lookback), ("portfolio", "every", "at"), cap, rate)


def walk_forward(prices: DataFrame, every: tuple[int, ...] = (21, 63), burn_in: int = 252, lookback: int = 252, cap: float = 0.6, rate: float = 0.04, cost_bps: float = 10.0, tax: float = 0.2) -> DataFrame:
    """(portfolio, every, method, ts, gross, net, hold, turnover, cost, tax) of many portfolios, each solved again at every rebalance.

    prices(portfolio, series_id, ts, value). From the end of the burn-in, day by day as in
    book(): turnover, cost and tax are the day's, 0 between rebalances. Values start at 1.
    """
    begun = started(prices, burn_in)
    targets = books.as_arrays(solved_weights(begun, every, lookback, cap, rate), ("portfolio", "every", "at", "method"))
    grid = begun.where("place >= start").select("portfolio", "ts", "place", F.transform("p", lambda x: x["value"]).alias("p"))
    grid = grid.withColumn("every", F.explode(F.array(*[F.lit(e) for e in every]))).withColumn("method", F.explode(F.array(F.lit("sharpe"), F.lit("parity"))))
    rows = grid.join(targets.withColumnRenamed("at", "place"), ["portfolio", "every", "method", "place"], "left")
    return folded(rows, ("portfolio", "every", "method"), cost_bps, tax)


def folded(rows: DataFrame, by: tuple[str, ...], cost_bps: float = 10.0, tax: float = 0.2, average_basis: bool = False) -> DataFrame:
    """(by..., ts, gross, net, hold, turnover, cost, tax) from rows(by..., ts, p, target), day by day: p the prices and target, where not null, the weights to trade to.

    Turnover counts both sides; the net book pays costs on it and tax on gains over the cost
    of what it sells, which any purchase sets to its price (with average_basis: to the mean);
    the first purchase is free. `hold` never trades. Each `by` is one group.
    """
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*by).schema)
    curves = ["gross", "net", "hold", "turnover", "cost", "tax"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        p, targets = np.array(pdf["p"].tolist(), dtype=float), pdf["target"].tolist()
        first = np.full(p.shape[1], 1 / p.shape[1]) if targets[0] is None else np.asarray(targets[0], dtype=float)
        gross, net, hold = first / p[0], first / p[0], first / p[0]
        basis, out = p[0].copy(), []
        for t, price in enumerate(p):
            spent = (0.0, 0.0, 0.0)
            if t and targets[t] is not None:
                target = np.asarray(targets[t], dtype=float)
                gross = target * (gross @ price) / price
                value = net @ price
                want = target * value / price
                moved = np.abs(want - net) @ price
                taxed = tax * (np.maximum(net - want, 0) * np.maximum(price - basis, 0)).sum()
                spent = (moved / value if value > 0 else 0.0, moved * cost_bps / 1e4, taxed)
                bought = np.maximum(want - net, 0)
                cost = (basis * net + price * bought) / np.maximum(want, 1e-300) if average_basis else price
                basis = np.where(bought > 0, cost, basis)
                net = want * max(0.0, value - spent[1] - spent[2]) / value if value > 0 else want
            out.append((gross @ price, net @ price, hold @ price, *spent))
        made = pd.DataFrame(out, columns=curves).assign(ts=pdf["ts"].to_numpy(), **{k: pdf[k].iloc[0] for k in by})
        return made[[*by, "ts", *curves]]

    return rows.groupBy(*by).applyInPandas(run, f"{kinds}, ts date, " + ", ".join(f"{c} double" for c in curves))


def book(prices: DataFrame, names: list[str], every: int = 21, cost_bps: float = 10.0, tax: float = 0.2, weights: list[float] | None = None, average_basis: bool = False) -> DataFrame:
    """(portfolio, ts, gross, net, hold) from wide prices (portfolio, ts, one column a name), day by day in order, as in folded().

    Every `every` rows the book goes back to its weights, equal ones if none are given. A
    column `target` of prices, an array in the order of names or null, replaces them from
    that day on. One portfolio is one group.
    """
    begin = F.array(*[F.lit(float(w)) for w in (weights or [1 / len(names)] * len(names))])
    w = W.partitionBy("portfolio").orderBy("ts")
    target = F.coalesce(F.last("target", ignorenulls=True).over(w), begin) if "target" in prices.columns else begin
    place = F.row_number().over(w) - 1
    rows = prices.select("portfolio", "ts", F.array(*[F.col(n).cast("double") for n in names]).alias("p"), F.when(place % every == 0, target).alias("target"))
    return folded(rows, ("portfolio",), cost_bps, tax, average_basis).select("portfolio", "ts", "gross", "net", "hold")


def curve_metrics(curve: DataFrame, rate: float = 0.04) -> DataFrame:
    """Annual growth, volatility, Sharpe ratio and worst drawdown of curves points(series_id, ts, value)."""
    from .returns import equity_drawdown, simple_returns

    r = simple_returns(curve).groupBy("series_id").agg(F.stddev_samp("r").alias("sd"), F.count("*").alias("m"))
    e = curve.groupBy("series_id").agg(F.min_by("value", "ts").alias("first"), F.max_by("value", "ts").alias("last"))
    d = equity_drawdown(curve).groupBy("series_id").agg(F.min("drawdown").alias("max_drawdown"))
    g = F.pow(F.col("last") / F.col("first"), YEAR / F.col("m")) - 1
    x = e.join(r, "series_id").join(d, "series_id").withColumns({"growth": g, "volatility": F.col("sd") * (YEAR**0.5)})
    return x.select("series_id", "growth", "volatility", F.try_divide(F.col("growth") - rate, "volatility").alias("sharpe"), "max_drawdown")
