"""Products of many series, books solved in groups, and the walk-forward of many portfolios."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pytest
from compare import by_spark, by_sql, same
from pyspark.sql import functions as F

from tidemark import registry
from tidemark.operators import books, portfolio, products, rebalance

DAY0 = pd.Timestamp("2020-01-01")


def long_form(spark, x, names=None, column="r"):
    names = names or [f"s{k:04d}" for k in range(x.shape[1])]
    t, k = np.nonzero(~np.isnan(x))
    pdf = pd.DataFrame({"series_id": np.array(names, dtype=object)[k], "ts": (DAY0 + pd.to_timedelta(t, "D")).date, column: x[t, k]})
    return spark.createDataFrame(pdf, f"series_id string, ts date, {column} double")


def test_products_of_series_with_gaps(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0.001, 0.02, (400, 7))
    x[rng.random(x.shape) < 0.2] = np.nan
    names = [f"n{k}" for k in range(7)]
    df = long_form(spark, x, names).union(spark.createDataFrame([("n0", DAY0.date(), float("nan"))], "series_id string, ts date, r double").where("false"))
    for blocks, days in ((1, 36_500), (3, 64), (8, 10)):
        got = {(r["i"], r["j"]): r for r in products.pair_products(df, days=days, blocks=blocks).withColumns({"c": products.correlation(), "s": products.covariance(), "pi": products.product_variance()}).collect()}
        assert set(got) == {(names[i], names[j]) for i in range(7) for j in range(i, 7)}
        for (i, j), r in got.items():
            a, b = x[:, int(i[1])], x[:, int(j[1])]
            both = ~np.isnan(a) & ~np.isnan(b)
            a, b = a[both], b[both]
            s = np.cov(a, b)[0, 1]
            assert r["n"] == both.sum()
            assert r["s"] == pytest.approx(s, abs=1e-15)
            assert r["c"] == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-9)
            assert r["pi"] == pytest.approx((((a - a.mean()) * (b - b.mean()) - s) ** 2).mean(), rel=1e-6)


def test_five_hundred_series_without_a_join_of_all_pairs_by_date(spark):
    x = np.random.default_rng(4).normal(0, 0.01, (150, 500))
    df = portfolio.covariance(long_form(spark, x))
    assert "Join" not in df._jdf.queryExecution().toString()
    out = df.toPandas()
    assert len(out) == 500 * 501 // 2
    m = out.pivot(index="i", columns="j", values="s").to_numpy()
    want = np.cov(x.T)
    upper = np.triu_indices(500)
    assert np.allclose(m[upper], want[upper], atol=1e-14)


def test_series_that_do_not_vary_correlate_with_nothing(spark):
    x = np.column_stack([np.full(50, 0.3), np.random.default_rng(1).normal(size=50), np.arange(50) * 1.0])
    got = {(r["i"], r["j"]): r["pearson"] for r in portfolio.correlations(long_form(spark, x, ["c", "n", "t"])).collect()}
    assert got["c", "c"] == 1 and got["c", "n"] == 0 and got["c", "t"] == 0 and abs(got["n", "t"]) < 1


def test_thousands_of_books(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(0.0004, 0.015, (300, 12)) + rng.normal(0, 0.01, (300, 1))
    names = [f"n{k:02d}" for k in range(12)]
    held = [(str(b), names[k], float(rng.integers(0, 5))) for b in range(2_000) for k in rng.choice(12, rng.integers(1, 7), replace=False)]
    held += [("unknown", "no such series", 1.0), ("2", "no such series", 1.0)]
    holdings = spark.createDataFrame(held, "book string, name string, w double")
    out = books.optimized(long_form(spark, x, names), holdings).toPandas()
    assert out["book"].nunique() == 2_000
    assert (out.groupby(["book", "method"])["w"].sum().round(9) == 1).all()
    assert out["residual"].max() < 1e-8
    assert (out[out.method == "parity"].groupby("book")["share"].agg(np.ptp) < 1e-9).all()
    k = out[out.method == "sharpe"].groupby("book")["w"].agg(["size", "max"])
    assert (k["max"] <= np.maximum(0.6, 1 / k["size"]) + 1e-9).all()
    ratio = out.groupby(["book", "method"])["sharpe"].first().unstack()
    within = out.groupby(["book", "method"])["w"].max().unstack()["parity"] <= 0.6
    assert (ratio["sharpe"] >= ratio["parity"] - 1e-9)[within].all()


def test_a_book_with_a_dead_series(spark):
    x = np.column_stack([np.zeros(60), np.random.default_rng(2).normal(0, 0.01, (60, 2))])
    held = spark.createDataFrame([("b", n, 1.0) for n in ("dead", "n1", "n2")] + [("only", "dead", 1.0)], "book string, name string, w double")
    out = books.optimized(long_form(spark, x, ["dead", "n1", "n2"]), held).toPandas()
    assert set(out["book"]) == {"b"} and len(out) == 12  # shrinking gives a dead series of a live book some variance
    assert out["residual"].max() < 1e-8


def test_books_of_the_same_names_are_solved_once(spark, monkeypatch):
    x = np.random.default_rng(6).normal(0.001, 0.01, (120, 3))
    sets = [("a", "b"), ("b", "c"), ("a", "b", "c")]
    held = spark.createDataFrame([(f"u{k}", n, 1.0 + k % 7) for k in range(300) for n in sets[k % 3]], "book string, name string, w double")
    rows, solved = [], books.solved

    def counted(e, by, *rest):
        rows.append(e.count())
        return solved(e, by, *rest)

    monkeypatch.setattr(books, "solved", counted)
    out = books.optimized(long_form(spark, x, ["a", "b", "c"]), held).toPandas()
    assert rows == [3 + 3 + 6]
    assert out["book"].nunique() == 300 and len(out) == 4 * held.count() and (out.groupby(["book", "method"])["w"].sum().round(9) == 1).all()
    current = out[out.method == "current"].merge(held.toPandas().assign(share_=lambda d: d.w / d.groupby("book").w.transform("sum")), on=["book", "name"])
    assert np.allclose(current["w_x"], current["share_"])


def test_books_whose_returns_are_under_the_rate(spark):
    from test_kernels import under_the_rate

    seeds = (26, 62, 87)
    rows = [(str(s), f"n{i}", f"n{j}", float(under_the_rate(s)[1][i, j]), -0.0007 if i == j else None) for s in seeds for i in range(3) for j in range(i, 3)]
    out = books.solved(spark.createDataFrame(rows, "book string, i string, j string, annual double, mu double"), ("book",)).where("method = 'sharpe'").toPandas()
    for s in seeds:
        assert np.allclose(out[out.book == str(s)].sort_values("name")["w"], under_the_rate(s)[2], atol=1e-12)


def test_strategies_of_series_that_shrink_to_one_mean_and_one_variance(spark, tmp_path):
    prices = np.random.default_rng(2).normal(1000, 50, (3, 120)).round(2)
    days = DAY0 + pd.to_timedelta(np.tile(np.arange(120), 3), "D")
    pd.DataFrame({"l_returnflag": np.repeat(list("ANR"), 120), "l_shipdate": days.astype("datetime64[us]"), "l_extendedprice": prices.ravel()}).to_parquet(tmp_path / "lineitem.parquet")
    for name in ("krn_30_strategies", "krn_26_max_sharpe"):
        assert same(by_spark(registry.QUERIES[name](spark, str(tmp_path)))[1], by_sql(registry.SQL[name], tmp_path)[1])
    w = {r["name"]: r for r in registry.QUERIES["krn_30_strategies"](spark, str(tmp_path)).where("method = 'sharpe'").collect()}
    assert [w[n]["w"] for n in "ANR"] == [0, 0.4, 0.6] and len({r["annual_return"] for r in w.values()}) == 1


def prices_of(spark, returns, portfolio_="p"):
    x = 100 * np.exp(np.vstack([np.zeros(returns.shape[1]), np.cumsum(returns, 0)]))
    return long_form(spark, x, [f"a{k}" for k in range(returns.shape[1])], "value").withColumn("portfolio", F.lit(portfolio_))


def weights_of(prices, **kw):
    out = rebalance.solved_weights(rebalance.started(prices, 252), **kw).toPandas()
    return out.set_index(["every", "at", "method", "name"]).sort_index()


def test_weights_before_a_date_do_not_change_with_what_comes_after(spark):
    r = np.random.default_rng(777).normal(0.0005, 0.015, (400, 3))
    later = r.copy()
    later[260:] = later[260:] * 15 + 0.10
    a, b = weights_of(prices_of(spark, r)), weights_of(prices_of(spark, later))
    assert a["residual"].max() < 1e-8 and b["residual"].max() < 1e-8
    at = a.index.get_level_values("at")
    assert sorted(set(at)) == sorted({252 + 21 * k for k in range(8)} | {252, 315, 378})
    early = at <= 260
    assert early.any() and np.abs(a["w"] - b["w"])[early].max() < 1e-12
    assert np.abs(a["w"] - b["w"])[~early].max() > 1e-3


def test_estimates_of_a_window_are_those_of_its_returns(spark):
    r = np.random.default_rng(5).normal(0.0005, 0.015, (420, 4))
    got = rebalance.rolling_estimates(rebalance.started(prices_of(spark, r), 200)).toPandas()
    for (every, at), g in got.groupby(["every", "at"]):
        x = r[max(0, at - 252):at]
        s = np.cov(x.T)
        f = np.eye(4) * np.trace(s) / 4
        c = x - x.mean(0)
        pi = ((c[:, :, None] * c[:, None, :] - s) ** 2).mean(0).sum()
        share = np.clip(pi / len(x) / ((s - f) ** 2).sum(), 0, 1)
        cov = ((1 - share) * s + share * f) * 252
        m = x.mean(0) * 252
        part = np.clip(2 * np.trace(cov) / (4 * len(x)) / ((m - m.mean()) ** 2).sum(), 0, 1)
        mu = (1 - part) * m + part * m.mean()
        for i, j, annual, own in g[["i", "j", "annual", "mu"]].itertuples(index=False):
            assert annual == pytest.approx(cov[int(i[1]), int(j[1])], abs=1e-10)
            if i == j:
                assert own == pytest.approx(mu[int(i[1])], abs=1e-9)
    assert {(200 + 21 * k) for k in range(10)} == set(got[got.every == 21]["at"]) - {x for x in got[got.every == 21]["at"] if x > 400}


def test_costs_and_taxes_only_lower_the_net_curve(spark):
    rng = np.random.default_rng(101)
    r = np.column_stack([rng.normal(0.001, 0.022, 499), rng.normal(0.0004, 0.014, 499)])
    p = prices_of(spark, r, "one").unionByName(prices_of(spark, r[:, ::-1], "two")).unionByName(prices_of(spark, r[:100], "short"))
    walk = rebalance.walk_forward(p, every=(21,), cost_bps=50).toPandas()
    assert set(walk["portfolio"]) == {"one", "two"} and set(walk["method"]) == {"sharpe", "parity"}
    for _, g in walk.groupby(["portfolio", "method"]):
        g = g.sort_values("ts")
        assert len(g) == 500 - 252 and g["hold"].iloc[0] == pytest.approx(1)
        assert (g["turnover"] > 0).sum() <= 11 and g["net"].iloc[-1] < g["gross"].iloc[-1]
        assert (g["cost"] >= 0).all() and (g["tax"] >= 0).all()
    free = rebalance.walk_forward(p, every=(21,), cost_bps=0, tax=0).toPandas()
    assert np.allclose(free["net"], free["gross"])
    with pytest.raises(ValueError):
        rebalance.walk_forward(p, every=(50,))


def test_no_optimum_is_solved_on_the_driver():
    import inspect

    from tidemark.plans import portfolio_queries

    assert not re.search(r"portfolio\.(max_sharpe|risk_parity)\(", inspect.getsource(portfolio_queries))
