"""Kernels that SQL does not follow: conditions of an optimum, likelihoods, draws."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import holt, portfolio, risk
from tidemark.sources import series


@pytest.fixture(scope="module")
def cov():
    a = np.random.default_rng(101).normal(size=(4, 4))
    return a @ a.T + 0.1 * np.eye(4)


def test_equal_risk_contributions(cov):
    w = portfolio.risk_parity(cov)
    parts = w * (cov @ w)
    assert abs(w.sum() - 1) < 1e-12 and (w > 0).all()
    assert np.ptp(parts) < 1e-8 * parts.mean()


def test_largest_sharpe_ratio_meets_the_conditions_of_an_optimum(cov):
    mu, cap = np.array([0.3, 0.25, 0.1, 0.2]), 0.45
    w = portfolio.max_sharpe(mu, cov, cap)
    vol = math.sqrt(w @ cov @ w)
    slope = mu / vol - (mu @ w - 0.04) * (cov @ w) / vol**3
    free = (w > 1e-6) & (w < cap - 1e-6)
    assert abs(w.sum() - 1) < 1e-9 and w.min() > -1e-12 and w.max() <= cap + 1e-9
    level = slope[free].mean()
    assert np.ptp(slope[free]) < 1e-4
    assert (slope[w <= 1e-6] <= level + 1e-4).all() and (slope[w >= cap - 1e-6] >= level - 1e-4).all()


def under_the_rate(seed):
    """Means under the rate for three names, their covariance, and the best of the six corners under a cap of 0.6."""
    a = np.random.default_rng(seed).normal(0, 1, (60, 3))
    mu, c = np.full(3, -0.0007), np.cov(a.T) * 2
    corners = [0.6 * np.eye(3)[i] + 0.4 * np.eye(3)[j] for i in range(3) for j in range(3) if i != j]
    return mu, c, max(corners, key=lambda w: (mu @ w - 0.04) / math.sqrt(w @ c @ w))


@pytest.mark.parametrize("seed", [26, 62, 87, 118, 147, 183])
def test_largest_sharpe_ratio_where_no_return_exceeds_the_rate(seed):
    mu, c, best = under_the_rate(seed)
    w = portfolio.max_sharpe(mu, c, 0.6)
    assert np.allclose(w, best, atol=1e-12) and portfolio.sharpe_residual(w, mu, c, 0.6) < 1e-8


def test_largest_sharpe_ratio_at_corners_of_small_caps():
    rng = np.random.default_rng(4)
    for cap, k in ((1.0, 4), (0.5, 5), (0.45, 5), (0.3, 6), (0.1, 3), (1.0, 1)):
        a = rng.normal(size=(40, k))
        mu, c = rng.normal(-0.2, 0.05, k), np.atleast_2d(np.cov(a.T))
        w = portfolio.max_sharpe(mu, c, cap)
        points = [portfolio.capped_simplex(v, max(cap, 1 / k)) for v in rng.normal(0, 1, (200, k))]
        assert w.max() <= max(cap, 1 / k) + 1e-9 and w.min() >= 0 and abs(w.sum() - 1) < 1e-9
        assert portfolio.sharpe_residual(w, mu, c, cap) < 1e-8
        assert max((mu @ v - 0.04) / math.sqrt(v @ c @ v) for v in points) <= (mu @ w - 0.04) / math.sqrt(w @ c @ w) + 1e-9


def test_the_search_for_the_largest_sharpe_ratio_ends_once_it_is_found(cov, monkeypatch):
    steps, nearest = [], portfolio.capped_simplex
    monkeypatch.setattr(portfolio, "capped_simplex", lambda v, cap: steps.append(1) or nearest(v, cap))
    w = portfolio.max_sharpe(np.array([0.3, 0.25, 0.1, 0.2]), cov, 0.6)
    assert len(steps) <= 21 and portfolio.sharpe_residual(w, np.array([0.3, 0.25, 0.1, 0.2]), cov, 0.6) < 1e-10


def test_corners_of_one_sharpe_ratio_are_taken_in_a_fixed_order():
    for k, cap, want in ((2, 0.6, [0.4, 0.6]), (3, 0.6, [0, 0.4, 0.6]), (5, 0.6, [0, 0, 0, 0.4, 0.6]), (6, 0.3, [0, 0, 0.1, 0.3, 0.3, 0.3]), (4, 0.5, [0, 0, 0.5, 0.5])):
        assert np.allclose(portfolio.max_sharpe(np.full(k, -0.01), np.eye(k) * 0.7, cap), want, atol=1e-12)
    for same, variance, want in (((0, 1), 0.5, [0.4, 0.6, 0]), ((0, 2), 0.5, [0.6, 0, 0.4]), ((1, 2), 0.5, [0, 0.4, 0.6]), ((0, 1), 2, [0, 0.4, 0.6]), ((0, 2), 2, [0, 0.6, 0.4]), ((1, 2), 2, [0.6, 0, 0.4])):
        c = np.full((3, 3), 0.2) + 0.8 * np.eye(3)
        c[3 - sum(same), 3 - sum(same)] = variance
        assert np.allclose(portfolio.max_sharpe(np.full(3, -0.01), c, 0.6), want, atol=1e-12)


def test_largest_sharpe_ratio_where_equal_weights_lose():
    mu, c = np.array([0.06, -0.5, -0.5]), np.diag([4.0, 0.01, 0.01])
    w = portfolio.max_sharpe(mu, c, 1.0)
    assert np.allclose(w, [1, 0, 0], atol=1e-9)


def frame(spark, x, column="r"):
    return spark.createDataFrame([(float(v),) for v in x], f"{column} double").repartition(4)


def student_likelihood(x, df, mu, s2):
    return len(x) * (math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi * s2)) - (df + 1) / 2 * np.log1p((x - mu) ** 2 / df / s2).sum()


@pytest.mark.parametrize("degrees", [2.5, 5, 12])
def test_student_fit_has_the_largest_likelihood(spark, degrees):
    x = np.random.default_rng(5).standard_t(degrees, 4_000) * 0.01 + 0.002
    f = risk.fit_student(frame(spark, x))
    mine = student_likelihood(x, f["df"], f["loc"], f["scale"] ** 2)
    near = max(student_likelihood(x, f["df"] * a, f["loc"] + b * f["scale"], f["scale"] ** 2 * c) for a in np.linspace(0.7, 1.4, 29) for b in np.linspace(-0.1, 0.1, 9) for c in np.linspace(0.8, 1.25, 19))
    assert near <= mine + 1e-6
    assert abs(math.log(f["df"] / degrees)) < 0.25 and f["n"] == 4_000
    assert f["mean"] == pytest.approx(x.mean()) and f["sd"] == pytest.approx(x.std())


def test_student_fits_of_odd_samples(spark):
    normal = np.random.default_rng(8).uniform(-1, 1, 3_000)
    assert risk.fit_student(frame(spark, normal))["df"] > 30
    assert math.isinf(risk.fit_student(frame(spark, [0.1] * 50))["df"])
    assert math.isinf(risk.fit_student(frame(spark, [0.1, 0.2] * 50))["df"])
    none = risk.fit_student(spark.createDataFrame([(None,)], "r double"))
    assert none["n"] == 0 and none["mean"] is None


def test_student_fit_of_nearly_normal_values_is_that_of_its_steps(spark):
    x = np.random.default_rng(11).normal(3e-5, 0.0568, 2_498)
    x[:20] *= 1.6
    mu, s2, df = x.mean(), 0.6 * x.var(), 5.0
    for _ in range(1_500):
        d2 = (x - mu) ** 2 / s2
        w = (df + 1) / (df + d2)
        psi = [(math.lgamma(v / 2 + 1e-4) - math.lgamma(v / 2 - 1e-4)) / 2e-4 for v in (df + 1, df)]
        slope = (psi[0] - psi[1] - 1 / df - np.log1p(d2 / df).mean() + (df + 1) * (d2 / (df * df + df * d2)).mean()) / 2
        mu, s2, df = (w * x).sum() / w.sum(), (w * (x - mu) ** 2).mean(), min(200.0, df * math.exp(min(0.5, max(-0.5, 6 * df * slope))))
    assert 30 < df < 199
    f = risk.fit_student(frame(spark, x))
    assert f["df"] == pytest.approx(df, rel=2e-5) and f["loc"] == pytest.approx(mu, abs=1e-9) and f["scale"] == pytest.approx(math.sqrt(s2), rel=1e-8)


@pytest.mark.parametrize("degrees", [0.7, 3, 40])
def test_sums_over_condensed_values(spark, degrees):
    x = np.random.default_rng(3).standard_t(degrees, 20_000) ** 3 + 5
    at, weight = risk.condensed(frame(spark, x, "x"))
    assert len(at) < 15_000 and weight.sum() == pytest.approx(20_000, rel=1e-12)
    for near, size in ((5, 1), (4.5, 0.3), (9, 20)):
        d2, mine = ((x - near) / size) ** 2, ((at - near) / size) ** 2
        assert weight @ np.log1p(mine / 3) == pytest.approx(np.log1p(d2 / 3).sum(), rel=1e-8)
        assert weight @ (at / (3 + mine)) == pytest.approx((x / (3 + d2)).sum(), rel=1e-7)


def test_student_sums_have_the_moments_asked_for(spark):
    for df in (4.0, 60.0):
        fit = {"mean": 0.001, "sd": 0.02, "df": df}
        out = risk.student_sums(spark, fit, 20_000, (5, 10), 2).toPandas()
        assert len(out) == 80_000
        for h, g in out.groupby("horizon"):
            assert abs(g["total"].mean() - h * 0.001) < 0.002 and abs(g["total"].std() / (0.02 * math.sqrt(h)) - 1) < 0.05
    wide = out[out.horizon == 10].set_index(["seed", "path"])["total"]
    assert abs(np.corrcoef(wide[1].sort_index(), wide[2].sort_index())[0, 1]) < 0.05


def test_student_numbers_have_their_distribution(spark):
    one = np.array([r[0] for r in spark.range(40_000).select(risk.student(F.lit(5.0), F.col("id"))[0]).collect()])
    want = np.sort(np.random.default_rng(1).standard_t(5, 400_000))
    for q in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99):
        assert np.quantile(one, q) == pytest.approx(np.quantile(want, q), abs=0.08)


def test_bootstrap_sums_are_those_of_their_blocks(spark):
    r = np.random.default_rng(2).normal(0, 0.02, 300)
    daily = spark.createDataFrame([(k, float(v)) for k, v in enumerate(r)], "at int, r double")
    plain = {x["path"]: x["loss"] for x in risk.bootstrap_losses(daily, 50, 12, 5, seed=1).collect()}
    sums = {x["path"]: x["total"] for x in risk.bootstrap_sums(daily, 50, (12, 7), 5, 1).where("horizon = 12").collect()}
    assert all(1 - math.exp(sums[p]) == pytest.approx(plain[p]) for p in plain) and len(sums) == 50


def test_quantiles_are_exact_for_any_number_of_rows(spark):
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=50_000), "b": rng.integers(0, 4, 900) * 1.0, "c": np.array([7.0]), "d": np.array([1.0, 2.0])}
    rows = [(k, float(v)) for k, x in groups.items() for v in x]
    df = spark.createDataFrame(rows, "k string, loss double").repartition(6)
    got = {r["k"]: r for r in risk.quantiles(df, {"lo": 0.0, "mid": 0.5, "high": 0.987, "top": 1.0}, ("k",)).collect()}
    for k, x in groups.items():
        assert [got[k][c] for c in ("lo", "mid", "high", "top")] == pytest.approx(np.quantile(x, [0, 0.5, 0.987, 1]).tolist())
        assert got[k]["n"] == len(x)
    whole = risk.quantiles(df.where("k = 'a'"), {"q": 0.95}).first()
    assert whole["q"] == pytest.approx(np.quantile(groups["a"], 0.95))


def test_starts_of_one_path_are_apart(spark):
    s = np.array([[r[f"s{k}"] for k in range(6)] for r in spark.range(4_000).select(*[(risk.draw(F.lit(42), F.col("id"), F.lit(k)) % 1_000).alias(f"s{k}") for k in range(6)]).collect()])
    c = np.corrcoef(s.T) - np.eye(6)
    assert np.abs(c).max() < 0.06
    assert len({tuple(np.diff(r) % 1_000) for r in s}) > 3_900


def test_normal_draws(spark):
    z = np.array([r[0] for r in spark.range(20_000).select(risk.normal(F.lit(1), F.col("id"))).collect()])
    assert abs(z.mean()) < 0.03 and abs(z.std() - 1) < 0.03 and abs((z**3).mean()) < 0.1


def test_block_length():
    assert [risk.block_length(*x) for x in ((30, 500), (1_000, 500), (1_000, 4), (30, 500, 7))] == [5, 10, 3, 7]


def test_mended_matrices_have_a_factor():
    m = np.array([[1.0, 0.99, 0.2], [0.99, 1.0, 0.9], [0.2, 0.9, 1.0]])
    assert np.linalg.eigvalsh(m).min() < 0
    low = risk.cholesky(m)
    assert np.allclose(low @ low.T, risk.nearest_psd(m)) and np.allclose(low, np.tril(low))


def test_fits_are_no_worse_than_their_start(spark, sf_dir):
    y = holt.training_arrays(series.monthly_segments(spark, sf_dir))
    for row in holt.fit(y).select(F.col("state.sse").alias("sse"), holt.smooth(F.col("y"), *holt.DEFAULT)["sse"].alias("start")).collect():
        assert row["sse"] <= row["start"] + 1e-9
    rows = holt.fit_season(y, 12).collect()
    assert rows and all(x["sse"] <= x["sse_start"] + 1e-9 for x in rows)
    mine = holt.with_season(y, *holt_start(), 12).select("series_id", "state.sse").collect()
    assert {x["series_id"]: round(x["sse"], 9) for x in mine} == {x["series_id"]: round(x["sse_start"], 9) for x in rows}


def holt_start():
    return 0.3, 0.05, 0.2, 0.95


def test_fitted_starts_cannot_be_bettered(spark):
    rng, t, m = np.random.default_rng(21), np.arange(72), 12
    y = {"season": 5 + 0.01 * t + 0.3 * np.sin(2 * np.pi * t / 12) + rng.normal(0, 0.05, 72), "noise": rng.normal(0, 1, 60), "short": rng.normal(0, 1, 25), "too short": rng.normal(0, 1, 23)}
    a = spark.createDataFrame([(k, v.tolist()) for k, v in y.items()], "series_id string, y array<double>").withColumns({"use_log": F.lit(False), "has_negative": F.lit(True)})
    rows = {r["series_id"]: r for r in holt.with_fitted_season(a, m).collect()}
    assert set(rows) == {"season", "noise", "short"}

    def sse(y, p, l, b, s):
        alpha, beta, gamma, phi = p
        s, out = list(s), 0.0
        for k, v in enumerate(y):
            guess = l + phi * b
            e = v - guess - s[k % m]
            l, b, s[k % m] = guess + alpha * e, phi * b + beta * e, s[k % m] + gamma * e
            out += e * e
        return out

    for k, r in rows.items():
        p = np.array([r["alpha"], r["beta"], r["gamma"], r["phi"]])
        best = sse(y[k], p, r["l0"], r["b0"], r["s0"])
        assert best == pytest.approx(r["sse"]) and r["state"]["sse"] == pytest.approx(r["sse"]) and r["sse"] <= r["sse_start"] + 1e-9
        for size in (1e-3, -1e-3, 0.05, -0.05):
            moved = [sse(y[k], p, r["l0"] + size, r["b0"], r["s0"]), sse(y[k], p, r["l0"], r["b0"] + size, r["s0"])]
            moved += [sse(y[k], p, r["l0"], r["b0"], [v + size * (j == i) for j, v in enumerate(r["s0"])]) for i in range(m)]
            assert min(moved) >= best - 1e-9
    assert rows["season"]["sse"] < 0.9 * rows["season"]["sse_start"]
