"""The tournament of Holt and Holt-Winters: states, the season test of each window, skipped and failed cutoffs, the metric's fallback."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import holt, seasonality, tournament


def monthly(spark, series):
    rows = []
    for name, values in series.items():
        y, m = 2000, 1
        for v in values:
            end = datetime.date(y + m // 12, m % 12 + 1, 1) - datetime.timedelta(days=1)
            rows.append((name, end, float(v)))
            y, m = (y + 1, 1) if m == 12 else (y, m + 1)
    return spark.createDataFrame(rows, "series_id string, ts date, value double")


@pytest.fixture(scope="module")
def points(spark):
    rng, t = np.random.default_rng(12), np.arange(120)
    season = 100 * np.exp(0.003 * t) * (1 + 0.25 * np.sin(2 * np.pi * t / 12)) * np.exp(rng.normal(0, 0.01, 120))
    trend = 100 * np.exp(0.005 * t + rng.normal(0, 0.01, 120).cumsum())
    late = np.where(t < 60, 100 + rng.normal(0, 1, 120), season)
    flat = np.where(t < 40, 50.0, 50 + rng.normal(0, 1, 120).cumsum().clip(-20, 20))
    return monthly(spark, {"season": season, "trend": trend, "late": late, "flat": flat, "short": trend[:30], "negative": trend - 200, "one": [5.0]})


@pytest.fixture(scope="module")
def rows(points):
    return tournament.evidence_rows(points).cache()


def test_states_are_those_of_training_up_to_the_cutoff(points, rows):
    """The one pass gives the errors of a filter that is run again on every training window."""
    got = {(r["series_id"], r["place"]): r for r in rows.collect()}
    values = {r["series_id"]: [x["value"] for x in sorted(r["p"])] for r in points.groupBy("series_id").agg(F.collect_list(F.struct("ts", "value")).alias("p")).collect()}
    dates = {r["series_id"]: sorted(r["d"]) for r in points.groupBy("series_id").agg(F.collect_list("ts").alias("d")).collect()}
    spark = points.sparkSession
    cut = [(s, p) for s, p in got if s in ("season", "trend")]
    train = spark.createDataFrame([(f"{s}|{p}", dates[s][i], values[s][i]) for s, p in cut for i in range(p + 1)], "series_id string, ts date, value double")
    arrays = holt.training_arrays(train)
    plain = holt.forecast(holt.with_parameters(arrays, *tournament.HOLT), 6, 0.8)
    winters = holt.seasonal_forecast(holt.with_season(arrays, *tournament.WINTERS, 12), 6, 12, 0.8)
    for engine, f in (("holt", plain), ("winters", winters)):
        for r in f.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("h", "value", "lower", "upper"))).alias("f")).collect():
            s, p = r["series_id"].split("|")
            came = np.array(values[s][int(p) + 1:int(p) + 7])
            row, side = got[s, int(p)], "base" if engine == got[s, int(p)]["baseline"] else "rival"
            assert row[f"{side}_mae"] == pytest.approx(np.abs(came - [x["value"] for x in r["f"]]).mean(), rel=1e-9)
            inside = np.mean([100.0 * (x["lower"] <= c <= x["upper"]) for x, c in zip(r["f"], came, strict=True)])
            assert row[f"{side}_cov"] == pytest.approx(inside)


def test_the_season_test_of_a_window_is_that_of_its_points(points):
    got = tournament.windows(points.where("series_id <> 'negative'"), 6, 12).where("series_id in ('season', 'trend', 'late') and place in (30, 40, 59, 80, 119)").collect()
    spark = points.sparkSession
    for place in (30, 40, 59, 80, 119):
        own = points.withColumn("k", F.row_number().over(tournament.W.partitionBy("series_id").orderBy("ts")) - 1).where(F.col("k") <= place).drop("k")
        want = {r["series_id"]: r["is_seasonal"] for r in seasonality.seasonal_test(own).collect()}
        assert {r["series_id"]: r["seasonal"] for r in got if r["place"] == place} == {s: want[s] for s in ("season", "trend", "late")}
    assert spark is not None


def test_skipped_failed_and_the_metric(rows):
    d = {r["series_id"]: r for r in tournament.decided(rows).collect()}
    assert set(d) == {"season", "trend", "late", "flat"}  # too few points, or not positive, give no evidence
    assert d["season"]["baseline"] == "winters" and d["season"]["metric"] == "mase_seasonal" and d["season"]["engine"] == "winters"
    assert d["trend"]["baseline"] == "holt" and d["trend"]["metric"] == "mase" and d["trend"]["failed"] > 0 and d["trend"]["skipped"] == 0
    assert d["late"]["baseline"] == "winters" and d["late"]["skipped"] > 0
    assert d["flat"]["metric"] == "mae"
    for r in d.values():
        assert r["cutoffs"] == r["skipped"] + r["failed"] + r["pairs"] == 8
    own = [r for r in rows.collect() if r["series_id"] == "flat"]
    assert any(r["base"] is None for r in own) and all(r["base_mae"] is not None for r in own)
    pairs = [r["base_mae"] for r in own if not r["rival_failed"]]
    assert d["flat"]["base_mean"] == pytest.approx(np.mean(pairs))


def test_fewer_pairs_than_the_rule_takes_leave_the_baseline(rows, spark):
    few = rows.where("series_id = 'trend'").withColumns({"rival_failed": F.col("place") > 60, "rival": F.lit(0.0)})
    assert tournament.decided(few).first()["engine"] == "holt"
    many = rows.where("series_id = 'trend'").withColumns({"rival_failed": F.lit(False), "rival": F.lit(0.0)})
    assert tournament.decided(many).first()["engine"] == "winters"
    none = rows.where("series_id = 'season'").withColumn("base_skipped", F.lit(True))
    r = tournament.decided(none).first()
    assert r["engine"] is None and r["skipped"] == 8 and r["pairs"] == 0


def test_leaving_the_engine_in_use_takes_twice_the_margin(rows, spark):
    near = rows.where("series_id = 'trend'").withColumns({"rival_failed": F.lit(False), "rival": F.col("base") * 0.85})
    in_use = spark.createDataFrame([("trend", "holt")], "series_id string, incumbent string")
    assert tournament.decided(near).first()["engine"] == "winters"
    assert tournament.decided(near, in_use).first()["engine"] == "holt"


def test_plan_b(points):
    out = {r["series_id"]: r for r in tournament.plan_b(points, 3).where("h = 3").collect()}
    assert {s: r["engine"] for s, r in out.items()} == {"season": "winters", "late": "winters", "trend": "holt", "flat": "holt", "short": "holt", "negative": "holt"}
    assert all(r["lower"] <= r["value"] <= r["upper"] for r in out.values())
    few = tournament.plan_b(points.where("series_id = 'trend' and ts < '2001-06-01'"), 2).first()
    assert few["low_confidence"] and few["engine"] == "holt"
