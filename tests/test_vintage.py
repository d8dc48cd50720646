"""Values as published, and the replay of engines on them."""

from __future__ import annotations

import datetime
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import vintage

DDL = "series_id string, ts date, published date, value double"


def day(n):
    return datetime.date(2000, 1, 1) + datetime.timedelta(days=n)


def test_a_cutoff_knows_the_version_of_its_time(spark):
    r = random.Random(4)
    rows = []
    for s in "ab":
        for t in range(0, 300, 10):
            p = t
            for _ in range(r.randrange(1, 5)):
                p += r.choice((0, 1, 7, 40))
                rows.append((s, day(t), day(p), r.random()))
    rows += [("a", day(0), day(-20), 9.0), ("c", None, day(1), 1.0), ("c", day(1), None, 1.0), ("c", day(1), day(2), None)]
    cuts = {"a": [day(r.randrange(320)) for _ in range(25)] + [day(-5), day(900)], "b": [day(100), day(100)]}
    df = spark.createDataFrame(rows, DDL)
    each = spark.createDataFrame([(s, c) for s, cs in cuts.items() for c in cs] + [("none", day(5)), ("a", None)], "series_id string, cutoff date")
    got = {(x["series_id"], x["cutoff"], x["ts"]): x["known"] for x in vintage.known_at(df, each).collect()}
    want = {}
    for s, cs in cuts.items():
        for c in set(cs):
            for t in {x[1] for x in rows if x[0] == s and x[1] is not None}:
                seen = [(max(x[2], t), x[2], x[3]) for x in rows if x[0] == s and x[1] == t and x[2] <= c and t <= c]
                if seen:
                    want[s, c, t] = max(seen)[2]
    assert got == want
    everywhere = vintage.known_at(df, spark.createDataFrame([(day(100),)], "cutoff date"))
    assert {(x["series_id"], x["ts"]): x["known"] for x in everywhere.collect()} == {(s, t): v for (s, c, t), v in want.items() if c == day(100) and s == "b"} | {
        (x["series_id"], x["ts"]): x["known"] for x in everywhere.where("series_id = 'a'").collect()}


def test_versions_do_not_meet_cutoffs_at_which_they_did_not_hold(spark):
    rows = [("s", day(30 * t), day(30 * t + 30 * k), float(k)) for t in range(40) for k in range(12)]
    cuts = spark.createDataFrame([("s", day(30 * t + 15)) for t in range(60)], "series_id string, cutoff date")
    known = vintage.known_at(spark.createDataFrame(rows, DDL), cuts)
    assert known.count() == known.select("cutoff", "ts").distinct().count() == sum(min(t + 1, 40) for t in range(60))
    plan = known._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def months(values, revise):
    out = []
    for t, v in enumerate(values):
        ts = datetime.date(1990 + t // 12, t % 12 + 1, 1)
        out.append(("s", ts, ts, float(v)))
        if revise is not None:
            out.append(("s", ts, ts + datetime.timedelta(days=8000), float(revise[t])))
    return out


def verdict(spark, values, revise):
    v = spark.createDataFrame(months(values, revise), DDL)
    c = vintage.capability(vintage.replayed(v, vintage.monthly_cutoffs(v, 10, 6)))
    return vintage.verdicts(c).first()


def test_skill_that_only_revised_data_have_is_lost(spark):
    rng, t = np.random.default_rng(3), np.arange(120)
    smooth = 100 * np.exp(0.02 * t)
    noisy = 100 * np.exp(rng.normal(0, 0.1, 120).cumsum())
    lost = verdict(spark, noisy, smooth)
    assert lost["revised_current"] and not lost["known_first"] and lost["verdict"] == "lost" and lost["revision"] > 5
    kept = verdict(spark, smooth, None)
    assert kept["known_first"] and kept["revised_current"] and kept["verdict"] == "kept" and kept["revision"] == 0
    walk = verdict(spark, 100 * np.exp(np.where(t % 2, 0.1, -0.1) + 0 * t), None)
    assert walk["verdict"] in ("none", "kept") and 0 < walk["cutoffs"] <= 10


def test_cutoffs_without_all_the_points_after_them_are_left_out(spark):
    v = spark.createDataFrame(months(100 + np.arange(60.0), None), DDL)
    late = spark.createDataFrame([("s", datetime.date(1994, 8, 15)), ("s", datetime.date(1993, 1, 15))], "series_id string, cutoff date")
    assert {r["cutoff"] for r in vintage.replayed(v, late).select("cutoff").distinct().collect()} == {datetime.date(1993, 1, 15)}
    assert vintage.monthly_cutoffs(v.where("ts < '1992-01-01'"), 10, 6).count() == 0
    assert vintage.replayed(v, vintage.monthly_cutoffs(v, 10, 6)).where(F.col("engine") == "winters").count() == 0
