"""Evidence on engines: their forecasts at many cutoffs of a series, side by side with what came and with the naive ones.

One pass over a series gives the states of every engine at every cutoff: the filter's
state after a point is what training up to that point leaves, so no cutoff copies its
history. Everything after the states is DataFrame work.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: alpha, beta and phi of the engines.
ENGINES = {"base": (0.3, 0.1, 0.95), "challenger": (0.6, 0.05, 0.9)}
_WALK = (
    "series_id string, place int, cutoff date, engine string, alpha double, beta double, phi double, l double, b double, s2 double, last double, "
    "scale double, season_scale double, move double, jump double, season array<double>, actual array<double>, dates array<date>"
)


def arrays(points: DataFrame) -> DataFrame:
    """series_id, n, dates, values: a row a series, in order of time."""
    p = points.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("ts", "value"))).alias("p"))
    return p.select("series_id", F.size("p").alias("n"), F.transform("p", lambda x: x["ts"]).alias("dates"), F.transform("p", lambda x: x["value"]).alias("values"))


def even(n: Column, k: int, horizon: int, least: int = 30, recent: int | None = None) -> Column:
    """Places (from 0) of k evenly spaced cutoffs, rounded half to even, each with `least` points up to it and `horizon` after it; recent: only among the last so many."""
    last = n - horizon - 1
    first = F.lit(least - 1) if recent is None else F.greatest(F.lit(least - 1), last - recent)
    at = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(first + i * (last - first) / max(1, k - 1)).cast("int"))
    return F.when(last >= least - 1, F.array_distinct(at)).otherwise(F.array().cast("array<int>"))


def _states(y: np.ndarray, engines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Level, trend and sum of squared errors after each point, a column an engine."""
    a, b, f = engines.T
    level, trend, sse = np.full(len(a), y[0]), np.full(len(a), y[1] - y[0]), np.zeros(len(a))
    out = [(level, trend, sse)]
    for v in y[1:]:
        guess = level + f * trend
        e = v - guess
        level, trend, sse = guess + a * e, f * trend + a * b * e, sse + e * e
        out.append((level, trend, sse))
    return tuple(np.stack(x) for x in zip(*out, strict=True))


def walk(points: DataFrame, k: int, horizon: int, engines: dict = ENGINES, m: int = 12, recent: int | None = None, window: int | None = None) -> DataFrame:
    """A row for each series, cutoff and engine: its state, the scales of the training points, the last season and the actual values after the cutoff.

    Series are modelled as logs; those with a value that is not positive, or with too few
    points for a cutoff, give no rows. jump: the last step by the robust deviation of those before. window: train on the last so many points only.
    """
    rows = arrays(points).withColumn("places", even(F.col("n"), k, horizon, recent=recent)).where("size(places) > 0 and array_min(values) > 0")
    names, params = list(engines), np.array(list(engines.values()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for series_id, dates, values, places in zip(pdf["series_id"], pdf["dates"], pdf["values"], pdf["places"], strict=True):
                v = np.asarray(values, dtype=float)
                y = np.log(v)
                whole = None if window else _states(y, params)
                for p in places:
                    first = max(0, p + 1 - window) if window else 0
                    level, trend, sse = (x[p - first] for x in (whole or _states(y[first:p + 1], params)))
                    train = v[first:p + 1]
                    moves = np.abs(y[first + horizon:p + 1] - y[first:p + 1 - horizon])
                    before, last = np.diff(y[first:p]), abs(y[p] - y[p - 1])
                    spread = 1.4826 * np.median(np.abs(before - np.median(before)))
                    for i, name in enumerate(names):
                        s2 = sse[i] / (p - first) if p - first > 1 and sse[i] > 0 else 1e-4
                        out.append((
                            series_id, p, dates[p], name, *params[i], level[i], trend[i], s2, v[p], np.abs(np.diff(train)).mean(),
                            np.abs(train[m:] - train[:-m]).mean() if len(train) > m else None, moves.max() if len(moves) else None, last / spread if spread > 0 else None,
                            train[-m:], v[p + 1:p + 1 + horizon], list(dates[p + 1:p + 1 + horizon]),
                        ))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _WALK.split(", ")])

    return rows.select("series_id", "dates", "values", "places").mapInPandas(run, _WALK)


def steps(walked: DataFrame, horizon: int, level: float = 0.8, m: int = 12) -> DataFrame:
    """walked with a row for each step h: ts, actual, mu and se of the forecast's log, value, lower, upper, and the two naive forecasts."""
    z = NormalDist().inv_cdf((1 + level) / 2)
    h = walked.select("*", F.posexplode(F.arrays_zip("dates", "actual")).alias("p", "x")).where(F.col("p") < horizon)
    h = h.withColumns({"h": F.col("p") + 1, "ts": F.col("x.dates"), "actual": F.col("x.actual")})
    weights = F.expr("aggregate(filter(sequence(0, h - 1), j -> j > 0), 0D, (s, j) -> s + pow(alpha + alpha * beta * phi * (1 - pow(phi, j)) / (1 - phi), 2))")
    h = h.withColumns({"damp": F.expr("phi * (1 - pow(phi, h)) / (1 - phi)"), "var": F.col("s2") * (1 + weights)})
    h = h.withColumns({"mu": F.col("l") + F.col("damp") * F.col("b"), "se": F.sqrt("var")})
    return h.withColumns({
        "value": F.exp(F.col("mu") + F.col("var") / 2), "lower": F.exp(F.col("mu") - z * F.col("se")), "upper": F.exp(F.col("mu") + z * F.col("se")),
        "rw": F.col("last"), "snaive": F.expr(f"element_at(season, (h - 1) % {m} + 1)"),
    }).drop("p", "x", "dates", "season")


def pairs(stepped: DataFrame) -> DataFrame:
    """Errors side by side, a row for each series and cutoff: mean absolute ones of base, challenger, rw and snaive, and the coverages."""
    base = F.col("engine") == "base"
    inside = F.col("actual").between(F.col("lower"), F.col("upper")).cast("double") * 100

    def mean(c: Column, when: Column) -> Column:
        return F.avg(F.when(when, c))

    return stepped.groupBy("series_id", "place", "cutoff").agg(
        mean(F.abs(F.col("actual") - F.col("value")), base).alias("base"), mean(F.abs(F.col("actual") - F.col("value")), ~base).alias("challenger"),
        mean(inside, base).alias("base_cov"), mean(inside, ~base).alias("challenger_cov"),
        mean(F.abs(F.col("actual") - F.col("rw")), base).alias("rw"), mean(F.abs(F.col("actual") - F.col("snaive")), base).alias("snaive"),
    )


def head_to_head(paired: DataFrame, *keys: str) -> DataFrame:
    """n, wins, losses, ties, means and mean coverages of the challenger against the base, for each group of paired errors."""
    return paired.where("base is not null and challenger is not null").groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.col("challenger") < F.col("base")).alias("wins"), F.count_if(F.col("challenger") > F.col("base")).alias("losses"),
        F.count_if(F.col("challenger") == F.col("base")).alias("ties"), F.avg("base").alias("base_mean"), F.avg("challenger").alias("challenger_mean"),
        F.avg("base_cov").alias("base_cov"), F.avg("challenger_cov").alias("challenger_cov"),
    )


def triples(paired: DataFrame) -> DataFrame:
    """The cutoffs of each three (i < j < k) of a series, with the three rows' sums: a row for each triple, by a bounded self-join."""
    k = paired.withColumn("i", F.row_number().over(W.partitionBy("series_id").orderBy("place")))
    columns = ["base", "challenger", "base_cov", "challenger_cov"]

    def side(name: str) -> DataFrame:
        return k.select("series_id", F.col("i").alias(name), F.struct(*columns).alias(f"v{name}"))

    t = side("a").join(side("b"), "series_id").where("a < b").join(side("c"), "series_id").where("b < c")
    return t.select("series_id", "a", "b", "c", *[((F.col(f"va.{x}") + F.col(f"vb.{x}") + F.col(f"vc.{x}")) / 3).alias(x) for x in columns])
