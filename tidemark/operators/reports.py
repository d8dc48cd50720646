"""What a report states about a forecast, a series or a thesis: labels, alerts, checks of claims, and documents in JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Lower ends of the seven bands of a correlation, and how far under the nearest bound a price is a breach.
BANDS = ((0.75, "strong"), (0.4, "clear"), (0.15, "weak"))
BREACH = 0.98
STRONG = 0.7


def cone(last: Column, target: Column, lower: Column, upper: Column) -> list[Column]:
    """Change to the target and width of the cone in percent, 0 where their base is not positive, and half the width."""
    def pct(x: Column, base: Column) -> Column:
        return F.when(base > 0, x / base * 100).otherwise(0.0)

    return [pct(target - last, last).alias("change_pct"), pct(upper - lower, target).alias("cone_pct"), ((upper - lower) / 2).alias("half_width")]


def strength(r: Column) -> Column:
    """Band of a correlation: none, or weak, clear or strong with its direction."""
    out = F.lit("none")
    for at, name in reversed(BANDS):
        out = F.when(r >= at, f"{name} positive").when(r <= -at, f"{name} negative").otherwise(out)
    return out


def formatted(value: Column, kind: Column, unit: Column, digits: int = 2) -> Column:
    """A price with its sign in front, any other value with its unit behind, if it has one."""
    text = F.format_string(f"%.{digits}f", value)
    named = F.trim(F.coalesce(unit, F.lit("")))
    return F.when(kind == "equity", F.concat(F.lit("$"), text)).when(named != "", F.concat_ws(" ", text, named)).otherwise(text)


def meta_text(kind: Column, unit: Column, source: Column, frequency: Column, adjustment: Column) -> Column:
    """What a series is by its own metadata; never a guessed unit."""
    def some(c: Column) -> Column:
        return F.nullif(c, F.lit(""))

    return F.when(kind != "macro", F.coalesce(unit, F.lit(""))).when(source == "unavailable", "no metadata").otherwise(F.concat_ws(" · ", some(unit), some(frequency), some(adjustment)))


def revision_note(state: Column, adjustment: Column, held_up: Column) -> Column:
    """The note under a verdict that was measured on revised data: only for one that adds, on a seasonally adjusted series that did not hold up on the data as first published."""
    a = F.upper(F.trim(F.coalesce(adjustment, F.lit(""))))
    none = (state != "adds") | (a == "") | (a == "NSA") | F.coalesce(held_up, F.lit(False))
    return F.when(none, None).when(held_up.isNull(), "not checked as published").otherwise("did not hold as published")


def json_inside(text: Column) -> Column:
    """The JSON object in a noisy text: the whole, else what a fence holds, else from the first brace to the last; null if none parses."""
    t = F.trim(text)

    def parsed(c: Column) -> Column:
        return F.when(F.get_json_object(c, "$").isNotNull() & c.startswith("{"), c)

    return F.coalesce(parsed(t), parsed(F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)), parsed(F.regexp_extract(t, r"(?s)\{.*\}", 0)))


def ids_in(text: Column) -> Column:
    """Strings of a JSON array; an empty array for null or bad JSON."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def risk_profile(was_inverse: Column, was_leverage: Column, now_inverse: Column, now_leverage: Column) -> Column:
    """Why a replacement is not allowed: another direction, or more leverage (1 where none is stated); null if it is."""
    was, now = F.coalesce(was_leverage, F.lit(1.0)), F.coalesce(now_leverage, F.lit(1.0))
    return F.when(was_inverse != now_inverse, "direction").when(now > was, "leverage")


def grounded(items: DataFrame) -> DataFrame:
    """items(found, problems, fix_found, fix_problems, fix_breaks) with `grounding`: verified, repaired by its one replacement, or discarded."""
    ok = F.col("found") & (F.size("problems") == 0)
    fixed = F.coalesce(F.col("fix_found") & (F.size("fix_problems") == 0) & F.col("fix_breaks").isNull(), F.lit(False))
    return items.withColumn("grounding", F.when(ok, "verified").when(fixed, "repaired").otherwise("discarded"))


def allowed(items: DataFrame) -> DataFrame:
    """Only what is grounded enters an analysis."""
    return items.where(F.col("grounding").isin("verified", "repaired"))


def real_only(points: DataFrame, source: str = "source") -> DataFrame:
    """points, less those of made-up series: a series with any synthetic point goes as a whole."""
    w = W.partitionBy("series_id")
    return points.withColumn("_synthetic", F.max((F.col(source) == "synthetic").cast("int")).over(w)).where("_synthetic = 0").drop("_synthetic")


def snapshot(points: DataFrame, categories: DataFrame) -> DataFrame:
    """documents(key, part, document): one JSON document a series, {series_id, category, values: {date: value}}, by category."""
    v = points.groupBy("series_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("ts").cast("string").alias("k"), "value")))).alias("values"))
    d = v.join(categories, "series_id", "left")
    return d.select(F.col("series_id").alias("key"), F.col("category").alias("part"), F.to_json(F.struct("series_id", "category", "values")).alias("document"))


SNAPSHOT = "series_id string, category string, values map<string,double>"


def snapshot_points(documents: DataFrame) -> DataFrame:
    """points(series_id, category, ts, value) of documents that read_documents() gives with SNAPSHOT."""
    d = documents.select("document.series_id", "document.category", F.explode("document.values").alias("ts", "value"))
    return d.withColumn("ts", F.col("ts").cast("date"))


def default_cutoff(n: Column, frequency: Column, horizon: Column) -> Column:
    """The place at which a backtest is cut unless told otherwise; null for a series too short."""
    return (
        F.when((frequency != "daily") & (n > 30), F.greatest(F.lit(20), n - 1 - horizon)).when(n > 80, F.greatest(F.lit(30), n - 80))
        .when(n > 30, F.floor(n * 0.7).cast("int"))
    )
