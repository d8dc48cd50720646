"""Horizons and future dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps ahead that each frequency is judged on, and its steps in a year.
HORIZON = {"daily": 60, "weekly": 13, "monthly": 12, "quarterly": 4, "annual": 2}
PER_YEAR = {"daily": 252, "weekly": 52, "monthly": 12, "quarterly": 4, "annual": 1}


def _of(table: dict[str, int], frequency: Column) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(frequency == k, v) if out is None else out.when(frequency == k, v)
    return out.otherwise(table["daily"])  # an irregular series counts as daily


def horizon(frequency: Column) -> Column:
    return _of(HORIZON, frequency)


def per_year(frequency: Column) -> Column:
    return _of(PER_YEAR, frequency)


def least_history(h: Column) -> Column:
    """Points a series needs before engines are compared on it."""
    return F.greatest(F.lit(30), 2 * h) + h + 6


def horizon_label(n: Column, frequency: Column) -> Column:
    unit = F.when(frequency == "monthly", "month").when(frequency == "weekly", "week").when(frequency == "quarterly", "quarter").when(frequency == "annual", "year").otherwise("day")
    return F.concat(n.cast("string"), F.lit(" "), unit, F.when(n == 1, "").otherwise("s"))


def business_days(last: DataFrame, steps: int) -> DataFrame:
    """last(series_id, ts) followed by its next `steps` days from Monday to Friday, numbered h."""
    days = F.filter(F.sequence(F.date_add("ts", 1), F.date_add("ts", 2 * steps + 7)), lambda d: F.weekday(d) < 5)
    return last.select("series_id", F.posexplode(F.slice(days, 1, steps)).alias("p", "ts")).select("series_id", (F.col("p") + 1).alias("h"), "ts")


def weeks_ahead(last: DataFrame, steps: int) -> DataFrame:
    """last(series_id, ts) followed by every seventh day, numbered h."""
    h = last.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    return h.select("series_id", "h", F.date_add("ts", 7 * F.col("h")).alias("ts"))


def resolved(inferred: Column, hint: Column) -> Column:
    """The frequency inferred from the dates; where that is irregular, the one of the hint's code, else daily."""
    by_code = F.when(hint == "W", "weekly").when(hint == "M", "monthly").when(hint == "Q", "quarterly").when(hint == "A", "annual").otherwise("daily")
    return F.when(inferred == "irregular", by_code).otherwise(inferred)


def months_ahead(last: DataFrame, steps: int, months: int = 1) -> DataFrame:
    """last(series_id, ts) followed by every `months` months; the day is 28 at most, and stays so."""
    h = last.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    m = F.year("ts") * 12 + F.month("ts") - 1 + F.col("h") * months
    return h.select("series_id", "h", F.make_date(F.floor(m / 12).cast("int"), (m % 12 + 1).cast("int"), F.least(F.dayofmonth("ts"), F.lit(28))).alias("ts"))


def projection_years(start: Column, end: Column) -> Column:
    return F.datediff(end, start) / 365.25


def annual_growth(last: Column, target: Column, years: Column) -> Column:
    return F.when((last > 0) & (years > 0), (F.pow(target / last, 1 / years) - 1) * 100)
