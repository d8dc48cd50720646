"""Rules that choose an engine, or say whether one is worth having, from paired errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .backtest import binomial_tail

#: Fixed values of the rules: pairs needed, margin on the mean error, its factor against the engine in use, coverage points that may be lost.
PAIRS, MARGIN, HYSTERESIS, COVERAGE_GAP = 7, 0.10, 2.0, 30.0


def sign_p(wins: Column, losses: Column) -> Column:
    """One-sided exact sign test; 1 without any decided pair."""
    return F.when(wins + losses > 0, binomial_tail(wins.cast("int"), (wins + losses).cast("int"))).otherwise(1.0)


def sign_p_both(wins: Column, losses: Column) -> Column:
    return F.least(F.lit(1.0), 2 * sign_p(F.greatest(wins, losses), F.least(wins, losses)))


def by_mean(base: Column, challenger: Column, base_cov: Column, challenger_cov: Column, margin=0.0, gap: float | None = COVERAGE_GAP) -> Column:
    """The challenger on a smaller mean error, by `margin` at least, unless it covers `gap` points less."""
    better = (challenger < base) & (challenger <= (1 - margin) * base)
    return F.when(better & (F.lit(True) if gap is None else base_cov - challenger_cov <= gap), "challenger").otherwise("base")


def robust(h: dict[str, Column], incumbent: Column, margin=MARGIN, least=PAIRS, alpha: Column | float | None = None, guard: Column | bool = False, factor: float = HYSTERESIS) -> Column:
    """The robust rule on a head-to-head (n, wins, losses, base_mean, challenger_mean and the coverages).

    Too few pairs, or a baseline without error, leave the baseline. A challenger needs a
    majority of the pairs (with alpha: a significant one) and a mean error `margin` lower;
    to leave the engine in use takes `factor` times the margin.
    """
    alpha, guard = F.lit(None).cast("double") if alpha is None else F.lit(alpha) if isinstance(alpha, float) else alpha, F.lit(guard) if isinstance(guard, bool) else guard

    def beats(wins: Column, losses: Column, mine: Column, other: Column, m: Column) -> Column:
        majority = F.when(alpha.isNull(), wins > losses).otherwise(sign_p(wins, losses) < alpha)
        return majority & (mine <= (1 - m) * other)

    guarded = ~guard | (h["base_cov"] - h["challenger_cov"] <= COVERAGE_GAP)
    wide = F.lit(margin) * factor if isinstance(margin, float) else margin * factor
    need = F.when(incumbent.isNull(), margin).otherwise(wide)
    away = beats(h["losses"], h["wins"], h["base_mean"], h["challenger_mean"], wide) | ~guarded
    to = beats(h["wins"], h["losses"], h["challenger_mean"], h["base_mean"], need) & guarded
    challenger = F.when(F.coalesce(incumbent == "challenger", F.lit(False)), ~away).otherwise(to)
    return F.when((h["n"] >= least) & (h["base_mean"] != 0) & challenger, "challenger").otherwise("base")


def columns(*names: str) -> dict[str, Column]:
    return {n: F.col(n) for n in names}


H2H = ("n", "wins", "losses", "base_mean", "challenger_mean", "base_cov", "challenger_cov")


def skill(paired: DataFrame, choices: DataFrame, both: bool = True) -> DataFrame:
    """Whether the chosen engine adds anything to the naive forecast that errs less in total (on a tie, and with both=False, the random walk).

    adds: a majority of at least 7 pairs and a mean error 10 percent lower; adds_nothing
    otherwise; not_evaluated with fewer pairs.
    """
    x = paired.join(choices.select("series_id", "choice"), "series_id").withColumn("model", F.when(F.col("choice") == "challenger", F.col("challenger")).otherwise(F.col("base")))
    x = x.where("model is not null and rw is not null and snaive is not null")
    stricter = x.groupBy("series_id").agg(F.when(F.lit(both) & (F.sum("snaive") < F.sum("rw")), "seasonal").otherwise("random_walk").alias("naive"))
    x = x.join(stricter, "series_id").withColumn("rival", F.when(F.col("naive") == "seasonal", F.col("snaive")).otherwise(F.col("rw")))
    g = x.groupBy("series_id", "naive").agg(
        F.count("*").alias("n"), F.count_if(F.col("model") < F.col("rival")).alias("wins"), F.count_if(F.col("model") > F.col("rival")).alias("losses"),
        F.avg("model").alias("model_mean"), F.avg("rival").alias("naive_mean"))
    adds = (F.col("wins") > F.col("losses")) & (F.col("naive_mean") > 0) & (F.col("model_mean") <= (1 - MARGIN) * F.col("naive_mean"))
    return g.withColumn("state", F.when(F.col("n") < PAIRS, "not_evaluated").when(adds, "adds").otherwise("adds_nothing"))


def select_engine(history: DataFrame, catalog: DataFrame, choices: DataFrame, least: int = 48, short: int = 60) -> DataFrame:
    """Which engine runs for each of history(series_id, n), and why: the catalog's, the one decided on evidence, else the base.

    Evidence counts from `least` points on; without catalog or evidence a series under
    `short` points is named as short, and under `least` its forecast is of low confidence.
    """
    x = history.join(catalog, "series_id", "left").join(choices.select("series_id", "choice"), "series_id", "left")
    choice = F.when(F.col("n") >= least, F.col("choice"))
    return x.select(
        "series_id", F.coalesce("kind", F.when(choice.isNotNull(), "discovered").when(F.col("n") < short, "short history").otherwise("default")).alias("reason"),
        F.coalesce("catalog_engine", choice, F.lit("base")).alias("engine"), (F.col("kind").isNull() & (F.col("n") < least)).alias("low_confidence"))
