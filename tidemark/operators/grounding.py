"""Proposed items held against a catalog: verified, repaired once by a candidate, or discarded; themes by stored rules.

Lookups are joins: ids against the catalog, words against an inverted index of its titles,
phrases against a table of rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.sources.shared import settled

from . import reports, texts


def lower_words(text: Column) -> Column:
    """The words of a text between blanks, A-Z in lower case; an empty array for null."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, "[ \t\n\x0b\f\r]+"), lambda w: w != "")


def word_index(catalog: DataFrame) -> DataFrame:
    """(word, id, popularity, weight) of catalog(id, title, popularity): each title's words, weighing ln(titles / titles with the word) + 1."""
    n = catalog.agg(F.count("*").alias("_n"))
    x = catalog.select("id", "popularity", F.explode(F.array_distinct(lower_words(F.col("title")))).alias("word"))
    df = x.groupBy("word").agg(F.count("*").alias("_df")).join(F.broadcast(n))
    return x.join(df, "word").select("word", "id", "popularity", (F.ln(F.col("_n") / F.col("_df")) + 1).alias("weight"))


def title_kinds(index: DataFrame, k: int) -> DataFrame:
    """(kind, words, id, popularity): the entries of word_index() by the set of their words, the k first by popularity, then id, of each.

    kind is the id of the first; words has (word, weight) of each word.
    """
    own = index.repartition("id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("word", "weight"))).alias("words"), F.max("popularity").alias("popularity"))
    w = W.partitionBy("words").orderBy(F.desc("popularity"), "id")
    first = own.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= k)
    return first.select(F.first("id").over(w).alias("kind"), "words", "id", "popularity")


def candidates(concepts: DataFrame, index: DataFrame, k: int = 5, slices: int = 8) -> DataFrame:
    """(concept, id, score, rank): the k best catalog entries for each concept, by the weights of the words they share, then popularity, then id.

    Concepts are searched once each, however many items have them. Scores count to nine
    digits, so that the order of a sum decides nothing. Null or wordless concepts and
    those without a shared word have no candidate. Entries with the same words have the same
    score, so a concept meets the kinds of titles; its k best entries are among the first k
    of its k best kinds. A word's kinds are dealt to `slices` tasks, each of which gets the
    concepts of the word; the partial sums of a pair are added before they are shuffled.
    """
    kinds = settled(title_kinds(index, k))
    q = concepts.select("concept").where("concept is not null").distinct().withColumn("word", F.explode(F.array_distinct(lower_words(F.col("concept")))))
    q = q.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    first = kinds.where(F.col("kind") == F.col("id"))
    words = first.select("kind", "popularity", F.pmod(F.xxhash64("kind"), F.lit(slices)).cast("int").alias("_slice"), F.explode("words").alias("w")).select("kind", "popularity", "_slice", "w.*")
    s = q.join(words, ["word", "_slice"]).groupBy("concept", "kind").agg(F.round(F.sum("weight"), 9).alias("score"), F.max("popularity").alias("popularity"))
    w = W.partitionBy("concept").orderBy(F.desc("score"), F.desc("popularity"), "kind")
    best = s.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).select("concept", "kind", "score")
    w = W.partitionBy("concept").orderBy(F.desc("score"), F.desc("popularity"), "id")
    return best.join(kinds.select("kind", "id", "popularity"), "kind").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("concept", "id", "score", "rank")


def ground(items: DataFrame, catalog: DataFrame, least: float = 0.5) -> DataFrame:
    """items(item, proposed, concept, claim) with grounding, id, problems, fix, refusal.

    catalog(id, title, popularity, leverage, is_inverse). An item whose proposed id is in the
    catalog and whose claim has no problem there is verified. Any other gets one repair: the
    best candidate for its concept other than what it proposed, if it shares words of `least`
    of the concept's weight (words that the catalog has), the claim has no problem with it,
    and it keeps direction and does not raise leverage over what was proposed. Then it is
    repaired and id is the candidate's; else it is discarded and refusal says why. Null
    proposals are not in the catalog. Every item gives one row; catalog ids are unique.
    """
    index = settled(word_index(catalog))
    facts = catalog.select(F.col("id").alias("_id"), "leverage", "is_inverse")
    x = items.join(facts, F.col("proposed") == F.col("_id"), "left").withColumnsRenamed({"leverage": "was_leverage", "is_inverse": "was_inverse"}).withColumn("exists", F.col("_id").isNotNull()).drop("_id")
    said, inverse = texts.leverage(F.col("claim")), texts.says_inverse(F.coalesce("claim", F.lit("")))
    x = x.withColumn("problems", texts.problems(said, F.col("was_leverage"), inverse, F.coalesce("was_inverse", F.lit(False)), F.col("exists")))
    x = settled(x)
    words = index.groupBy("word").agg(F.max("weight").alias("weight"))
    asked = x.where(F.size("problems") > 0).select("concept").distinct()
    total = asked.withColumn("word", F.explode(F.array_distinct(lower_words(F.col("concept"))))).join(words, "word").groupBy("concept").agg(F.sum("weight").alias("total"))
    # the best two: one of them may be what was proposed
    best = settled(candidates(asked, index, 2).join(total, "concept").where(F.col("score") >= least * F.col("total")))
    best = best.groupBy("concept").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("best"))
    y = x.join(best, "concept", "left").withColumn("fix", F.when(F.size("problems") > 0, F.get(F.filter("best", lambda b: ~F.coalesce(b["id"] == F.col("proposed"), F.lit(False))), F.lit(0))["id"]))
    new = facts.withColumnsRenamed({"_id": "_fix", "leverage": "now_leverage", "is_inverse": "now_inverse"})
    y = y.join(new, F.col("fix") == F.col("_fix"), "left").withColumns({
        "found": F.col("exists"), "fix_found": F.col("_fix").isNotNull(),
        "fix_problems": texts.problems(said, F.col("now_leverage"), inverse, F.coalesce("now_inverse", F.lit(False)), F.col("_fix").isNotNull()),
        "fix_breaks": F.when(F.col("exists"), reports.risk_profile(F.col("was_inverse"), F.col("was_leverage"), F.col("now_inverse"), F.col("now_leverage"))),
    })
    g = reports.grounded(y)
    refusal = F.when(F.col("grounding") == "discarded", F.when(~F.col("fix_found"), "no candidate").when(F.size("fix_problems") > 0, F.array_join("fix_problems", ",")).otherwise(F.col("fix_breaks")))
    own = F.when(F.col("grounding") == "verified", F.col("proposed")).when(F.col("grounding") == "repaired", F.col("fix"))
    return g.select(*items.columns, "grounding", own.alias("id"), "problems", "fix", refusal.alias("refusal"))


def themes(texts_: DataFrame, rules: DataFrame, generic: str = "general") -> DataFrame:
    """texts_(key, text) with theme: that of the rule of least priority whose phrase stands in the text.

    rules(priority, theme, phrase): phrases are words in a row, compared without regard to
    A-Z's case. Words and their runs of the rules' lengths are made once and joined to the
    rules, so the work does not grow with their number; two rules of one priority go by
    phrase. A text without a phrase, or null, is `generic`. Keys are unique; empty phrases
    match nothing.
    """
    r = rules.where("priority is not null and theme is not null").select("priority", "theme", lower_words(F.col("phrase")).alias("_w")).where(F.size("_w") > 0)
    r = settled(r.select("priority", "theme", F.array_join("_w", " ").alias("phrase"), F.size("_w").alias("_n")))
    r = r.groupBy("phrase").agg(F.min(F.struct("priority", F.col("phrase").alias("p"), "theme")).alias("rule"))
    lengths = rules.select(F.size(lower_words(F.col("phrase"))).alias("n")).where("n > 0").agg(F.sort_array(F.collect_set("n")).alias("_lengths"))  # the lengths that occur
    x = texts_.select("key", lower_words(F.col("text")).alias("_w")).join(F.broadcast(lengths)).select("key", "_w", F.explode("_lengths").alias("_n"))
    runs = F.transform(F.sequence(F.lit(1), F.size("_w") - F.col("_n") + 1), lambda i: F.array_join(F.slice("_w", i, F.col("_n")), " "))
    x = x.where(F.size("_w") >= F.col("_n")).select("key", F.explode(F.array_distinct(runs)).alias("phrase"))
    first = x.join(r, "phrase").groupBy("key").agg(F.min("rule").alias("rule"))
    return texts_.join(first, "key", "left").withColumn("theme", F.coalesce("rule.theme", F.lit(generic))).drop("rule")
