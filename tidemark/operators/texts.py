"""Rules on short texts: redaction, leverage claims, contradictions, routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Themes and the words that lead to them; the first theme with a word in the text wins.
THEMES = (
    ("energy", ("oil", "gas", "energy")),
    ("technology", ("chip", "cloud", "software")),
    ("rates", ("bond", "rate", "inflation")),
)


def redacted(text: Column) -> Column:
    """Values of key and token parameters, and long runs that look like keys, replaced by ***."""
    x = F.regexp_replace(text, r"((?:api_key|apikey|token|secret)=)[^&\s]+", "$1***")
    return F.regexp_replace(x, r"\b[0-9a-f]{32,}\b", "***")


def leverage(text: Column) -> Column:
    """The factor of a claim such as 2x or 1,5x; null without one."""
    found = F.regexp_extract(F.lower(text), r"(?:^|[^0-9a-z.,])([0-9]{1,2}(?:[.,][0-9])?)x(?:[^a-z]|$)", 1)
    return F.nullif(F.replace(found, F.lit(","), F.lit(".")), F.lit("")).cast("double")


def says_inverse(text: Column) -> Column:
    return F.lower(text).rlike(r"\b(inverse|short|bear)\b")


def theme(text: Column, themes: tuple = THEMES) -> Column:
    """The first theme of which a word stands in the text, else general."""
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    out = None
    for name, words in themes:
        hit = F.lit(False)
        for w in words:
            hit = hit | padded.contains(f" {w} ")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("general")


def problems(said: Column, real: Column, says_inv: Column, is_inv: Column, exists: Column) -> Column:
    """What is wrong with a claim: an array of rule names, empty if nothing."""
    return F.array_compact(F.array(
        F.when(~exists, "not_found"),
        F.when(exists & said.isNotNull() & real.isNotNull() & (said != real), "other_leverage"),
        F.when(exists & said.isNotNull() & real.isNull(), "not_leveraged"),
        F.when(exists & says_inv & ~is_inv, "not_inverse"),
        F.when(exists & ~says_inv & is_inv, "inverse_unsaid"),
    ))


def failure_kind(status: Column, message: Column) -> Column:
    """Category of a failed call from its status and message."""
    m = F.lower(message)
    return (
        F.when((status == 429) | m.contains("rate limit") | m.contains("quota"), "quota").when(status.isin(401, 403), "auth")
        .when(status >= 500, "server").when(m.contains("timeout") | m.contains("timed out"), "timeout").otherwise("other")
    )


def contradictions(text: Column, declared: Column, kind: Column, category: Column, issuer: Column, issuers: tuple = (), themes: tuple = ()) -> Column:
    """What a description (in lower case) says against an instrument's facts: an array of rule names.

    type: declared as the other kind; called: the text speaks of the other kind; issuer: it
    names a known issuer (word, mark) that is not the instrument's; leverage: both state one
    and they differ; inverse_unsaid, not_inverse: the direction; theme: a theme that is not
    in the category. What can't be checked is no contradiction.
    """
    def any_of(column: Column, words) -> Column:
        hit = F.lit(False)
        for w in words:
            hit = hit | column.contains(w)
        return hit

    equity, fund = kind == "EQUITY", kind == "ETF"
    wrong_issuer, wrong_theme = F.lit(False), F.lit(False)
    for word, mark in issuers:
        wrong_issuer = wrong_issuer | (text.contains(word) & ~issuer.contains(mark))
    for name, words in themes:
        wrong_theme = wrong_theme | (text.contains(name) & ~any_of(category, words))
    really, said = says_inverse(category), says_inverse(text)
    return F.array_compact(F.array(
        F.when((declared == "etf") & equity | (declared == "stock") & fund, "type"),
        F.when(equity & text.rlike(r"\b(etf|fund)\b") | fund & text.rlike(r"\bthe company\b"), "called"),
        F.when(wrong_issuer, "issuer"),
        F.when(leverage(text) != leverage(category), "leverage"),
        F.when(really & ~said, "inverse_unsaid").when(fund & ~really & said, "not_inverse"),
        F.when(fund & wrong_theme, "theme"),
    ))


def money(value: Column, millions_from: float = 1e6) -> Column:
    """An amount in billions, in millions from `millions_from` on, or whole."""
    return (
        F.when(value >= 1e9, F.format_string("$%.2fB", value / 1e9)).when(value >= millions_from, F.format_string("$%.2fM", value / 1e6))
        .otherwise(F.format_string("$%.2f", value))
    )
