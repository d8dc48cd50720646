"""Secret scan over a trigram inverted index, in DataFrame functions only.

Each rule's expression is turned into a Boolean query over trigrams of lower-cased text:
any of several sets of which all trigrams must occur. The index is built from the texts in
one pass over their trigrams, and holds a posting for each document and trigram, here of those that
some rule asks for; intersecting the postings leaves a
rule's candidates, and only those are matched against the expression. A rule whose
matches share no trigram is matched against every document.

Matches have places: splitting the text by the expression gives the stretches between
matches, and their lengths and those of the matches add up to every start and end.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as op  # the standard library's parsed form of an expression
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, set_aside, stored


@dataclass(frozen=True)
class Rule:
    """kind, an expression (Java's and Python's alike), and the least length of one of its groups (0: the match)."""

    kind: str
    pattern: str
    group: int
    least: int


#: Rules of the registered query, in the order in which kinds are listed.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)


def _strings(tree, most: int = 64) -> tuple[set[str] | None, list[set[str]]]:
    """For a parsed expression: all the strings it can match (None: not a short list), and what its matches must hold.

    What must hold is a list of sets; from each set, at least one string occurs in any match.
    """
    exact: set[str] | None = {""}
    needs: list[set[str]] = []
    runs: list[set[str]] = []  # the exact runs between parts that can be anything

    def close() -> None:
        nonlocal exact
        if exact and all(exact):
            runs.append(exact)
        exact = {""}

    whole = True
    for what, arg in tree:
        own: set[str] | None = None
        if what is op.LITERAL:
            own = {chr(arg).lower()}
        elif what is op.SUBPATTERN:
            own, inner = _strings(arg[-1], most)
            needs += inner
        elif what is op.BRANCH:
            parts = [_strings(x, most) for x in arg[1]]
            if all(p[0] is not None for p in parts):
                own = set().union(*[p[0] for p in parts])
        elif what in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[1] <= 1:
            inner, _ = _strings(arg[2], most)
            own = None if inner is None else inner | {""}
        elif what is op.IN and all(k is op.LITERAL for k, _ in arg) and len(arg) <= 4:
            own = {chr(c).lower() for _, c in arg}
        elif what is op.AT:
            own = {""}
        if own is not None and len(exact) * len(own) <= most:
            exact = {a + b for a in exact for b in own}
        else:
            whole = False
            close()
            if own is not None:
                exact = own
    result = exact if whole else None
    if not whole:
        close()
        needs += runs
    return result, needs


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Sets of trigrams of which one must lie whole in any lower-cased text that matches; empty: no such sets."""
    exact, needs = _strings(parser.parse(pattern))
    choices = ([exact] if exact else []) + needs
    best: list[frozenset[str]] = []
    for strings in choices:
        sets = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}
        if all(sets) and (not best or min(map(len, sets)) > min(map(len, best))):
            best = sorted({x for x in sets if not any(y < x for y in sets)}, key=sorted)
    return best


def trigrams_of(text: Column, chunk: int = 8_192) -> Column:
    """The distinct trigrams of a lower-cased text, an array for each stretch of `chunk` characters; stretches overlap by two. Null and texts under three characters have none."""
    low = F.lower(text)
    starts = F.sequence(F.lit(0), F.greatest(F.length(low) - 3, F.lit(0)), F.lit(chunk - 2))
    stretches = F.when(F.length(low) <= chunk, F.array(low)).otherwise(F.transform(starts, lambda k: F.substring(low, k + 1, F.lit(chunk))))
    each = r"(?s)(?![\uDC00-\uDFFF])(?=(...))"  # not from the middle of a character
    return F.transform(stretches, lambda x: F.array_distinct(F.regexp_extract_all(x, F.lit(each), 1)))


def postings(docs: DataFrame, trigrams: list[str] | None = None) -> DataFrame:
    """The inverted index: (trigram, doc_id), of all trigrams of the lower-cased texts, or of those asked for.

    One pass over a text makes its trigrams; those asked for are kept by a hash join, so the
    pass costs the same for any number of rules. A posting comes once for each stretch of a
    long text that holds it, and for each row of a repeated doc_id; null ids have postings
    like others, and rows of one id share what they hold.
    """
    each = docs.select("doc_id", F.explode(trigrams_of(F.col("text"))).alias("grams")).select("doc_id", F.explode("grams").alias("trigram"))
    if trigrams is not None:
        asked = docs.sparkSession.createDataFrame([(t,) for t in trigrams], "trigram string")
        each = each.join(F.broadcast(asked), "trigram")  # as many rows as the rules have trigrams
    return stored(each.select("doc_id", "trigram"), "trigrams")


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """doc_id and the kinds whose Boolean query its postings satisfy.

    A posting meets the sets that ask for its trigram, by a hash join; a set is held where
    the bits of its trigrams are all there (of the first 62: more are not needed to leave
    only candidates). Repeated postings and ids, null ones too, are one row.
    """
    sets, n = [], 0
    for kind, choices in queries.items():
        for choice in choices:
            own = sorted(choice)[:62]
            sets += [(t, kind, n, 1 << i, (1 << len(own)) - 1) for i, t in enumerate(own)]
            n += 1
    asked = index.sparkSession.createDataFrame(sets, "trigram string, kind string, choice int, bit long, whole long")
    met = index.join(F.broadcast(asked), "trigram")  # as many rows as the rules' sets have trigrams
    held = met.groupBy("doc_id", "kind", "choice", "whole").agg(F.bit_or("bit").alias("held")).where("held = whole")
    return held.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _before(values: Column, zero: int, combine) -> Column:
    """For each of an array of numbers: zero combined with all numbers before it; and once more with all of them.

    In runs of about the square root of the array's length, so that no fold copies or
    rereads the whole array for each of its items.
    """
    def fold(items):
        return F.aggregate(items, F.lit(zero), combine)

    def of(v):
        n = F.size(v)
        run = F.ceil(F.sqrt(n + F.lit(1))).cast("int")

        def with_totals(totals):
            def one(k):
                own = F.slice(v, k * run + 1, run)
                return _let(F.struct(own.alias("own"), fold(F.slice(totals, F.lit(1), k)).alias("base")), lambda x: F.transform(
                    F.sequence(F.lit(0), F.greatest(F.size(x["own"]) - 1, F.lit(0))), lambda j: combine(x["base"], fold(F.slice(x["own"], F.lit(1), j)))))

            return F.concat(F.flatten(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / run).cast("int")), one)), F.array(fold(totals)))

        chunks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / run).cast("int")), lambda k: fold(F.slice(v, k * run + 1, run)))
        return F.when(n == 0, F.array(F.lit(zero))).otherwise(_let(chunks, with_totals))

    return _let(values, of)


def _places(text: Column, rule: Rule, length) -> Column:
    """Spans (start, end) of the rule's matches that are long enough; length measures text: in code points or in bytes."""
    between = F.transform(F.split(text, rule.pattern, -1), length)
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), 0)
    tested = F.regexp_extract_all(text, F.lit(rule.pattern), rule.group) if rule.group else matches
    rows = F.arrays_zip(between.alias("gap"), F.transform(matches, length).alias("size"), F.transform(tested, F.length).alias("tested"))

    def spans(x):
        ends = _before(F.transform(x, lambda r: r["gap"] + F.coalesce(r["size"], F.lit(0))), 0, lambda a, b: a + b)
        placed = F.zip_with(x, F.slice(ends, F.lit(2), F.size(x)), lambda r, end: F.struct(
            (end - r["size"]).alias("start"), end.alias("end"), r["tested"].alias("tested")))
        kept = F.filter(placed, lambda r: r["tested"] >= rule.least)
        return F.transform(kept, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end")))

    return _let(rows, spans)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, length=F.length) -> DataFrame:
    """docs with `spans`: array of (start, kind, end), by start and then in the order of the rules.

    Places are in code points, with length=F.octet_length in bytes. Per rule the leftmost matches that do not overlap; those that are too short go. A null
    text has no spans. Repeated rows are scanned each; other columns stay, one called
    spans is replaced; no rows give no rows.
    """
    docs, back = set_aside(docs.drop("spans"), "doc_id", "text")
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    rows = docs
    if queries:
        trigrams = sorted({t for sets in queries.values() for s in sets for t in s})
        found = candidates(postings(docs.select("doc_id", "text"), trigrams), queries)
        found = few(stored(found.withColumnsRenamed({"doc_id": "_doc", "kinds": "_kinds"}), "secret-candidates"), 500_000)
        rows = docs.join(found, F.col("doc_id").eqNullSafe(F.col("_doc")), "left").drop("_doc")
    else:
        rows = docs.withColumn("_kinds", F.lit(None).cast("array<string>"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    ordered = []
    for i, r in enumerate(rules):
        asked = F.array_contains("_kinds", r.kind) if r.kind in queries else F.lit(True)
        # A match that is long enough starts with a run this test finds; it spares most texts the split.
        tested = F.col("text").rlike(_quick(r))
        at = F.when(F.coalesce(asked, F.lit(False)) & tested, _places(F.col("text"), r, length)).otherwise(none)
        ordered.append(_ranked(at, i))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    spans = F.transform(F.array_sort(F.concat(*ordered)), lambda s: F.struct(
        s["start"].alias("start"), F.element_at(kinds, s["rank"] + 1).alias("kind"), s["end"].alias("end")))
    return rows.withColumn("spans", spans).drop("_kinds").withColumnsRenamed(back)


def _ranked(spans: Column, rank: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end")))


def number(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _quick(rule: Rule) -> str:
    """An expression that any text with a long enough match of the rule matches too."""
    if rule.group == 0 and (m := re.fullmatch(r"(.*)(\[[^\]]*\])\+", rule.pattern)) and re.fullmatch(r"[A-Za-z0-9]*", m[1]):
        return f"{m[1]}{m[2]}{{{rule.least - len(m[1])},}}"
    return rule.pattern


def listed(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of spans, comma-joined."""
    kept = F.filter(spans, lambda s: s["kind"].isin(list(kinds))) if kinds else spans
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """docs with each stretch of text that spans cover, alone or overlapping, replaced by mask; same columns, whatever they are called."""
    docs, back = set_aside(docs, "doc_id", "text")
    found = scan(docs, rules, F.octet_length)

    def cover(x):
        """x: the text's bytes, its spans, and for each span the furthest end before it (and at last the furthest of all)."""
        parts = F.zip_with("spans", F.slice(x["reach"], F.lit(1), F.size("spans")), lambda s, reach: F.when(
            s["start"] >= reach, F.concat(F.substring(x["raw"], reach + 1, s["start"] - reach).cast("string"), F.lit(mask))).otherwise(""))
        return F.concat(F.array_join(parts, ""), F.substring(x["raw"], F.element_at(x["reach"], -1) + 1, F.lit(2_147_483_647)).cast("string"))

    reach = _before(F.transform("spans", lambda s: s["end"]), 0, lambda a, b: F.greatest(a, b))
    text = _let(F.struct(F.col("text").cast("binary").alias("raw"), reach.alias("reach")), cover)
    return found.withColumn("text", F.when(F.size("spans") > 0, text).otherwise(F.col("text"))).select(*docs.columns).withColumnsRenamed(back)
