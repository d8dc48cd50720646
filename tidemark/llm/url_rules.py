"""Allow and block rules for URLs: a sort-merge range join.

A rule (host, path) fits its host, all subdomains, and every path that starts with the
rule's. Written with the host reversed, `com.example#/en/7`, a rule is an interval of
keys: all that start with it. Each distinct (host, path) of the URLs becomes one probe
per suffix of its host. Rules and probes are range-partitioned and sorted together; each
task sweeps its range once with a stack of the nested rules that are open. A rule that
opened in an earlier range is open in a later one just when it is a prefix of that
range's first key, so a small equi-join gives each range its first stack.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, shared_dir

#: Rules of the registered query: (action, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "action string, host string, path string")


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """df with host and path of the URL; both empty where it is null or has no `://`."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    return df.withColumns({
        "host": F.coalesce(ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit("")),
        "path": F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")),
    })


def _reversed_host(labels):
    return F.array_join(F.reverse(labels), ".")


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """urls with host, path, rule and verdict.

    Longest rule wins (host and path together, then the host); of two actions for one
    rule, block. No rule: rule null, verdict `default`. Rules with a null part or an empty
    host fit nothing. Null and malformed URLs have empty host and path. Every input row
    gives one output row; its other columns stay, those called host, path, rule or verdict
    are replaced. Empty rules or urls are fine.
    """
    spark = urls.sparkSession
    shared_dir(spark)
    pages = with_parts(urls.drop("host", "path", "rule", "verdict"), url)
    rules = (
        rules.where("action is not null and path is not null and host <> ''")
        .withColumn("host", ascii_lower("host"))
        .groupBy("host", "path").agg(F.max("action").alias("action"))
        .select(F.concat(_reversed_host(F.split("host", r"\.")), F.lit("#"), "path").alias("key"), "host", "path", "action")
    )
    # One row, of the rules: the most labels of a host, and the lengths of keys that occur.
    sizes = rules.agg(F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(1)).alias("labels"), F.collect_set(F.length("key")).alias("lengths"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), "labels")), lambda n: _reversed_host(F.slice(labels, -n, n)))
    probes = (
        pages.select("host", "path").distinct().join(F.broadcast(sizes.select("labels")))
        .select("host", "path", F.explode(suffixes).alias("suffix"))
        .select(F.concat("suffix", F.lit("#"), "path").alias("key"), F.lit(1).alias("kind"), "host", "path", F.lit(None).cast("string").alias("action"))
    )
    events = (
        rules.select("key", F.lit(0).alias("kind"), "host", "path", "action").unionByName(probes)
        .repartitionByRange("key", "kind", "host").sortWithinPartitions("key", "kind", "host")
        .withColumn("part", F.spark_partition_id())
        .checkpoint()  # the ranges are fixed from here on
    )
    # One first key for each range, its prefixes against the rules: as many rows as ranges times the lengths that rules have.
    first = events.groupBy("part").agg(F.min("key").alias("first")).join(F.broadcast(sizes.select("lengths")))
    prefixes = first.select("part", F.explode(F.expr("transform(filter(lengths, n -> n <= length(first)), n -> substring(first, 1, n))")).alias("key"))
    carried: dict[int, list] = {}
    for r in prefixes.join(rules, "key").orderBy("part", F.length("key")).collect():
        carried.setdefault(r["part"], []).append((r["key"], r["host"], r["path"], r["action"]))

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack = None
        for pdf in batches:
            out = []
            for key, kind, host, path, action, part in pdf.itertuples(index=False):
                if stack is None:
                    stack = list(carried.get(part, ()))
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    stack.append((key, host, path, action))
                elif stack:
                    _, rule_host, rule_path, verdict = stack[-1]
                    out.append((host, path, rule_host + rule_path, len(rule_host), verdict))
            yield pd.DataFrame(out, columns=["host", "path", "rule", "host_length", "verdict"])

    found = events.mapInPandas(sweep, "host string, path string, rule string, host_length int, verdict string")
    best = found.groupBy("host", "path").agg(
        F.max(F.struct(F.length("rule").alias("n"), "host_length", "rule", "verdict")).alias("best")
    )
    return (
        pages.join(best, ["host", "path"], "left")
        .withColumns({"rule": F.col("best.rule"), "verdict": F.coalesce("best.verdict", F.lit(default))})
        .drop("best")
    )
