"""URL filters by hash-prefix lookups.

Each URL is expanded into expressions host-suffix + path-prefix. An expression's SHA-256 is looked up
by its first four bytes in an equi-join with the rules; the full digest then confirms, and the longest
rule decides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fold_case

#: Rules are broadcast up to this many; beyond it they are joined by shuffle.
BROADCAST_RULES = 100_000
PREFIX_HEX = 8
#: Expressions per URL, at most: numbers of host labels times lengths of paths that rules have.
MAX_SHAPES = 10_000


@dataclass(frozen=True)
class Rule:
    """host covers itself and all its subdomains; path is a prefix of the URL's path."""

    verdict: str
    host: str
    path: str = "/"


PRODUCTION_RULES = (
    Rule("block", "net"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)
_RULE_SCHEMA = T.StructType(
    [T.StructField("verdict", T.StringType()), T.StructField("host", T.StringType()), T.StructField("path", T.StringType())]
)


def url_parts(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both are empty for a null URL or one without '://'."""
    at = F.expr(f"position('://' IN `{url}`)")
    rest = F.coalesce(F.when(at > 0, F.expr(f"substring(`{url}`, position('://' IN `{url}`) + 3)")), F.lit(""))
    return fold_case(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_table(spark, rules) -> DataFrame:
    if isinstance(rules, DataFrame):
        return rules.select(*_RULE_SCHEMA.names)
    return spark.createDataFrame([(r.verdict, r.host, r.path) for r in rules], _RULE_SCHEMA)


def filter_urls(df: DataFrame, rules=PRODUCTION_RULES, url: str = "url", default: str = "allow") -> DataFrame:
    """df with host, path, rule (`host/path`, null if none fits) and verdict.

    Distinct (host, path) pairs are looked up once and joined back, so repeated URLs cost nothing. Of
    fitting rules the longest (host and path together) wins, then the one with the longer host, then
    block. A null URL has an empty host and path, no rule and the default verdict. An empty rule set or
    table gives default verdicts or no rows. Only suffixes and prefixes of lengths that some rule has are
    expanded; this loses none, and MAX_SHAPES bounds how many different ones a rule set may have. A rule's
    path starts with "/", which is added where it is missing. Other columns of df are kept whatever their
    names, but host, path, rule and verdict are replaced.
    """
    spark = df.sparkSession
    kept = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = url_parts(url)
    # The user's columns travel as c0, c1, ... and get their names back at the end.
    df = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], host.alias("host"), path.alias("path"))

    def named(out: DataFrame) -> DataFrame:
        return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], "host", "path", "rule", "verdict")

    slashed = F.concat(F.lit("/"), F.regexp_replace(F.coalesce("path", F.lit("")), "^/", ""))
    r = rule_table(spark, rules).filter("host is not null and host != ''").withColumn("path", slashed)
    shape = r.agg(
        F.count("*").alias("n"),
        F.collect_set(F.size(F.split("host", r"\."))).alias("labels"),
        F.collect_set(F.length("path")).alias("lengths"),
    ).first()
    if not shape["n"]:
        return named(df.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default)))
    if len(shape["labels"]) * len(shape["lengths"]) > MAX_SHAPES:
        raise ValueError(f"rules of {len(shape['labels'])} x {len(shape['lengths'])} lengths of host and path, more than {MAX_SHAPES}")
    # No host holds a "/" and every path starts with one, so the joined text is unambiguous.
    expr = F.concat("host", "path")
    lookup = r.select(
        F.substring(F.sha2(expr, 256), 1, PREFIX_HEX).alias("prefix"),
        F.sha2(expr, 256).alias("digest"),
        expr.alias("rule"),
        F.col("verdict").alias("rule_verdict"),
        (F.length("host") + F.length("path")).alias("long"),
        F.length("host").alias("host_long"),
    )
    if shape["n"] <= BROADCAST_RULES:
        lookup = F.broadcast(lookup)
    known = df.select("host", "path").filter("host != '' and path like '/%'").distinct()
    labels, lengths = sorted(shape["labels"]), sorted(shape["lengths"])
    hosts = known.withColumn("labels", F.split("host", r"\.")).withColumn(
        "suffix",
        F.explode(F.array_compact(F.array(*[F.when(F.size("labels") >= k, F.array_join(F.slice("labels", -k, k), ".")) for k in labels]))),
    )
    hosts = hosts.withColumn(
        "path_prefix", F.explode(F.array_compact(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths])))
    )
    asked = hosts.select("host", "path", F.sha2(F.concat("suffix", "path_prefix"), 256).alias("asked"))
    hits = asked.join(lookup, F.substring("asked", 1, PREFIX_HEX) == F.col("prefix")).filter("asked = digest")
    best = hits.groupBy("host", "path").agg(
        F.max(F.struct("long", "host_long", (F.col("rule_verdict") == "block").alias("block"), "rule", "rule_verdict")).alias("best")
    )
    best = best.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("verdict"))
    # Written first: a hot (host, path) is then a join that Spark can split.
    out = df.join(cut(best, "url-rules"), ["host", "path"], "left")
    return named(out.withColumn("verdict", F.coalesce("verdict", F.lit(default))))
