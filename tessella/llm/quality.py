"""Quality rules with host-level verdicts.

Rules count on each whole text with higher-order functions; nothing leaves the JVM. Failures are
aggregated by host, rates are shrunk with a beta prior fitted to all hosts by moments, and hosts whose
shrunk rate is too high take their documents along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BREAK, cut

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A host goes if its shrunk failure rate is above this.
MAX_HOST_RATE = 0.5
#: Hosts are broadcast up to this many; beyond it the verdicts are joined by shuffle.
BROADCAST_HOSTS = 100_000


def text_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed. A null text has no
    words, lines or symbols, so it fails for having few words. Columns of these names are replaced."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    df = df.drop(*[c for c in names if c in df.columns])
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    bare = F.regexp_replace(t, WORD_BREAK, "")
    df = df.withColumn("__bare", bare).withColumn(
        "__words", F.when(F.length("__bare") == 0, F.expr("cast(array() as array<string>)")).otherwise(F.filter(F.split(t, WORD_BREAK), lambda w: w != ""))
    )
    df = df.withColumn("n_words", F.size("__words").cast("bigint"))
    df = df.withColumn("word_chars", F.length("__bare").cast("bigint"))
    df = df.withColumn("n_symbols", F.length(F.regexp_replace("__bare", f"[^{SYMBOLS}]+", "")).cast("bigint"))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("__lines", lines).withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"))
    df = df.withColumn("__w", F.transform("__words", lambda w: F.xxhash64(w)))
    w = F.col("__w")
    at = F.when(F.size(w) >= WINDOW, F.sequence(F.lit(0), F.size(w) - WINDOW))
    df = df.withColumn("__h", F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])))
    h = F.col("__h")
    # Only a text with a repeated window is sorted: neighbours with one hash give the repeats' places,
    # and each place covers up to WINDOW words, less where the next one begins sooner.
    some = F.size(F.array_distinct(h)) < F.size(h)
    s = F.when(some, F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    df = df.withColumn("__s", s)
    s = F.col("__s")
    same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
    index = F.when(s.isNotNull(), F.sequence(F.lit(0), F.size(s) - 1))
    twice = F.filter(index, lambda i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
    df = df.withColumn("__p", F.sort_array(F.transform(twice, lambda i: F.get(s, i)["i"])))
    p = F.col("__p")
    covered = F.aggregate(
        p,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, x: F.struct((acc["n"] + x + WINDOW - F.greatest(x, acc["end"])).alias("n"), (x + WINDOW).alias("end")),
        lambda acc: acc["n"],
    )
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop("__bare", "__words", "__lines", "__w", "__h", "__s", "__p")


def host_verdicts(judged: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host: n_docs, n_failed, shrunk_rate and host_ok. The prior's mean is the failure rate of
    all documents; its strength comes from the variance of rates between hosts, less what chance alone
    gives. Hosts that don't vary beyond chance get the strongest prior allowed."""
    by = judged.groupBy(F.col(f"`{host}`").alias("__host")).agg(F.count("*").alias("n_docs"), F.count_if("base_failed").alias("n_failed"))
    prior = by.agg(
        (F.sum("n_failed") / F.sum("n_docs")).alias("m"),
        F.var_pop(F.col("n_failed") / F.col("n_docs")).alias("v"),
        F.avg(1 / F.col("n_docs")).alias("inv"),
    )
    spread = F.col("m") * (1 - F.col("m"))
    strength = F.least(F.lit(1000.0), F.greatest(F.lit(1.0), F.try_divide(spread, F.col("v") - spread * F.col("inv")) - 1))
    weak = F.coalesce(F.when(F.col("v") > spread * F.col("inv"), strength), F.lit(1000.0))
    prior = prior.select(F.coalesce("m", F.lit(0.0)).alias("m"), weak.alias("strength")).first()
    rate = (F.col("n_failed") + F.lit(prior["m"] * prior["strength"])) / (F.col("n_docs") + F.lit(prior["strength"]))
    return by.withColumn("shrunk_rate", rate).withColumn("host_ok", F.col("shrunk_rate") <= max_rate)


def judge(df: DataFrame, text: str = "text", host: str = "source", keep_text: bool = False, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """df without its text (or with it) and with the rule counts, base_failed, shrunk_rate and kept.

    kept is false for a document that fails a base rule, or whose host has a shrunk failure rate above
    max_rate. Documents without a host form one host. Repeated rows count as often as they occur. An
    empty table gives no rows. Columns named like the new ones are replaced; others are kept whatever their
    names.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "shrunk_rate", "kept"]
    others = [c for c in df.columns if c not in made and (keep_text or c != text)]
    # The user's columns travel as c0, c1, ... and get their names back at the end.
    df = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)], F.col(f"`{text}`").alias("__text"), F.col(f"`{host}`").alias("__source"))
    judged = cut(text_features(df, "__text").drop("__text"), "quality")
    hosts = cut(host_verdicts(judged, "__source", max_rate).select("__host", "shrunk_rate", "host_ok"), "quality-hosts")
    if hosts.count() <= BROADCAST_HOSTS:
        hosts = F.broadcast(hosts)
    out = judged.join(hosts, judged["__source"].eqNullSafe(hosts["__host"]), "left")
    out = out.withColumn("kept", ~F.col("base_failed") & F.coalesce("host_ok", F.lit(True)))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(others)], *made)
