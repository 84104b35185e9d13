"""Mixing sources to target weights by entropy balancing.

Among all rates of documents whose words meet each source's target, those nearest to 1 in relative entropy are
exp(l * size), with one multiplier l for each source, or the highest rate allowed. The multipliers solve the convex
dual; Newton steps find them, each a pass that sums over the documents of all sources at once. Rates become
whole copies by seeded rounding, whose offset is refined per source by exact counts until the words taken meet the
target as nearly as whole documents can. All of it is aggregates over narrow tables.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard
from .packing import word_count

WEIGHTS = (5, 2, 1)
MOST = 3
#: Newton's relative tolerance in words, and its passes at most: a step that leaves its bracket halves it.
TOLERANCE, STEPS = 1e-9, 60
#: Offsets of rounding that a pass tries; it is refined until so few copies lie between two of them.
PROBES, FEW_COPIES = 16, 8
#: Sources up to this many are sent to all tasks; more are joined by shuffle.
BROADCAST_SOURCES = 100_000


def _side(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def _rows(df: DataFrame, ident: str, text: str, source: str) -> DataFrame:
    """id, source, size (words), key: a hash of id, text, source and, where rows repeat, the row's number among
    its like, so that every row has a key of its own and a rerun gives the same keys."""
    raw = df.select(
        F.col(f"`{ident}`").alias("id"),
        F.col(f"`{source}`").alias("source"),
        word_count(F.col(f"`{text}`")).alias("size"),
        F.xxhash64(F.coalesce(F.col(f"`{ident}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{text}`"), F.lit("")), F.col(f"`{source}`")).alias("like"),
        F.spark_partition_id().alias("part"),
    )
    raw = cut(raw, "mix-raw")
    if raw.groupBy("like").count().filter("count > 1").isEmpty():
        return raw.select("id", "source", "size", F.xxhash64("like", F.lit(0).cast("bigint")).alias("key"))
    # Rows alike are numbered within their part, and parts are counted, so no task holds all of them.
    before = F.sum("n").over(Window.partitionBy("like").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    earlier = raw.groupBy("like", "part").agg(F.count("*").alias("n")).withColumn("before", before).filter("before is not null")
    place = F.row_number().over(Window.partitionBy("like", "part").orderBy("size"))
    numbered = raw.withColumn("place", place - 1).join(cut(earlier.select("like", "part", "before"), "mix-parts"), ["like", "part"], "left")
    number = (F.col("place") + F.coalesce("before", F.lit(0))).cast("bigint")
    return cut(numbered.select("id", "source", "size", F.xxhash64("like", number).alias("key")), "mix-numbered")


def _number_sources(rows: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """source, rank (from 0 by code point, null last), w, size; sources lie in range partitions, no task holds all."""
    by = rows.groupBy("source").agg(F.sum("size").alias("size"))
    ranged = by.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    ranged = cut(ranged.withColumn("at", F.monotonically_increasing_id()), "mix-sources").withColumn("part", F.shiftright("at", 33))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row per partition
    starts = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("start"))
    ranged = ranged.join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    w = F.get(F.array(*[F.lit(x) for x in weights]), F.pmod("rank", F.lit(len(weights))).cast("int"))
    return cut(ranged.select("source", "rank", w.alias("w"), "size"), "mix-ranks")


def share_out(sources: DataFrame, most: int = MOST) -> DataFrame:
    """sources (w, size) with target: all words shared by weight; a target stops at `most` times its source's
    size, and the excess is shared by weight among the others until none is above. Whole numbers tell which stop;
    a pass is made as long as more of them do."""
    total = sources.agg(F.sum("size").alias("s"), F.sum("w").alias("w")).first()
    whole = lambda x: F.lit(str(x)).cast("decimal(19,0)")
    free, weight, stopped = int(total["s"] or 0), int(total["w"] or 1), None
    while True:
        above = F.col("w").cast("decimal(10,0)") * whole(free) > F.col("size").cast("decimal(19,0)") * whole(most * weight)
        got = sources.filter(above).agg(F.count("*").alias("n"), F.sum("size").alias("s"), F.sum("w").alias("w")).first()
        if got["n"] == stopped:
            return sources.withColumn("target", F.when(above, most * F.col("size")).otherwise(F.col("w") * F.lit(float(Fraction(free, weight)))).cast("double"))
        stopped = got["n"]
        free, weight = int(total["s"] or 0) - most * int(got["s"] or 0), max(1, int(total["w"] or 1) - int(got["w"] or 0))


def _rate(step: Column, size: Column, mean: Column, most: int) -> Column:
    return F.exp(F.least(step * size / mean, F.lit(math.log(most))))


def _solve(hist: DataFrame, sources: DataFrame, most: int, few: bool) -> DataFrame:
    """rank, mean, step of each source with a target: its documents' rate is exp(step * size / mean), at most
    `most`. hist has the number n of documents of each rank and size, which is all that the sums depend on."""
    sized = hist.filter("size > 0")
    per = sized.groupBy("rank").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.min("size").alias("least"))
    least = F.col("least") / F.col("mean")
    target, size = F.col("target"), F.col("size")
    up = target >= size
    state = cut(per, "mix-means").join(sources.select("rank", "target", "size"), "rank").filter("target > 0")
    state = state.select(
        "rank",
        "target",
        "mean",
        F.when(up, F.lit(0.0)).otherwise(F.log(target / size) / least).alias("lo"),
        F.when(up, F.lit(math.log(most)) / least).otherwise(F.lit(0.0)).alias("hi"),
        F.when(target >= size * most, F.lit(math.log(most)) / least).otherwise(F.lit(0.0)).alias("step"),
    )
    state = cut(state, "mix-state")
    for _ in range(STEPS):
        at = sized.join(_side(state.select("rank", "mean", "step"), few), "rank")
        words = F.col("size") * F.col("n") * _rate(F.col("step"), F.col("size"), F.col("mean"), most)
        free = F.col("step") * F.col("size") / F.col("mean") < math.log(most)
        sums = at.groupBy("rank").agg(F.sum(words).alias("f"), F.sum(F.when(free, words * F.col("size") / F.col("mean")).otherwise(0.0)).alias("g"))
        off = F.col("f") - target
        lo, hi = F.when(off <= 0, F.col("step")).otherwise(F.col("lo")), F.when(off >= 0, F.col("step")).otherwise(F.col("hi"))
        # Newton's step for the logarithm of the words, which is nearly straight in the multiplier.
        to = F.col("step") - F.log(F.col("f") / target) * F.try_divide(F.col("f"), F.col("g"))
        inside = F.coalesce((to > lo) & (to < hi), F.lit(False))
        met = (F.abs(off) <= TOLERANCE * target) | (hi - lo <= 1e-14 * F.abs(hi + lo))
        step = F.when(met, F.col("step")).when(inside, to).otherwise((lo + hi) / 2)
        new = state.join(sums, "rank").select("rank", "target", "mean", lo.alias("lo"), hi.alias("hi"), step.alias("step"), met.alias("met"))
        old, state = state, cut(new, "mix-state")
        discard(old)
        if state.filter("not met").isEmpty():
            break
    return state.select("rank", "mean", "step")


def _round(rows: DataFrame, sources: DataFrame, most: int, few: bool) -> DataFrame:
    """rank, offset, extra: a row of rate r and seeded u in [0, 1) goes floor(r + u + offset) times, from 0 to
    `most`, and once more where its key is in extra. Each pass counts words and copies for offsets between
    the last that takes too little and the first that takes too much."""
    copies = lambda at: F.least(F.lit(most), F.greatest(F.lit(0), F.floor(F.col("x") + at))).cast("bigint")
    state = sources.select("rank", "target", F.lit(-1.0).alias("lo"), F.lit(1.0).alias("hi"), F.lit(None).cast("bigint").alias("words"), F.lit(True).alias("open"))
    state = cut(state, "mix-offsets")
    sized = rows.filter("size > 0")
    probe = lambda j: F.col("lo") + (F.col("hi") - F.col("lo")) * (j / (PROBES + 1))
    while True:
        at = sized.join(_side(state.filter("open").select("rank", "lo", "hi"), few), "rank")
        tried = range(PROBES + 2)
        sums = at.groupBy("rank").agg(*[F.struct(F.sum(copies(probe(j)) * F.col("size")).alias("w"), F.sum(copies(probe(j))).alias("c")).alias(f"s{j}") for j in tried])
        both = state.join(sums, "rank", "left")
        arr = F.array(*[F.struct(probe(j).alias("at"), F.col(f"s{j}.w").alias("w"), F.col(f"s{j}.c").alias("c")) for j in tried])
        under = F.try_element_at(F.filter(arr, lambda p: p["w"] <= F.col("target")), F.lit(-1))
        over = F.get(F.filter(arr, lambda p: p["w"] > F.col("target")), F.lit(0))
        u, o = F.coalesce(under, F.get(arr, F.lit(0))), F.coalesce(over, F.get(arr, F.lit(PROBES + 1)))
        new = both.withColumns({"u": u, "o": o}).select(
            "rank",
            "target",
            F.when(F.col("open") & F.col("u.w").isNotNull(), F.col("u.at")).otherwise(F.col("lo")).alias("lo"),
            F.when(F.col("open") & F.col("o.w").isNotNull(), F.col("o.at")).otherwise(F.col("hi")).alias("hi"),
            F.when(F.col("open"), F.col("u.w")).otherwise(F.col("words")).alias("words"),
            (F.col("open") & F.coalesce(F.col("o.c") - F.col("u.c") > FEW_COPIES, F.lit(False)) & (F.col("o.at") - F.col("u.at") > 1e-15)).alias("open"),
        )
        old, state = state, cut(new, "mix-offsets")
        discard(old)
        if state.filter("open").isEmpty():
            break
    # What is missing is filled up from the largest documents that fit, out of a few of every order of size.
    short = state.select("rank", "lo", F.greatest(F.lit(0).cast("bigint"), F.floor(F.col("target") - F.coalesce("words", F.lit(0)))).alias("short"))
    fit = sized.join(_side(short, few), "rank").filter((copies(F.col("lo")) < most) & (F.col("size") <= F.col("short")))
    doc = F.struct("size", "key")
    ends = fit.groupBy("rank", F.floor(F.log2("size")).alias("order"), F.pmod("key", F.lit(4)).alias("deal")).agg(F.max(doc).alias("a"), F.min(doc).alias("b"))
    some = ends.groupBy("rank").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.array("a", "b")))), asc=False).alias("some"))
    none = F.struct(F.col("short").alias("left"), F.array().cast("array<bigint>").alias("keys"))
    take = lambda acc, d: F.when(d["size"] <= acc["left"], F.struct((acc["left"] - d["size"]).alias("left"), F.array_append(acc["keys"], d["key"]).alias("keys"))).otherwise(acc)
    return short.join(cut(some, "mix-fit"), "rank", "left").select("rank", F.col("lo").alias("offset"), F.coalesce(F.aggregate("some", none, take)["keys"], none["keys"]).alias("extra"))


def mix(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, ident: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: its id and source, size (words), source_size, target (of its source), rate, copies,
    taken (size times copies).

    Sources by code point, null last, have the weights in turn and share the words of all documents; see
    `share_out`. Rates come from `_solve`, copies from `_round`; the words of a source miss its target by less than
    the smallest document that still fits, or by what whole documents allow where there are few. A null text
    has no words; documents without words have one copy. Repeated rows are documents of their own. Results
    depend on ids, texts and sources alone, so reruns agree. An empty table gives no rows. Other columns are left out.
    """
    rows = _rows(df, ident, text, source)
    sources = cut(share_out(_number_sources(rows, weights), most), "mix-targets")
    few = sources.count() <= BROADCAST_SOURCES
    named = _side(sources.select(F.col("source").alias("s"), "rank", F.col("size").alias("source_size"), "target"), few)
    rows = rows.join(named, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    hist = cut(rows.groupBy("rank", "size").agg(F.count("*").alias("n")), "mix-sizes")
    steps = cut(_solve(hist, sources, most, few), "mix-steps")
    rows = rows.join(_side(steps, few), "rank", "left")
    rate = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(F.coalesce(_rate(F.col("step"), F.col("size"), F.col("mean"), most), F.lit(0.0)))
    seeded = F.shiftrightunsigned("key", 11) / F.lit(float(1 << 53))
    rows = cut(rows.select("id", "source", "size", "rank", "source_size", "target", "key", rate.alias("rate"), (rate + seeded).alias("x")), "mix-rates")
    offsets = cut(_round(rows, sources, most, few), "mix-rounding")
    out = rows.join(_side(offsets, few), "rank", "left")
    copies = F.least(F.lit(most), F.greatest(F.lit(0), F.floor(F.col("x") + F.col("offset"))) + F.array_contains("extra", F.col("key")).cast("int"))
    out = out.withColumn("copies", F.when(F.col("size") == 0, F.lit(1)).otherwise(copies).cast("bigint"))
    return out.select(F.col("id").alias(ident), F.col("source").alias(source), "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"))
