"""Packing into optimal length buckets.

The global histogram of exact lengths is aggregated, dynamic programming chooses the bucket boundaries with the
least padding, and batches under a token budget form inside each bucket.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_BREAK, bounds_below, cut, partitions, spread_alike

BUCKETS = 16
BUDGET = 8192


def choose_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Boundaries (the longest length of each bucket) with the least total padding when each document is
    padded to its bucket's boundary. Exact dynamic programming over the ascending distinct lengths: for
    one more bucket, the best place of the boundary before each length is the lowest of lines with falling
    slopes, which a hull of those still in question gives in one pass. All numbers are Python integers."""
    n = len(lengths)
    if not n:
        return []
    c, s = [0], [0]
    for x, k in zip(lengths, counts):
        c.append(c[-1] + k)
        s.append(s[-1] + x * k)
    # One bucket: everything up to length e is padded to it.
    best = [0] + [lengths[e] * c[e + 1] - s[e + 1] for e in range(n)]
    back = [[0] * (n + 1)]
    for _ in range(min(buckets, n) - 1):
        new, choice = [0] * (n + 1), [0] * (n + 1)
        hull: list[int] = []  # places i; the line of i is best[i] + s[i] - x * c[i]
        at = 0
        for e in range(1, n + 1):
            i = e - 1
            while len(hull) - at >= 2:
                a, b = hull[-2], hull[-1]
                # b is never lowest if i overtakes a no later than b does.
                if (best[i] + s[i] - best[a] - s[a]) * (c[b] - c[a]) <= (best[b] + s[b] - best[a] - s[a]) * (c[i] - c[a]):
                    hull.pop()
                else:
                    break
            hull.append(i)
            x = lengths[e - 1]
            while at + 1 < len(hull) and best[hull[at + 1]] + s[hull[at + 1]] - x * c[hull[at + 1]] <= best[hull[at]] + s[hull[at]] - x * c[hull[at]]:
                at += 1
            i = hull[at]
            new[e], choice[e] = best[i] + x * (c[e] - c[i]) - (s[e] - s[i]), i
        best = new
        back.append(choice)
    out, e = [], n
    for choice in reversed(back):
        if e > 0:
            out.append(lengths[e - 1])
            e = choice[e]
    return sorted(set(out))


def word_count(text):
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")).cast("bigint")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, budget: int = BUDGET, length=None) -> DataFrame:
    """One row per document: n_tokens, boundary (the bucket's padded length), batch, place, padding.

    n_tokens is `length`, a Column, or the number of words. A batch holds floor(budget / boundary)
    documents of one bucket, at least one, so a document longer than the budget is a batch of its own.
    Batches are numbered from 0 over all buckets by ascending boundary; inside a bucket documents go in
    an order fixed by the hash of their id and text, and only the last batch of a bucket can be short.
    Ids may be null or repeated: texts deal their rows, and many rows alike are dealt by where they were read. Null and
    empty texts have 0 tokens and form batches like others. Repeated rows are packed each. An empty table
    gives no rows. Other columns are left out.
    """
    spark = df.sparkSession
    n = word_count(F.col(f"`{text_col}`")) if length is None else length.cast("bigint")
    like = F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`") if text_col in df.columns else n)
    rows = cut(df.select(F.col(f"`{id_col}`").alias(id_col), F.coalesce(n, F.lit(0)).alias("n_tokens"), like.alias("__h"), F.spark_partition_id().alias("__part")), "packing")
    # One row per distinct length comes to the driver, at most as many as the longest document has tokens.
    hist = sorted((r["n_tokens"], r["count"]) for r in rows.groupBy("n_tokens").count().collect())
    bounds = choose_boundaries([a for a, _ in hist], [b for _, b in hist], buckets)
    rows = rows.withColumn("__bucket", bounds_below([b + 1 for b in bounds], F.col("n_tokens")))
    # Places: each bucket is dealt over slices of the id's hash, sized by the bucket's count; counts of
    # slices give the offsets, so no bucket is ranked in one task.
    total: dict[int, int] = {}
    for a, b in hist:
        i = bisect_left(bounds, a)
        total[i] = total.get(i, 0) + b
    all_rows = sum(total.values())
    slices = [max(1, -(-4 * partitions(spark) * total.get(i, 0) // max(1, all_rows))) for i in range(len(bounds))]
    per = F.get(F.array(*[F.lit(s) for s in slices]), F.col("__bucket")) if bounds else F.lit(1)
    rows = spread_alike(rows, "__h", max(1, all_rows // (4 * partitions(spark))))
    rows = rows.withColumn("__slice", F.pmod(F.col("__h"), per.cast("bigint")).cast("int"))
    first, offsets = 0, []
    held: dict[int, list[tuple[int, int, int]]] = {}
    for r in rows.groupBy("__bucket", "__slice", "__sub").count().collect():
        held.setdefault(r["__bucket"], []).append((r["__slice"], r["__sub"], r["count"]))
    for b in range(len(bounds)):
        size, start = max(1, budget // max(1, bounds[b])), 0
        for s, sub, k in sorted(held.get(b, [])):
            offsets.append((b, s, sub, start, first, size, bounds[b]))
            start += k
        first += -(-start // size)
    table = spark.createDataFrame(offsets, "__bucket int, __slice int, __sub int, __from bigint, __first bigint, __size bigint, boundary bigint")
    parts = ["__bucket", "__slice", "__sub"]
    rows = rows.join(F.broadcast(table), parts)
    w = Window.partitionBy(*parts).orderBy("__h", id_col, "n_tokens")
    at = F.col("__from") + F.row_number().over(w) - 1
    rows = rows.withColumn("__at", at)
    return rows.select(
        id_col,
        "n_tokens",
        "boundary",
        (F.col("__first") + F.floor(F.col("__at") / F.col("__size"))).cast("bigint").alias("batch"),
        F.pmod("__at", "__size").alias("place"),
        (F.col("boundary") - F.col("n_tokens")).alias("padding"),
    )
