"""Document fingerprints: threshold-scaled sketches.

A sketch keeps every hash of a five-word shingle below a fixed fraction of the hash space, so sketches
of any two documents, however unequal, are comparable, and the union's sketch is the union of sketches.
A document with no hash below the threshold keeps its smallest one, an anchor above the threshold; a union
drops anchors as soon as it has a hash below, or else keeps the smaller, so merging stays exact. An anchor
says nothing about what lies above the threshold elsewhere, so such a document's containment is unknown
(null), unless the other sketch is the same; with n shingles this happens with probability 0.75**n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_BREAK, partitions, range_bounds, with_range

SHINGLE = 5
#: One hash in so many is kept.
SCALE = 4
KEPT_BITS = 48
_SPACE = SCALE << KEPT_BITS


def words(text: Column) -> Column:
    return F.filter(F.split(text, WORD_BREAK), lambda w: w != "")


def with_sketch(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the sorted array of kept hashes. Fewer than five words form one shingle; no words, none."""
    w = F.transform(words(F.coalesce(F.col(text), F.lit(""))), lambda x: F.xxhash64(x))
    df = df.withColumn("__w", w)
    w = F.col("__w")
    at = F.when(F.size(w) >= SHINGLE, F.sequence(F.lit(0), F.size(w) - SHINGLE)).when(F.size(w) > 0, F.array(F.lit(0)))
    space = F.lit(_SPACE - 1)
    df = df.withColumn("__h", F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]).bitwiseAND(space)))
    h = F.col("__h")
    df = df.withColumn("__k", F.filter(h, lambda x: x < (1 << KEPT_BITS)))
    kept = F.when(F.size("__k") > 0, F.sort_array(F.array_distinct("__k"))).when(F.size(h) > 0, F.array(F.array_min(h)))
    return df.withColumn(name, F.coalesce(kept, F.expr("cast(array() as array<bigint>)"))).drop("__w", "__h", "__k")


def merge(a: Column, b: Column) -> Column:
    """The sketch of the union of two documents' shingles."""
    both = F.sort_array(F.array_union(a, b))
    low = F.filter(both, lambda x: x < (1 << KEPT_BITS))
    return F.when(F.size(low) > 0, low).otherwise(F.slice(both, 1, 1))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity; two empty documents are alike, an empty and another aren't."""
    both = F.size(merge(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has, from a's hashes below the threshold; null if a has none
    there and b isn't alike. A document without words is held by any."""
    below = F.get(a, F.lit(0)) < (1 << KEPT_BITS)
    return F.when((F.size(a) == 0) | (a == b), F.lit(1.0)).when(below, F.size(F.array_intersect(a, b)) / F.size(a))


def as_text(sketch: Column) -> Column:
    """Hashes in hexadecimal, joined by commas."""
    return F.array_join(F.transform(sketch, lambda x: F.lower(F.hex(x))), ",")


def next_texts(df: DataFrame, id_col: str, carry: list[str]) -> DataFrame:
    """Adds next_<c> for each carried column: its value in the next row by descending id; the last row is
    followed by the first. Ids fall into ranges; each range's highest row also goes, as a copy, to the end
    of the range above it, so one exchange is enough and no range sees another's rows. A null id counts
    as the lowest; rows of one id follow each other by the first carried column."""
    spark = df.sparkSession
    key = F.coalesce(F.col(f"`{id_col}`"), F.lit(-(1 << 63)))
    df = df.withColumn("__id", key)
    bounds = range_bounds(df.select("__id"), "__id", 4 * partitions(spark))
    df = with_range(df, bounds, "__id", "__range")
    tops = sorted((r["__range"], r["top"]) for r in df.groupBy("__range").agg(F.max("__id").alias("top")).collect())  # one row per range
    if not tops:
        for c in carry:
            df = df.withColumn(f"next_{c}", F.col(c))
        return df.drop("__id", "__range")
    ends = [(top, tops[(i + 1) % len(tops)][0]) for i, (_, top) in enumerate(tops)]
    df = df.join(F.broadcast(spark.createDataFrame(ends, "__id bigint, __above int")), "__id", "left")
    own = F.struct(F.col("__range").alias("r"), F.lit(0).alias("copy"))
    copy = F.struct(F.col("__above").alias("r"), F.lit(1).alias("copy"))
    df = df.withColumn("__dest", F.explode(F.when(F.col("__above").isNotNull(), F.array(own, copy)).otherwise(F.array(own)))).drop("__range", "__above")
    df = df.withColumn("__range", F.col("__dest.r")).withColumn("__copy", F.col("__dest.copy")).drop("__dest")
    w = Window.partitionBy("__range").orderBy(F.col("__copy"), F.col("__id").desc(), F.col(carry[0]).asc_nulls_first())
    for c in carry:
        df = df.withColumn(f"next_{c}", F.lead(c).over(w))
    return df.filter("__copy = 0").drop("__id", "__range", "__copy")


def fingerprint_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document the fingerprints of its text and of an edited one, whose second half is the start
    of the next document's text (descending id; after the last the first).

    A null text counts as empty. Texts of 0 or 1 characters aren't edited. Equal texts have equal
    fingerprints; texts of equal ids are ordered by text. A single document follows itself. An empty table
    gives no rows. Other columns of df are left out.
    """
    df = df.select(F.col(f"`{id_col}`").alias("__doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))
    df = next_texts(with_sketch(df, "__text", "__fp"), "__doc", ["__text", "__fp"])
    df = df.withColumn("n_chars", F.length("__text").cast("bigint")).withColumn("__half", F.floor(F.col("n_chars") / 2).cast("int"))
    head = F.substring("__text", F.lit(1), F.col("n_chars").cast("int") - F.col("__half"))
    df = df.withColumn("__edited", F.concat(head, F.substring("next___text", F.lit(1), F.col("__half"))))
    df = with_sketch(df, "__edited", "__efp")
    return df.select(
        F.col("__doc").alias(id_col),
        "n_chars",
        F.sha2("__edited", 256).alias("edited_sha256"),
        as_text(F.col("__fp")).alias("fingerprint"),
        as_text(F.col("__efp")).alias("edited_fingerprint"),
        likeness(F.col("__fp"), F.col("__efp")).alias("near_edited"),
        likeness(F.col("__fp"), F.col("next___fp")).alias("near_next"),
        containment(F.col("__fp"), F.col("__efp")).alias("held_by_edited"),
    )
