"""Sharding by histogram sort.

Rows have a 62-bit key, here a hash of the text, so that equal texts are neighbours. Exact bytes below
candidate boundaries are counted over all partitions, the candidates are refined around each target
until every splitter meets the tolerance, and only then are the rows exchanged, once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounds_below, cut, partitions, spread_alike

PROBES = 32
KEY_BITS = 62


def _below(df: DataFrame, probes: list[int], key: str, *measures: str) -> list[tuple]:
    """For each probe the exact sum of each measure over keys less than it."""
    at = bounds_below(probes, F.col(key))
    got = {r["at"]: r for r in df.groupBy(at.alias("at")).agg(*[F.sum(m).alias(m) for m in measures]).collect()}
    out, total = [], [0] * len(measures)
    for i in range(len(probes)):
        r = got.get(i)
        total = [t + ((r[m] or 0) if r else 0) for t, m in zip(total, measures)]
        out.append(tuple(total))
    return out


def find_splitters(df: DataFrame, targets: list[float], key: str, size: str, tolerance: float, lo: int, hi: int, probes: int = PROBES) -> list[tuple[int, float]]:
    """For each ascending target a key boundary, and the exact bytes below it. Stops where all are within
    tolerance or no key is left between the bounds; then the nearer side is taken. Each pass collects at
    most probes numbers per target, whatever the table's size."""
    ranges = [[lo, 0, hi, None] for _ in targets]
    found: list[tuple[int, float] | None] = [None] * len(targets)
    while any(f is None for f in found):
        asked = {hi}
        for r, f in zip(ranges, found):
            if f is None:
                step = max(1, (r[2] - r[0]) // (probes + 1))
                asked |= set(range(r[0] + step, r[2], step))
        asked = sorted(asked)
        counts = dict(zip(asked, (x[0] for x in _below(df, asked, key, size))))
        counts[lo] = 0
        for i, (r, f) in enumerate(zip(ranges, found)):
            if f is not None:
                continue
            within = [(k, v) for k, v in counts.items() if r[0] <= k <= r[2]]
            under = max([x for x in within if x[1] <= targets[i]], default=(r[0], r[1]))
            over = min([x for x in within if x[1] > targets[i]], default=(r[2], counts[hi]))
            r[0], r[1], r[2], r[3] = under[0], under[1], over[0], over[1]
            near = min((under, over), key=lambda x: abs(x[1] - targets[i]))
            if abs(near[1] - targets[i]) <= tolerance or r[2] - r[0] <= 1:
                found[i] = near
    return found


def shard(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.01, group_tolerance: float = 0.05) -> DataFrame:
    """df with size (UTF-8 bytes + 1), text_crc32, shard and slot; the law is `bytes`: sizes near equal.

    Shards are ranges of (hash of text, id). Equal texts stay in one shard, unless a boundary falls into a
    group so large that leaving it whole would miss the target by more than group_tolerance of a shard:
    then ids split the group. Slots number a shard's rows without gaps, range of hashes by range, in (hash, id)
    order; a crowded range is dealt by the hash of ids first, and many rows of one id and text by where they
    were read. Repeated rows have a slot each. A null text counts as empty, a null id sorts first. An empty table gives no rows. Columns of df named like
    the new ones are replaced. With fewer rows than shards some shards stay empty.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    plain = df.drop(*[c for c in ("size", "text_crc32", "shard", "slot") if c not in (id_col, text_col)])
    keep = [F.col(f"`{c}`") for c in plain.columns if c != text_col]
    rows = cut(
        plain.select(
            *keep,
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64(text), 64 - KEY_BITS).alias("__key"),
            F.xxhash64(text, F.col(f"`{id_col}`")).alias("__like"),
            F.spark_partition_id().alias("__part"),
        ),
        "shard-rows",
    )
    total = rows.agg(F.sum("size").alias("b"), F.count("*").alias("n")).first()
    if not total["n"]:
        return rows.drop("__key", "__like", "__part").withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("bigint"))
    each = total["b"] / shards
    fine = max(1, -(-2 * partitions(spark) // shards))
    targets = [each * i for i in range(1, shards)]
    cuts = find_splitters(rows, targets, "__key", "size", tolerance * each, 0, 1 << KEY_BITS)
    # A splitter is (key, id): rows below it have a smaller key, or the same key and a smaller id.
    splitters, missed = [], [i for i, (_, v) in enumerate(cuts) if abs(v - targets[i]) > group_tolerance * each]
    for i, (k, v) in enumerate(cuts):
        if i not in missed:
            splitters.append((k, None))
            continue
        below, group = (v, None), None
        for g in (k - 1, k):  # the group that straddles the target has one of these keys
            b0, b1 = (x[0] for x in _below(rows, [g, g + 1], "__key", "size"))
            if b0 <= targets[i] < b1:
                below, group = (b0, g), g
        if group is None:
            splitters.append((k, None))
            continue
        members = rows.filter(F.col("__key") == group)
        ends = members.agg(F.min(f"`{id_col}`").alias("a"), F.max(f"`{id_col}`").alias("b")).first()
        if ends["a"] is None:
            splitters.append((k, None))
            continue
        at = find_splitters(members.withColumn("__id", F.coalesce(F.col(f"`{id_col}`"), F.lit(ends["a"]))), [targets[i] - below[0]], "__id", "size", tolerance * each, ends["a"], ends["b"] + 1)[0][0]
        splitters.append((group, at))
    key, ident = F.col("__key"), F.col(f"`{id_col}`")
    number = F.lit(0)
    for k, at in splitters:
        past = key >= F.lit(k) if at is None else (key > F.lit(k)) | ((key == F.lit(k)) & F.coalesce(ident >= F.lit(at), F.lit(False)))
        number = number + past.cast("int")
    rows = rows.withColumn("shard", number)
    # Slots: fine ranges of the key are counted, then numbered apart; a hot key spreads over salts of the id.
    width = (1 << KEY_BITS) // (fine * shards) + 1
    rows = rows.withColumn("__fine", F.expr(f"cast(__key div {width} as int)"))
    parts = ["shard", "__fine", "__salt", "__sub"]
    usual = max(1, total["n"] // (fine * shards))
    rows = spread_alike(rows, "__like", usual)
    big = sorted({r["__fine"] for r in rows.groupBy("__fine").count().filter(F.col("count") > 4 * usual).collect()})
    salt = F.pmod(F.xxhash64(ident), F.lit(4 * fine)).cast("int")
    rows = rows.withColumn("__salt", F.when(F.col("__fine").isin(big), salt).otherwise(F.lit(0)) if big else F.lit(0))
    counts = rows.groupBy(*parts).count()
    # One row per (shard, fine range, salt): a few per shuffle partition, whatever the table's size.
    start, offsets = {}, []
    for r in sorted(counts.collect(), key=lambda r: tuple(r[p] for p in parts)):
        offsets.append((*(r[p] for p in parts), start.get(r["shard"], 0)))
        start[r["shard"]] = start.get(r["shard"], 0) + r["count"]
    table = spark.createDataFrame(offsets, "shard int, __fine int, __salt int, __sub int, __from bigint")
    rows = rows.join(F.broadcast(table), parts)
    w = Window.partitionBy(*parts).orderBy("__key", F.col(f"`{id_col}`"), "size", "text_crc32")
    return rows.withColumn("slot", F.col("__from") + F.row_number().over(w) - 1).drop("__key", "__like", "__part", "__fine", "__salt", "__sub", "__from")
