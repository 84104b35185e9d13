"""Star clusters of vectors whose pairs are too many to be written."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut, discard
from .graph import DENSE, star_clusters
from .relational import positions
from .similarity import DIGITS, _side, meet, near_blocks, similar_pairs

#: Pairs up to which they are written, and rows up to which they aren't counted first.
FEW_PAIRS, FEW_ROWS = 200_000, 4_096
#: Free nodes that one task walks, about, bytes of their vectors, at most, and numbers of a stretch whose free nodes are counted.
WALK, WALK_BYTES, STRETCH = 32_768, 64 << 20, 4_096
#: Nodes that are given neighbours from behind the walk, and how many of them.
AHEAD, NEAR = 1_024, 256
#: Rows and columns of a product that is counted at once.
COUNTED = 1_024


class _Vectors:
    """Vectors in double and, where that is safe, single precision, with their largest length."""

    def __init__(self, v: np.ndarray):
        self.v = v
        self.long = float(np.linalg.norm(v, axis=1).max(initial=0.0))
        self.short = v.astype(np.float32) if self.long < 1e15 else None


def _near(a: _Vectors, i: slice, b: _Vectors, j: slice, least: float) -> np.ndarray:
    """Whether the dot products of rows i of a and j of b reach `least` when rounded to 12 digits. Products in single
    precision decide where they are further from it than their error; the others are taken in double."""
    x, y = a.v[i], b.v[j]
    if a.short is None or b.short is None:
        return np.round(x @ y.T, 12) >= least
    slack = np.float32((x.shape[1] + 8) * 2.0**-23 * a.long * b.long + DIGITS)
    sims = a.short[i] @ b.short[j].T
    near = sims >= np.float32(least) - slack
    rows, cols = _true(near ^ (sims >= np.float32(least) + slack))
    if len(rows):
        near[rows, cols] = np.round(np.einsum("ij,ij->i", x[rows], y[cols]), 12) >= least
    return near


def _true(few: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the true ones among many, looked for by eight."""
    flat = few.reshape(-1)
    if len(flat) % 8:
        return np.nonzero(few)
    at = (8 * np.flatnonzero(flat.view(np.uint64))[:, None] + np.arange(8)).reshape(-1)
    return np.divmod(at[flat[at]], few.shape[1])


def _degrees(packed: DataFrame, pairs: DataFrame, side: int, least: float) -> DataFrame:
    """block, counts: for each row of a block, in its order, how many other rows are near it. Pairs of blocks are met once."""

    def run(block: int, rows: pa.ListArray, others: list, cell: dict) -> Iterator[pa.RecordBatch]:
        a = _Vectors(_side(rows, 0, 0)[1])
        mine = np.zeros(len(a.v), np.int64)
        out = []
        for other, theirs in others:
            if other not in cell:
                cell[other] = _Vectors(_side(theirs, 0, 0)[1])
            b = cell[other]
            if a.v.shape[1] != b.v.shape[1] and len(a.v) and len(b.v):
                raise ValueError(f"vectors have different lengths: {a.v.shape[1]} and {b.v.shape[1]}")
            counts = np.zeros(len(b.v), np.int64)
            for lo in range(0, len(a.v), COUNTED):
                for at in range(0, len(b.v), COUNTED):
                    near = _near(a, slice(lo, lo + COUNTED), b, slice(at, at + COUNTED), least)
                    if other == block and lo == at:
                        np.fill_diagonal(near, False)
                    mine[lo : lo + COUNTED] += np.count_nonzero(near, axis=1)
                    if other != block:
                        for r in range(0, len(near), 255):  # a byte holds as many
                            counts[at : at + COUNTED] += near[r : r + 255].view(np.uint8).sum(axis=0, dtype=np.uint8)
            if other != block:
                out.append((other, counts))
        out.append((block, mine))
        yield pa.RecordBatch.from_arrays([pa.array([o for o, _ in out], pa.int32()), pa.array([c for _, c in out], pa.list_(pa.int64()))], names=["block", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([held], pa.list_(pa.int64()))], names=["block", "counts"])
        for b in batches:
            for i, block in enumerate(b.column(0).to_pylist()):
                counts = b.column(1).slice(i, 1).flatten().to_numpy()
                if block == at:
                    held = held + counts
                    continue
                if at is not None:
                    yield row()
                at, held = block, counts
        if at is not None:
            yield row()

    parts = cut(meet(packed, packed, pairs, run, "block int, counts array<bigint>", side=side), "counts-of-blocks")
    return parts.repartition("block").sortWithinPartitions("block").mapInArrow(total, parts.schema)


def similar_stars(df: DataFrame, key: str, vector: str, least: float, cap: int | None = 40) -> DataFrame:
    """seed, member, degree: `star_clusters` of the pairs that `similar_pairs` finds, which aren't written where they are many.

    Blocks meet once and only count their rows' near rows, which gives the greedy order. In it, one task walks the first
    free nodes, about WALK, and looks for a seed's first free neighbours among those behind it; a node that they don't
    fill ends the walk, and comes first in the next, which sees others behind. Where a walk gets nowhere, the
    first AHEAD nodes are given their first NEAR free neighbours of all that the walk doesn't see. So work on
    pairs is that of the counts, products in tasks of bounded memory, and what is written grows with the rows."""
    pairs = lambda: star_clusters(similar_pairs(df, key, vector, least).select("a", "b"), cap)
    rows = df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull())
    if cap is None or cap < 2 or cap > NEAR or rows.count() <= FEW_ROWS or not rows.groupBy(key).count().filter("count > 1").isEmpty():
        return pairs()
    packed, met, side, _ = near_blocks(rows, key, vector, least)
    counts = _degrees(packed, met, side, least)
    nodes = packed.join(counts, "block").select(F.inline(F.arrays_zip(F.col("rows.k").alias("k"), F.col("rows.v").alias("v"), F.col("counts").alias("d"))))
    nodes = cut(nodes.toDF("k", "v", "d").filter("d > 0"), "nodes")
    n, ends, width = nodes.agg(F.count("*"), F.sum("d"), F.max(F.size("v"))).first()
    if not n or ends <= 2 * FEW_PAIRS or ends < 2 * DENSE * n:
        return pairs()
    names = cut(positions(nodes, [F.col("d").desc(), F.col("k")], "u"), "numbers")
    discard(nodes)
    return _walks(names, n, max(256, min(WALK, WALK_BYTES // (8 * width))), least, cap)


def _walks(names: DataFrame, n: int, most: int, least: float, cap: int) -> DataFrame:
    """seed, member, degree over nodes (k, v, d, u: number in the greedy order, from 0)."""
    spark = names.sparkSession
    free = [min(STRETCH, n - at) for at in range(0, n, STRETCH)]
    found: list[DataFrame] = []
    start, ahead = 0, False
    while start < n:
        first = last = start // STRETCH
        seen = free[first]
        while last + 1 < len(free) and (not seen or seen + free[last + 1] <= most):
            last += 1
            seen += free[last]
        end = min(n, (last + 1) * STRETCH)
        over = spark.read.schema(found[0].schema).parquet(*[f.written_to for f in found]).select(F.col("member").alias("u")) if found else None
        left = names.select("u", "v") if over is None else names.select("u", "v").join(over.filter(F.col("u") >= start), "u", "left_anti")
        seats = left.filter((F.col("u") >= start) & (F.col("u") < end))
        if ahead and end < n:
            seats = seats.join(_beyond(seats.orderBy("u").limit(AHEAD), left.filter(F.col("u") >= end), least), "u", "left")
        else:
            seats = seats.withColumn("far", F.lit(None).cast("array<bigint>"))
        walked = seats.repartition(1).sortWithinPartitions("u").mapInArrow(_walk(least, cap, end, end == n), "seed bigint, member bigint, stop bigint")
        walked = cut(walked, "stars-walked")
        stop = walked.agg(F.max("stop")).first()[0]
        found.append(walked.filter("seed >= 0").select("seed", "member"))
        found[-1].written_to = walked.written_to
        for r in walked.filter("seed >= 0").groupBy(F.expr(f"cast(member div {STRETCH} as int)").alias("s")).count().collect():
            free[r["s"]] -= r["count"]
        # No row: no free node was left in these stretches.
        new = end if stop is None else stop
        ahead, start = new - start < AHEAD, new
    whole = spark.read.schema(found[0].schema).parquet(*[f.written_to for f in found]).filter("seed >= 0")
    seeds = names.select(F.col("u").alias("seed"), F.col("k").alias("s"))
    out = whole.join(seeds, "seed").join(names.select(F.col("u").alias("member"), F.col("k").alias("m"), F.col("d").alias("degree")), "member")
    return out.select(F.col("s").alias("seed"), F.col("m").alias("member"), "degree")


def _walk(least: float, cap: int, end: int, whole: bool):
    """Walks rows (u, v, far) in order: seed, member, and in every row stop, where the next walk begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        u = np.concatenate([b.column(0).to_numpy() for b in got])
        v = _Vectors(np.concatenate([b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1) for b in got]))
        far = {int(u[i]): x for i, x in enumerate(x for b in got for x in b.column(2)) if x.is_valid}
        taken, away = np.zeros(len(u), bool), set()
        # Free nodes behind the current one stand together, so that products skip those that were taken.
        where, near = np.arange(len(u)), v
        seeds, members, stop = [], [], end
        for i in range(len(u)):
            if taken[i]:
                continue
            at = int(np.searchsorted(where, i))
            if np.count_nonzero(taken[where[at : at + 2_048]]) > 1_024:
                where = where[at:][~taken[where[at:]]]
                near, at = _Vectors(v.v[where]), 0
            mine, step, lo = [], 1_024, at + 1
            while lo < len(where) and len(mine) < cap - 1:
                fits = where[lo : lo + step][_near(v, slice(i, i + 1), near, slice(lo, lo + step), least)[0]]
                mine += fits[~taken[fits]].tolist()
                lo, step = lo + step, min(2 * step, 16_384)
            mine = u[mine[: cap - 1]].tolist()
            if len(mine) < cap - 1 and not whole:
                given = far.get(int(u[i]))
                more = [] if given is None else [x for x in given.as_py() if x not in away]
                mine += more[: cap - 1 - len(mine)]
                if given is None or len(mine) < cap - 1 and len(given) >= NEAR:
                    stop = int(u[i])
                    break
            if mine:
                seeds += [int(u[i])] * (1 + len(mine))
                members += [int(u[i]), *mine]
                inside = np.array([x for x in mine if x < end], np.int64)
                taken[np.searchsorted(u, inside)] = True
                away.update(x for x in mine if x >= end)
        seeds, members = seeds or [-1], members or [-1]
        yield pa.RecordBatch.from_arrays([pa.array(seeds, pa.int64()), pa.array(members, pa.int64()), pa.array([stop] * len(seeds), pa.int64())], names=["seed", "member", "stop"])

    return run


def _beyond(front: DataFrame, others: DataFrame, least: float) -> DataFrame:
    """u, far: the first NEAR of others (u, v), in order, that are near each row (u, v) of a front of a bounded number of rows."""
    rows = front.orderBy("u").collect()
    u, v = np.array([r["u"] for r in rows], np.int64), np.array([r["v"] for r in rows], float)
    sent = front.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _Vectors(sent.value)
        for b in batches:
            if b.num_rows:
                theirs = _Vectors(b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1))
                i, j = np.nonzero(_near(a, slice(None), theirs, slice(None), least))
                number = b.column(0).to_numpy()[j]
                order = np.lexsort((number, i))
                i, number = i[order], number[order]
                few = np.arange(len(i)) - np.searchsorted(i, i) < NEAR
                yield pa.RecordBatch.from_arrays([pa.array(u[i[few]]), pa.array(number[few])], names=["u", "near"])

    met = others.mapInArrow(run, "u bigint, near bigint").withColumn("rn", F.row_number().over(Window.partitionBy("u").orderBy("near")))
    lists = met.filter(F.col("rn") <= NEAR).groupBy("u").agg(F.sort_array(F.collect_list("near")).alias("far"))
    # A row without a neighbour there has an empty list: it is known to have none.
    asked = front.sparkSession.createDataFrame([(int(x),) for x in u], "u bigint")
    return asked.join(lists, "u", "left").withColumn("far", F.coalesce("far", F.expr("cast(array() as array<bigint>)")))
