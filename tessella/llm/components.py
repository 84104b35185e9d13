"""Connected components of an edge table: union-find inside partitions, then large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over blocks of a partition's edges; each block leaves one edge per node, to its root."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def flush():
        nodes = [x for x in parent if parent[x] != x]
        out = pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["u", "v"])
        parent.clear()
        return out

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            a, c = root(u), root(v)
            if a != c:
                parent[max(a, c)] = min(a, c)
        if len(parent) > 500_000:
            yield flush()
    if parent:
        yield flush()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for each node of the edges (u, v, both bigint); a node
    without a smaller neighbour is its own component. Null ends are ignored, loops and repeats harmless.

    Each round joins every node's neighbours to its smallest one. The smallest ones are an aggregate with
    map-side combine, written before the join, so that Spark can split the join for a node with many larger
    neighbours. A round's tables go when the next one is written. Rounds grow with the logarithm of a
    component's size.
    """
    e = edges.select(F.col("u").cast("bigint"), F.col("v").cast("bigint")).filter("u is not null and v is not null and u != v")
    e = cut(e.mapInArrow(_forest, "u bigint, v bigint").distinct(), "cc")
    state = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-low")
        # Large star: larger neighbours move to the smallest.
        j = both.join(low, "u")
        moved = j.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        # Small star: smaller neighbours and the node itself move to the smallest neighbour.
        least = moved.groupBy("u").agg(F.min("v").alias("m"))
        j = moved.join(least, "u")
        old, e = e, cut(j.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct(), "cc")
        discard(old, low)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1))).alias("h")).first()
        if state == (now["n"], now["h"]):
            break
        state = (now["n"], now["h"])
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
