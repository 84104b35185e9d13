"""Components and star clusters of similarity edges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut, discard
from .relational import positions


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) of undirected edges (a, b). Every round each node takes
    the least label among its neighbours' and then its label's label; the pointer jump halves the rounds
    on long paths. Rounds are written to the shared folder."""
    e = cut(edges.select("a", "b").filter("a is not null and b is not null and a != b"), "edges")
    e = cut(e.union(e.select(F.col("b"), F.col("a"))).toDF("a", "b").distinct(), "edges")
    old = labels = cut(e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = e.join(labels, e["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        step = labels.join(near, "node").select("node", F.least("label", "m").alias("to"), "label")
        parents = labels.select(F.col("node").alias("to"), F.col("label").alias("up"))
        new = cut(step.join(parents, "to", "left").select("node", F.least("to", F.coalesce("up", "to")).alias("label"), (F.least("to", F.coalesce("up", "to")) != F.col("label")).alias("moved")), "labels")
        discard(old)
        old, labels = new, new.select("node", "label")
        if new.filter("moved").isEmpty():
            return labels.withColumnRenamed("label", "component")


#: Edges of a component that one task may hold; larger components are clustered in rounds over all tasks.
TASK_EDGES = 200_000
#: Rounds before what is left falls into components anew.
ROUNDS = 16


def star_clusters(edges: DataFrame, cap: int | None = 40) -> DataFrame:
    """seed, member, degree of greedy star clusters over undirected edges (a, b).

    Nodes become seeds by descending degree (distinct neighbours), then ascending id; a free seed takes
    its free neighbours, most connected first, up to cap members with itself; the rest stay free, and a
    seed without a free neighbour isn't a cluster. The order matters only inside a component: a component of up to
    TASK_EDGES edges is done by one task, together with others that its hash is dealt with, a larger one by
    `_star_rounds` or, with many edges a node, `_star_fronts`, with the same clusters.
    """
    e = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    both = e.union(e.select("b", "a"))
    degrees = cut(both.groupBy("a").agg(F.count("*").alias("d")), "degrees")
    e = e.join(degrees.withColumnRenamed("d", "da"), "a").join(degrees.select(F.col("a").alias("b"), F.col("d").alias("db")), "b").select("a", "b", "da", "db")
    kind = dict(e.dtypes)["a"]
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, done = cut(e, "edges"), []
    while True:
        comp = components(left.select("a", "b"))
        placed = cut(left.join(comp, left["a"] == comp["node"]).select("component", *left.columns), "placed")
        large = cut(placed.groupBy("component").count().filter(F.col("count") > TASK_EDGES).select("component"), "large")
        small = placed.join(large, "component", "left_anti")
        dealt = F.pmod(F.xxhash64("component"), F.lit(max(tasks, 4 * placed.count() // max(1, TASK_EDGES))))
        done.append(cut(small.groupBy(dealt.alias("deal")).applyInPandas(_greedy_stars(cap), f"seed {kind}, member {kind}, degree long"), "stars"))
        if large.isEmpty():
            return edges.sparkSession.read.schema(done[0].schema).parquet(*[d.written_to for d in done])
        rest = cut(placed.join(large, "component", "left_semi").drop("component"), "left")
        edges_left, nodes = rest.count(), rest.select("a").union(rest.select("b")).distinct().count()
        dense = cap is not None and 1 < cap <= NEAR and edges_left >= DENSE * nodes
        left, rounds = (_star_fronts(rest, cap, nodes) if dense else _star_rounds(rest, cap))
        done += rounds


def _greedy_stars(cap: int | None):
    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        degree: dict = {}
        for a, b, da, db in zip(pdf["a"], pdf["b"], pdf["da"], pdf["db"]):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
            degree[a], degree[b] = da, db
        rank = sorted(near, key=lambda x: (-degree[x], x))
        taken, out = set(), []
        for s in rank:
            if s in taken:
                continue
            free = sorted((m for m in near[s] if m not in taken), key=lambda x: (-degree[x], x))
            if not free:
                continue
            members = [s, *free][:cap]
            taken.update(members)
            out += [(s, m, degree[m]) for m in members]
        return pd.DataFrame(out, columns=["seed", "member", "degree"])

    return greedy


def _star_rounds(e: DataFrame, cap: int | None) -> tuple[DataFrame, list[DataFrame]]:
    """What is left of the edges (a, b, da, db: degrees in the whole graph) after some rounds, and their clusters.

    In a round every free node that comes before all others within two steps, along edges between free nodes,
    is a seed: no seed before it can take it or any of its neighbours, so its cluster is that of the greedy order.
    Seeds of one round have no neighbour in common. The edges of taken nodes go. The first free node of a component
    always is a seed, so every round gets on."""
    first = F.struct((-F.col("da")).alias("d"), F.col("a").alias("i"))
    other = F.struct((-F.col("db")).alias("d"), F.col("b").alias("i"))
    both = e.select("a", "b", first.alias("ra"), other.alias("rb"))
    both = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("rb").alias("ra"), F.col("ra").alias("rb"))), "stars-edges")
    done: list[DataFrame] = []
    for _ in range(ROUNDS):
        # Aggregates are written before they are joined: Spark splits a hot node's join only between scans.
        near = cut(both.groupBy("a").agg(F.min(F.least("ra", "rb")).alias("best")), "stars-near")
        two = both.join(near.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("ra").alias("ra"), F.min("best").alias("best"))
        seeds = cut(two.filter(F.col("best") == F.col("ra")).select("a"), "stars-seeds")
        members = both.join(seeds, "a").select("a", "b", "ra", "rb")
        if cap is not None:
            members = members.withColumn("rn", F.row_number().over(Window.partitionBy("a").orderBy("rb"))).filter(F.col("rn") < cap)
        rows = members.select(F.col("a").alias("seed"), F.col("b").alias("member"), (-F.col("rb.d")).alias("degree"))
        heads = members.groupBy("a").agg(F.min("ra").alias("ra")) if cap is None or cap > 1 else both.join(seeds, "a").groupBy("a").agg(F.min("ra").alias("ra"))
        rows = rows.unionByName(heads.select(F.col("a").alias("seed"), F.col("a").alias("member"), (-F.col("ra.d")).alias("degree")))
        done.append(cut(rows, "stars"))
        taken = done[-1].select("member")
        left = both.join(taken.withColumnRenamed("member", "a"), "a", "left_anti").join(taken.withColumnRenamed("member", "b"), "b", "left_anti").select(*both.columns)
        old, both = both, cut(left, "stars-edges")
        discard(old, near, seeds)
        if both.isEmpty():
            break
    once = both.filter("a < b")
    return cut(once.select("a", "b", (-F.col("ra.d")).alias("da"), (-F.col("rb.d")).alias("db")), "stars-left"), done


#: Edges a node from which on two steps lead almost anywhere, so that rounds would find a seed at a time.
DENSE = 32
#: First free nodes that one task walks, at least and at most, and neighbours of each that it is given.
FRONT, LARGEST_FRONT, NEAR = 2_000, 20_000, 200


def _star_fronts(e: DataFrame, cap: int, nodes: int) -> tuple[DataFrame, list[DataFrame]]:
    """What is left of the edges (a, b, da, db) after some fronts, and their clusters, for graphs of many edges a node.

    Nodes are numbered in the greedy order and edges stand in the order of their first node's number. A front is the
    first free nodes; one task walks them, each with its first NEAR free neighbours, in that order, and stops at
    a node whose neighbours given don't fill its cluster although it has more. That node comes first in the next
    front, where none of its neighbours given is taken, so every front gets on."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("db").alias("da"), F.col("da").alias("db")))
    names = cut(positions(both.select("a", "da").distinct(), [F.col("da").desc(), F.col("a")], "u"), "numbers")
    ends = e.join(names.select("a", "u"), "a").join(names.select(F.col("a").alias("b"), F.col("u").alias("v")), "b").select("u", "v")
    ends = cut(ends.union(ends.select("v", "u")).repartitionByRange("u").sortWithinPartitions("u"), "ordered-edges")
    size = max(FRONT, min(LARGEST_FRONT, nodes // 32))
    done: list[DataFrame] = []
    over: DataFrame | None = None
    start = 0

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["u", "rn"])
        taken, out, at = set(), [], 0
        u, v = pdf["u"].to_numpy(), pdf["v"].to_numpy()
        stop = int(u[-1]) + 1
        while at < len(u):
            seed, to = u[at], at
            while to < len(u) and u[to] == seed:
                to += 1
            near, given, at = v[at:to], to - at, to
            if seed in taken:
                continue
            free = [m for m in near if m not in taken][: cap - 1]
            if len(free) < cap - 1 and given >= NEAR:
                stop = int(seed)
                break
            if free:
                taken.update([seed, *free])
                out += [(seed, m, stop) for m in [seed, *free][:cap]]
        return pd.DataFrame([(s, m, stop) for s, m, _ in out] or [(-1, -1, stop)], columns=["seed", "member", "stop"])

    def apart(df: DataFrame, c: str) -> DataFrame:
        return df if over is None else df.join(over.select(F.col("member").alias(c)), c, "left_anti")

    for _ in range(ROUNDS):
        first = apart(names.filter(F.col("u") >= start).select("u"), "u").orderBy("u").limit(size)
        front = cut(first, "front")
        last = front.agg(F.max("u")).first()[0]
        if last is None:
            break
        given = apart(ends.filter(F.col("u").between(start, last)).join(front, "u", "left_semi"), "v")
        given = given.withColumn("rn", F.row_number().over(Window.partitionBy("u").orderBy("v"))).filter(F.col("rn") <= NEAR)
        found = cut(given.groupBy(F.lit(0).alias("one")).applyInPandas(walk, "seed long, member long, stop long"), "stars-found")
        end = found.agg(F.max("stop")).first()[0]
        start = last + 1 if end is None or end > last else end
        done.append(cut(found.filter("seed >= 0").select("seed", "member"), "stars-numbered"))
        over = e.sparkSession.read.schema(done[0].schema).parquet(*[d.written_to for d in done])
    out = over.join(names.select(F.col("u").alias("seed"), F.col("a").alias("s")), "seed").join(names.select(F.col("u").alias("member"), F.col("a").alias("m"), "da"), "member") if over is not None else None
    stars = [cut(out.select(F.col("s").alias("seed"), F.col("m").alias("member"), F.col("da").alias("degree")), "stars")] if out is not None else []
    # Free nodes before the start have no free neighbour.
    free = cut(apart(names.filter(F.col("u") >= start), "u").select("a"), "stars-free")
    left = e.join(free, "a", "left_semi").join(free.withColumnRenamed("a", "b"), "b", "left_semi").select(*e.columns)
    return cut(left, "stars-left"), stars


def keep_largest(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """keep, duplicates, sizes per cluster (seed, member): the largest member, ties to the smaller id."""
    rows = members.join(sizes, "member", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    return rows.groupBy("seed").agg(
        F.min(F.struct((-F.col("size")).alias("s"), F.col("member").alias("m")))["m"].alias("keep"),
        F.sort_array(F.collect_list(F.struct("member", "size"))).alias("members"),
    )


def one_hop(edges: DataFrame, kind: str, start: DataFrame) -> DataFrame:
    """Targets of typed edges (source, target, type) from the start nodes (node)."""
    return edges.filter(F.col("type") == kind).join(start, edges["source"] == start["node"]).select("source", "target").distinct()

