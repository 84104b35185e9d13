"""Groups of similar photos that grow run by run, and components that new links extend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import dot, hamming, norm
from ..sources.tables import cut
from . import sweep
from .graph import components, star_clusters
from .library import pick_best
from .relational import positions
from .similarity import digest_pairs, first_match, strong_arms

#: A photo joins a group whose leader lies within so many bits and seconds, near-duplicates lie within
#: so many, variants of a scene are so alike within so many seconds, and at most so many neighbours in time are compared.
APPEND_BITS, APPEND_SECONDS = 4, 6 * 3600
NEAR_BITS, NEAR_SECONDS = 6, 48 * 3600
ALIKE, ALIKE_SECONDS = 0.96, 90
NEIGHBOURS, GROUP_CAP = 120, 40


def similar_step(
    photos: DataFrame,
    groups: DataFrame,
    members: DataFrame,
    done: DataFrame,
    hidden: DataFrame,
    prefix: str = "sim_",
    append: tuple[int, float] = (APPEND_BITS, APPEND_SECONDS),
    near: tuple[int, float] = (NEAR_BITS, NEAR_SECONDS),
    alike: tuple[float, float] = (ALIKE, ALIKE_SECONDS),
    neighbours: int = NEIGHBOURS,
    cap: int | None = GROUP_CAP,
) -> tuple[DataFrame, DataFrame]:
    """One run over the photos that are in no group, not done and not hidden: the new members (group_id, asset_id,
    phase, is_best) and the photos that are done now (asset_id), which later runs only meet as old neighbours.

    photos: asset_id, source, at (seconds), code (64 bits), vector, digest, score. groups: group_id, best.
    members: group_id, asset_id. done, hidden: asset_id.

    Phase `append`: a photo joins the first group (least id) whose leader is not hidden and has its digest, or
    lies in its source and near it in code or vector within the stricter bounds. Phase `new`: of the others, those of
    one digest are linked, and each with those of its nearest neighbours in time (of the same source, so many at
    most) that are near in code or vector and in no group; old ones that are in none are pulled in. Star
    clusters of these links are the new groups, numbered on by the degree of their seeds; the best member leads. Members
    of old groups stay where they are. Photos without a time or code have digests only."""
    held = cut(members.select("asset_id").distinct(), "grouped")
    away = held.unionByName(done.select("asset_id")).unionByName(hidden.select("asset_id")).distinct()
    todo = cut(photos.join(away, "asset_id", "left_anti"), "todo")
    leaders = groups.select("group_id", F.col("best").alias("asset_id")).join(hidden.select("asset_id"), "asset_id", "left_anti").join(photos, "asset_id").drop("asset_id")
    leaders = cut(leaders, "leaders")
    arms = strong_arms(todo, leaders, "source", "at", code=("code", *append), vector=("vector", *alike), digest="digest")
    appended = cut(first_match(todo.select("asset_id"), arms, "asset_id", "group_id").select("group_id", "asset_id"), "appended")
    rest = todo.join(appended.select("asset_id"), "asset_id", "left_anti")
    rest_ids = cut(rest.select("asset_id"), "rest")
    same = digest_pairs(rest.select("asset_id", "digest"), "asset_id", "digest")
    timed = photos.filter("at is not null and code is not null").select("asset_id", "source", "at", "code")
    asked = timed.join(rest_ids.withColumn("ask", F.lit(True)), "asset_id", "left").withColumn("ask", F.coalesce("ask", F.lit(False)))
    met = sweep.nearest(asked, "asset_id", "source", "at", near[1], neighbours, ["code"], ask="ask")
    free = appended.select("asset_id").unionByName(held.join(rest_ids, "asset_id", "left_anti"))
    met = cut(met.join(free.withColumnRenamed("asset_id", "near"), "near", "left_anti").select("asset_id", "near", "dt", "near_code"), "neighbours")
    codes = met.join(timed.select("asset_id", "code"), "asset_id").filter(hamming("code", "near_code") <= near[0])
    # Lengths are taken once a photo, not once a pair.
    v = photos.select("asset_id", "vector", norm("vector").alias("length")).filter("length > 1e-6")
    close = met.filter(F.col("dt") <= alike[1]).join(v, "asset_id").join(v.toDF("near", "other", "other_length"), "near")
    close = close.filter(dot("vector", "other") / (F.col("length") * F.col("other_length")) >= alike[0])
    pairs = same.unionByName(codes.select(F.col("asset_id").alias("a"), F.col("near").alias("b"))).unionByName(close.select(F.col("asset_id").alias("a"), F.col("near").alias("b")))
    stars = cut(star_clusters(pairs, cap), "stars")
    last = members.select(F.max(F.expr(f"try_cast(substring(group_id, {len(prefix) + 1}) as bigint)"))).first()[0]
    start = 0 if last is None else last + 1
    seeds = positions(stars.filter("seed = member").select("seed", "degree"), [F.col("degree").desc(), F.col("seed")], "n")
    named = seeds.select("seed", F.format_string(f"{prefix}%07d", F.col("n") + start).alias("group_id"))
    fresh = stars.join(named, "seed").select("group_id", F.col("member").alias("asset_id")).join(photos.select("asset_id", "score"), "asset_id")
    fresh = pick_best(fresh, "group_id", "score", "asset_id").select("group_id", "asset_id", F.lit("new").alias("phase"), "is_best")
    old = appended.select("group_id", "asset_id", F.lit("append").alias("phase"), F.lit(False).alias("is_best"))
    return cut(old.unionByName(fresh), "new-members"), todo.select("asset_id")


def extend_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """node, component, changed: components (node, component: the least node of each) with new links (a, b) added.

    The links' ends are replaced by their components, and only those are joined up anew: a link inside a
    component costs nothing, and rows of components that no link leaves are passed on as they are. Any split of
    links into batches gives the components of all of them at once."""
    ends = links.select("a", "b").filter("a is not null and b is not null")
    of = labels.select(F.col("node").alias("n"), F.col("component").alias("c"))
    for end in ("a", "b"):
        ends = ends.join(of, ends[end] == of["n"], "left").withColumn(f"c{end}", F.coalesce("c", end)).drop("n", "c")
    ends = cut(ends, "ends")
    moved = components(ends.filter("ca != cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    moved = cut(moved.select(F.col("node").alias("component"), F.col("component").alias("to")), "moved")
    fresh = ends.select(F.col("a").alias("node")).unionByName(ends.select(F.col("b").alias("node"))).distinct().join(labels.select("node"), "node", "left_anti")
    fresh = fresh.join(moved.withColumnRenamed("component", "node"), "node", "left").select("node", F.coalesce("to", "node").alias("component"), F.lit(True).alias("changed"))
    old = labels.select("node", "component").join(moved, "component", "left")
    old = old.select("node", F.coalesce("to", "component").alias("component"), F.coalesce(F.col("to") != F.col("component"), F.lit(False)).alias("changed"))
    return old.unionByName(fresh)
