"""Compositions that a media catalogue asks for: grouping step by step, trips, asset cards, people."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import star_clusters
from .mutations import exclusive
from .relational import numbered
from .similarity import first_match


def extend_groups(members: DataFrame, new: DataFrame, matches: list[DataFrame], links: DataFrame, cap: int = 40, prefix: str = "sim_") -> DataFrame:
    """group_id, asset_id, phase of a run over new assets.

    Phase `append`: an asset that matches existing groups (tables of asset_id, group_id) joins the first.
    Phase `new`: star clusters over the links (a, b) of assets that are in no group yet, numbered after the
    largest existing id. Members of existing groups stay where they are.
    """
    held = members.select("asset_id").distinct()
    fresh = new.select("asset_id").distinct().join(held, "asset_id", "left_anti")
    appended = first_match(fresh, matches, "asset_id", "group_id").select("group_id", "asset_id")
    taken = held.union(appended.select("asset_id"))
    free = links
    for end in ("a", "b"):
        free = free.join(taken.select(F.col("asset_id").alias(end)), end, "left_anti")
    stars = star_clusters(free.select("a", "b"), cap)
    ids = numbered(stars.select("seed").distinct(), [F.col("seed")], members, "group_id", prefix)
    created = stars.join(ids, "seed").select("group_id", F.col("member").alias("asset_id"))
    return appended.withColumn("phase", F.lit("append")).unionByName(created.withColumn("phase", F.lit("new")))


def assign_trips(assets: DataFrame, trips: DataFrame, day: str = "day") -> DataFrame:
    """asset_id, trip_id of the trips (trip_id, first_day, last_day) that hold an asset's day: trips are
    expanded to their days, so the range join is an equi-join."""
    days = trips.select("trip_id", F.explode(F.sequence("first_day", "last_day")).alias(day))
    return assets.select("asset_id", day).join(days, day).select("asset_id", "trip_id")


def cards(assets: DataFrame, tags: DataFrame, people: DataFrame) -> DataFrame:
    """assets with sorted tags and people; empty arrays without any."""
    def listed(df: DataFrame, c: str, name: str) -> DataFrame:
        return df.groupBy("asset_id").agg(F.sort_array(F.collect_set(c)).alias(name))

    out = assets.join(listed(tags, "tag", "tags"), "asset_id", "left").join(listed(people, "person_id", "people"), "asset_id", "left")
    none = F.expr("cast(array() as array<string>)")
    return out.withColumns({"tags": F.coalesce("tags", none), "people": F.coalesce("people", none)})


def people_counts(people: DataFrame, faces: DataFrame) -> DataFrame:
    """people with their numbers of faces and assets, 0 for none."""
    n = faces.groupBy("person_id").agg(F.count("*").alias("faces"), F.countDistinct("asset_id").alias("assets"))
    return people.join(n, "person_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("faces", "assets")})


def merge_quality(blur: DataFrame, aesthetic: DataFrame) -> tuple[DataFrame, int]:
    """Quality rows are driven by the blur results; the count is of all assets that either has."""
    from ..functions.expr import combined_quality

    rows = blur.join(aesthetic, "asset_id", "left").withColumn("quality_score", combined_quality("aesthetic", "label"))
    return rows, blur.select("asset_id").union(aesthetic.select("asset_id")).distinct().count()


def regions(assets: DataFrame, geo: DataFrame, manual: DataFrame) -> DataFrame:
    """region, n, gps_n: manual places override found ones."""
    m = manual.select("asset_id", F.col("region").alias("__m"))
    g = geo.select("asset_id", "region", "lat").join(m, "asset_id", "full").withColumn("region", F.coalesce("__m", "region"))
    return assets.join(g, "asset_id").groupBy("region").agg(F.count("*").alias("n"), F.count("lat").alias("gps_n"))


def pick_best(members: DataFrame, group: str, score: str, key: str, again: bool = False) -> DataFrame:
    """members with is_best for the row of the highest score in each group: a tie goes to the larger key where
    groups are new, to the smaller, its first member, where they are picked again. A null score is the lowest."""
    tie = F.col(key).asc() if again else F.col(key).desc()
    return exclusive(members, group, [F.col(score).desc_nulls_last(), tie], "is_best")


def set_best(members: DataFrame, chosen: DataFrame, group: str, key: str) -> DataFrame:
    """members (with is_best) where groups that chosen (group, key) names have that member as their only best
    one; a choice that isn't a member of its group changes nothing."""
    valid = chosen.join(members.select(group, key), [group, key], "left_semi").groupBy(group).agg(F.min(key).alias("__best"))
    out = members.join(valid, group, "left")
    return out.withColumn("is_best", F.when(F.col("__best").isNotNull(), F.col(key) == F.col("__best")).otherwise(F.col("is_best"))).select(*members.columns)
