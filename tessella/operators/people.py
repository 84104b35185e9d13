"""Edits of people and their faces, crops of assets, and suggestions of whom a face shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut
from .mutations import ConstraintError, delete, last_of, upsert
from .relational import top
from .similarity import knn


def assign_faces(faces: DataFrame, given: DataFrame, people: DataFrame) -> DataFrame:
    """faces (face_id, person_id, person_locked, ...) where given (face_id, person_id) names them: they get the person, or
    none for a null, and are locked, so no automatic run changes them. Of several changes of a face the last counts.
    A person that people lacks is an error."""
    given = cut(last_of(given.select("face_id", "person_id"), ["face_id"]), "given-faces")
    unknown = given.filter("person_id is not null").join(people.select("person_id"), "person_id", "left_anti")
    if not unknown.isEmpty():
        raise ConstraintError(f"no person {unknown.first()['person_id']}")
    g = given.select("face_id", F.col("person_id").alias("__person"), F.lit(True).alias("__hit"))
    out = faces.join(g, "face_id", "left")
    hit = F.coalesce("__hit", F.lit(False))
    return out.withColumns({"person_id": F.when(hit, F.col("__person")).otherwise(F.col("person_id")), "person_locked": F.when(hit, F.lit(1)).otherwise(F.coalesce("person_locked", F.lit(0)))}).select(*faces.columns)


def assign_clusters(faces: DataFrame, given: DataFrame) -> DataFrame:
    """faces (with cluster_id, ignored) of the clusters that given (cluster_id, person_id, ignored) names: those without a person
    and not locked get its person, where it has one, and its flag, where it has one. Of several changes of a cluster the
    last counts."""
    g = last_of(given.select("cluster_id", "person_id", "ignored"), ["cluster_id"])
    g = cut(g.select("cluster_id", F.col("person_id").alias("__person"), F.col("ignored").alias("__ignored")), "given-clusters")
    out = faces.join(g, "cluster_id", "left")
    free = F.col("person_id").isNull() & (F.coalesce("person_locked", F.lit(0)) == 0)
    return out.withColumns(
        {"ignored": F.when(free, F.coalesce("__ignored", "ignored")).otherwise(F.col("ignored")), "person_id": F.when(free, F.col("__person")).otherwise(F.col("person_id"))}
    ).select(*faces.columns)


def edit_people(people: DataFrame, faces: DataFrame, named: DataFrame | None = None, avatars: DataFrame | None = None, gone: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """people (person_id, display_name, avatar) and faces after: named (person_id, display_name) creates and renames; avatars
    (person_id, face_id) count only where the face is that person's; gone (person_id) takes people away, whose faces belong to
    nobody, locked or not. In this order."""
    if named is not None:
        full = named.select("person_id", "display_name", F.lit(None).cast(dict(people.dtypes)["avatar"]).alias("avatar"))
        people = upsert(people.select("person_id", "display_name", "avatar"), full, ["person_id"], {"display_name": "new"})
    if avatars is not None:
        own = last_of(avatars.select("person_id", "face_id"), ["person_id"]).join(faces.select("face_id", "person_id"), ["face_id", "person_id"], "left_semi")
        people = people.join(own, "person_id", "left").withColumn("avatar", F.coalesce("face_id", "avatar")).select("person_id", "display_name", "avatar")
    if gone is not None:
        lost = gone.select("person_id").distinct().withColumn("__gone", F.lit(True))
        people = delete(people, gone, ["person_id"])
        faces = faces.join(lost, "person_id", "left").withColumn("person_id", F.when(F.col("__gone"), None).otherwise(F.col("person_id"))).select(*faces.columns)
    return people, faces


def suggestions(faces: DataFrame, vector: str, neighbours: int = 20, most: int = 3) -> DataFrame:
    """face_id, person_id, sim, rank: up to `most` people for each face that has none and isn't ignored, by the best similarity
    of their faces among its nearest ones; ties go to the smaller person."""
    known = faces.filter("person_id is not null").select("face_id", vector, "person_id")
    asked = faces.filter("person_id is null and not coalesce(ignored, false)").select("face_id", vector)
    near = knn(asked, known, "face_id", vector, "person_id", neighbours)
    best = near.groupBy(F.col("query").alias("face_id"), F.col("label").alias("person_id")).agg(F.max("sim").alias("sim"))
    return top(best, "face_id", [F.col("sim").desc(), F.col("person_id")], most, rank="rank")


def edit_crops(crops: DataFrame, given: DataFrame, cleared: DataFrame) -> DataFrame:
    """crops (asset_id, x, y, w, h) with the given ones set, the last of each asset, and those of cleared (asset_id) taken away; a crop
    must lie inside the unit square and have an area, else it is an error."""
    inside = (F.col("w") > 0) & (F.col("h") > 0) & (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") + F.col("w") <= 1 + 1e-9) & (F.col("y") + F.col("h") <= 1 + 1e-9)
    bad = given.filter(~F.coalesce(inside, F.lit(False)))
    if not bad.isEmpty():
        raise ConstraintError(f"the crop of {bad.first()['asset_id']} isn't inside its picture")
    return delete(upsert(crops, given.select(*crops.columns), ["asset_id"]), cleared, ["asset_id"])


def crop_map(assets: DataFrame, crops: DataFrame) -> DataFrame:
    """Every asset with its crop, the whole picture where it has none, and whether it has one."""
    c = crops.select("asset_id", F.struct("x", "y", "w", "h").alias("__c"))
    whole = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("w"), F.lit(1.0).alias("h"))
    out = assets.join(c, "asset_id", "left").withColumn("cropped", F.col("__c").isNotNull()).withColumn("__c", F.coalesce("__c", whole))
    return out.select(*assets.columns, "__c.x", "__c.y", "__c.w", "__c.h", "cropped")
