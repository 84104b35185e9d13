"""Changes as pure functions of old and new rows; the caller writes the result beside what it read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class ConstraintError(ValueError):
    """A key, check or argument that must hold doesn't."""


def last_of(delta: DataFrame, key: list[str], order: list[Column] | None = None, first: bool = False) -> DataFrame:
    """One row per key of a delta, as if its rows came one after the other in the order: the last one, or the
    first. Without an order, rows of a key are ordered by all their columns, which is at least the same on
    every run."""
    cols = order or [F.col(f"`{c}`").asc_nulls_first() for c in delta.columns if c not in key]
    if not cols:
        return delta.dropDuplicates(key)
    rn = F.row_number().over(Window.partitionBy(*key).orderBy(*cols))
    n = F.count("*").over(Window.partitionBy(*key))
    return delta.withColumns({"__rn": rn, "__n": n}).filter(F.col("__rn") == (F.lit(1) if first else F.col("__n"))).drop("__rn", "__n")


def replace(old: DataFrame, new: DataFrame, key: list[str], order: list[Column] | None = None) -> DataFrame:
    """New rows win over old ones with their key; of new rows with one key the last."""
    new = last_of(new.select(*old.columns), key, order)
    return old.join(new.select(*key), key, "left_anti").select(*old.columns).unionByName(new)


def ignore(old: DataFrame, new: DataFrame, key: list[str], order: list[Column] | None = None) -> DataFrame:
    """Old rows win; of new rows with one key the first."""
    fresh = last_of(new.select(*old.columns), key, order, first=True).join(old.select(*key), key, "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def upsert(old: DataFrame, new: DataFrame, key: list[str], update: dict[str, str] | None = None, order: list[Column] | None = None) -> DataFrame:
    """Column-wise merge. update names columns and how they change: `new` takes the new value, `keep` the
    old one, `coalesce` the new one unless it is null. Columns not named keep the old value. Of new rows
    with one key the last counts."""
    update = update or {c: "new" for c in old.columns if c not in key}
    new = last_of(new.select(*old.columns), key, order)
    o = old.select(*key, F.struct(*old.columns).alias("__o"))
    n = new.select(*key, F.struct(*old.columns).alias("__n"))
    both = o.join(n, key, "full")

    def value(c: str) -> Column:
        if c in key:
            return F.col(c)
        how = update.get(c, "keep")
        a, b = F.col("__o")[c], F.col("__n")[c]
        held = F.col("__o").isNotNull() & F.col("__n").isNotNull()
        merged = {"new": b, "keep": a, "coalesce": F.coalesce(b, a)}[how]
        return F.when(held, merged).when(F.col("__n").isNull(), a).otherwise(b).alias(c)

    return both.select(*[value(c) for c in old.columns])


def delete(old: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return old.join(gone.select(*key), key, "left_anti").select(*old.columns)


def update_from(old: DataFrame, changes: DataFrame, key: list[str], columns: list[str], order: list[Column] | None = None) -> DataFrame:
    """Keyed update: listed columns take the change's value where there is one; of changes with one key the
    last counts, so no row of old is multiplied."""
    c = last_of(changes, key, order).select(*key, *[F.col(x).alias(f"__{x}") for x in columns], F.lit(True).alias("__hit"))
    out = old.join(c, key, "left")
    return out.withColumns({x: F.when(F.col("__hit"), F.col(f"__{x}")).otherwise(F.col(x)) for x in columns}).select(*old.columns)


def exclusive(df: DataFrame, group: str, order: list[Column], flag: str) -> DataFrame:
    """flag is true for the first row of each group and false for the others."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn(flag, F.row_number().over(w) == 1)


def recount(parents: DataFrame, children: DataFrame, key: str, column: str) -> DataFrame:
    """parents with column set to their number of children; 0 without any."""
    n = children.groupBy(key).agg(F.count("*").alias("__n"))
    return parents.drop(column).join(n, key, "left").withColumn(column, F.coalesce("__n", F.lit(0))).drop("__n")


def violations(df: DataFrame, key: list[str] | None = None, checks: dict[str, Column] | None = None, parent: tuple[DataFrame, str, str] | None = None) -> DataFrame:
    """constraint, n for each constraint that fails: unique keys, checks (false, not null, fails) and a
    parent table (df, child column, parent column)."""
    found = []
    if key:
        found.append(df.groupBy(*key).count().filter("count > 1").agg(F.count("*").alias("n")).select(F.lit("unique").alias("constraint"), "n"))
    for name, check in (checks or {}).items():
        found.append(df.filter(~check).agg(F.count("*").alias("n")).select(F.lit(name).alias("constraint"), "n"))
    if parent:
        p, c, k = parent
        loose = df.filter(F.col(c).isNotNull()).join(p.select(F.col(k).alias(c)), c, "left_anti")
        found.append(loose.agg(F.count("*").alias("n")).select(F.lit("parent").alias("constraint"), "n"))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out.filter("n > 0")


def enforce(df: DataFrame, **kw) -> DataFrame:
    bad = violations(df, **kw).collect()
    if bad:
        raise ConstraintError(", ".join(f"{r['constraint']}: {r['n']}" for r in bad))
    return df


# Catalogue edits ----------------------------------------------------------------------------------------
def move_tag(tags: DataFrame, assets: list[str], source: str | None, target: str) -> tuple[DataFrame, dict[str, int]]:
    """Moves assets from one tag to another (or only adds it): added rows are manual with confidence 1.
    Other tags stay; an asset that has the target already isn't added again."""
    if not target or not assets or source == target:
        raise ConstraintError("a target tag other than the source and at least one asset are needed")
    chosen = F.col("asset_id").isin(list(assets))
    gone = tags.filter(chosen & (F.col("tag") == source)) if source else tags.limit(0)
    left = tags.filter(~(chosen & (F.col("tag") == source))) if source else tags
    spark = tags.sparkSession
    new = spark.createDataFrame([(a,) for a in dict.fromkeys(assets)], "asset_id string").join(left.filter(F.col("tag") == target).select("asset_id"), "asset_id", "left_anti")
    new = new.select("asset_id", F.lit(target).alias("tag"), F.lit("manual").alias("source"), F.lit(1.0).alias("confidence"))
    counts = {"removed": gone.count(), "added": new.count()}
    return left.unionByName(new, allowMissingColumns=True).select(*tags.columns), counts


def replace_tags(tags: DataFrame, fresh: DataFrame, old_source: str) -> DataFrame:
    """Assets in fresh (asset_id, tag, source, confidence) lose their tags of old_source and get fresh ones."""
    left = tags.join(fresh.select("asset_id").distinct().withColumn("source", F.lit(old_source)), ["asset_id", "source"], "left_anti")
    return replace(left.select(*tags.columns), fresh, ["asset_id", "tag"])


def reassign_person(faces: DataFrame, people: DataFrame, asset: str, source: str, target: str | None) -> tuple[DataFrame, int]:
    """Gives one person's faces on an asset to another, or to nobody for a blank target, and locks them."""
    target = (target or "").strip() or None
    if not asset or not source or source == target:
        raise ConstraintError("an asset, a person and another target are needed")
    if target is not None and people.filter(F.col("person_id") == target).isEmpty():
        raise ConstraintError(f"no person {target}")
    hit = (F.col("asset_id") == asset) & (F.col("person_id") == source)
    n = faces.filter(hit).count()
    if not n:
        raise ConstraintError("no such face")
    hit = F.coalesce(hit, F.lit(False))
    out = faces.withColumns(
        {"person_id": F.when(hit, F.lit(target)).otherwise(F.col("person_id")), "person_locked": F.when(hit, F.lit(1)).otherwise(F.coalesce("person_locked", F.lit(0)))}
    )
    return out.select(*faces.columns), n


def clear_detected(faces: DataFrame, asset: str) -> DataFrame:
    """Before detection runs anew: an asset's automatic, unlocked faces go; manual and locked ones stay."""
    gone = (F.col("asset_id") == asset) & (F.coalesce("sample_role", F.lit("auto")) != "manual") & (F.coalesce("person_locked", F.lit(0)) == 0)
    return faces.filter(~F.coalesce(gone, F.lit(False)))


def sort_layout(layout: DataFrame, kind: str, targets: list[str], parent: str = "") -> DataFrame:
    """Sets sort_order by list position; targets without a row get one that is shown on the home page."""
    if not targets:
        raise ConstraintError("nothing to sort")
    spark = layout.sparkSession
    new = spark.createDataFrame([(kind, t, parent, i, 1) for i, t in enumerate(dict.fromkeys(targets))], "kind string, target string, parent string, sort_order int, show_on_home int")
    return upsert(layout.select("kind", "target", "parent", "sort_order", "show_on_home"), new, ["kind", "target"], {"sort_order": "new"})


def audit_rows(found: DataFrame, audit: DataFrame, reason: Column, at: str, key: str = "face_id") -> DataFrame:
    """INSERT INTO audit SELECT: the audit table with a row per finding (key, person_id) that it doesn't hold
    yet for the same person, with the reason and the time given."""
    new = found.select(F.col(key), "person_id", reason.alias("reason"), F.lit(at).cast("timestamp_ntz").alias("created_at"))
    fresh = new.join(audit.select(key, "person_id"), [key, "person_id"], "left_anti")
    return audit.select(*new.columns).unionByName(fresh.select(*new.columns))


def review_labels(reviews: DataFrame, answers: DataFrame, order: list[Column]) -> DataFrame:
    """Blind-review answers (item, side, choice, at) merged into the reviews; a later answer replaces an
    earlier one of the same item and side."""
    return upsert(reviews, answers, ["item", "side"], order=order)


def review_progress(items: DataFrame, reviews: DataFrame) -> DataFrame:
    """side, total, done, left of a review."""
    sides = reviews.select("side").distinct()
    total = items.agg(F.count("*").alias("total"))
    done = reviews.join(items, "item", "left_semi").groupBy("side").agg(F.countDistinct("item").alias("done"))
    out = sides.join(done, "side", "left").join(F.broadcast(total), how="cross").withColumn("done", F.coalesce("done", F.lit(0)))
    return out.select("side", "total", "done", (F.col("total") - F.col("done")).alias("left"))
