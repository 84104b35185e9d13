"""Process-once pipelines: marks, misses, backlogs and a runner that merges deltas."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut
from .mutations import upsert


def marks(done: DataFrame, step: str, key: str = "asset_id", version: str = "1") -> DataFrame:
    return done.select(F.col(key), F.lit(step).alias("step"), F.lit(version).alias("version")).distinct()


def backlog(assets: DataFrame, state: DataFrame, step: str, key: str = "asset_id", version: str = "1", misses: DataFrame | None = None, gone: DataFrame | None = None) -> DataFrame:
    """Assets without a mark of this step and version, without a miss of the step, and not in gone. A new
    version makes all assets pending again."""
    out = assets.join(state.filter((F.col("step") == step) & (F.col("version") == version)).select(key), key, "left_anti")
    if misses is not None:
        out = out.join(misses.filter(F.col("step") == step).select(key), key, "left_anti")
    return out.join(gone.select(key), key, "left_anti") if gone is not None else out


def record(state: DataFrame, new: DataFrame, key: str = "asset_id") -> DataFrame:
    """State with new marks; a newer version replaces the older one. Idempotent."""
    return upsert(state.select(key, "step", "version"), new.select(key, "step", "version"), [key, "step"])


def retry(misses: DataFrame, step: str | None = None) -> DataFrame:
    """Misses without those of a step (or any), which become pending again."""
    return misses.limit(0) if step is None else misses.filter(F.col("step") != step)


def pending(counts: dict[str, DataFrame]) -> DataFrame:
    """step, n of named backlogs, in one row each."""
    out = None
    for step, df in counts.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(step).alias("step"), "n")
        out = row if out is None else out.union(row)
    return out


def cached(old: DataFrame, assets: DataFrame, key: str, derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A derived-value table with the missing assets' values added; derive gets only those. Values of assets
    that are gone are left out."""
    kept = old.join(assets.select(key), key, "left_semi")
    fresh = cut(derive(assets.join(old.select(key), key, "left_anti")), "derived")
    return kept.unionByName(fresh.select(*old.columns))


def catalogue_backlog(photos: DataFrame, files: DataFrame, marks_: dict[str, DataFrame], hidden: DataFrame, allowed: DataFrame, misses: DataFrame, grouped: DataFrame, vision: bool = True, logcolor: bool = True) -> DataFrame:
    """step, n of the six kinds of pending work, each with its own predicate; a step that is switched off
    owes nothing. photos (asset_id, media_type), files (asset_id, sha256, byte_size), marks_ by step:
    similar, junk, blur, vision, logcolor (asset_id); misses (asset_id, step); grouped (asset_id)."""

    def left(df: DataFrame, *gone: DataFrame) -> DataFrame:
        for g in gone:
            df = df.join(g.select("asset_id"), "asset_id", "left_anti")
        return df

    missed = lambda step: misses.filter(F.col("step") == step)
    only = photos.filter("media_type = 'photo'")
    of_photos = files.join(only.select("asset_id"), "asset_id", "left_semi")
    sizes = of_photos.filter("byte_size is not null").groupBy("byte_size").count().filter("count > 1")
    unhashed = left(of_photos.filter("sha256 is null"), missed("hash")).join(sizes.select("byte_size"), "byte_size", "left_semi")
    none = photos.limit(0)
    return pending(
        {
            "similar": left(only, marks_["similar"], grouped, missed("similar"), hidden),
            "junk": left(photos, marks_["junk"], allowed),
            "blur": left(only, marks_["blur"]),
            "sha256": unhashed,
            "vision": left(only, marks_["vision"], allowed, missed("vision"), hidden) if vision else none,
            "logcolor": left(photos, marks_["logcolor"], missed("logcolor")) if logcolor else none,
        }
    )


def touched_groups(old: DataFrame, new: DataFrame, bucket: str) -> DataFrame:
    """All rows whose bucket a new row falls into, so that late arrivals pull old rows in."""
    return old.unionByName(new).join(new.select(bucket).distinct(), bucket, "left_semi")


@dataclass
class Step:
    """run gets the pending rows and gives what became of them, a row each, with a boolean column `missed` for those
    to be left alone until they are retried (without that column none is). gate says which assets may be taken."""

    name: str
    run: Callable[[DataFrame], DataFrame]
    version: str = "1"
    gate: Column | None = None


@dataclass
class Report:
    done: dict[str, int] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)


def run_steps(assets: DataFrame, state: DataFrame, misses: DataFrame, steps: list[Step], key: str = "asset_id", limit: int = 0) -> tuple[DataFrame, DataFrame, dict[str, DataFrame], Report]:
    """Runs steps in order over their backlogs; one that fails is reported and leaves its marks alone, the
    others go on. Returns state, misses, the processed rows by step, and a report. What a step gives is
    written to the shared folder once and then split by `missed`: its work runs once, and every row is either
    marked or missed. A null counts as not missed."""
    out, report = {}, Report()
    for step in steps:
        todo = backlog(assets if step.gate is None else assets.filter(step.gate), state, step.name, key, step.version, misses)
        if limit:
            todo = todo.orderBy(key).limit(limit)
        try:
            given = step.run(cut(todo, "backlog"))
            given = cut(given if "missed" in given.columns else given.withColumn("missed", F.lit(False)), step.name)
            missed = F.coalesce("missed", F.lit(False))
            done = given.filter(~missed).drop("missed")
            n = done.count()
        except Exception as e:  # a step's own failure mustn't stop the others
            report.errors[step.name] = f"{type(e).__name__}: {e}"[:500]
            continue
        out[step.name] = done
        report.done[step.name] = n
        state = record(state, marks(done, step.name, key, step.version), key)
        misses = misses.unionByName(given.filter(missed).select(key, F.lit(step.name).alias("step"))).distinct()
    return state, misses, out, report
