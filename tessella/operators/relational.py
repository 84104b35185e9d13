"""Selections, pages and top rows over DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import cut


def without(df: DataFrame, gone: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows of df whose key isn't in gone. Null keys of gone exclude nothing, null keys of df stay."""
    on = [on] if isinstance(on, str) else on
    return df.join(gone.select(*on), on, "left_anti")


def within(df: DataFrame, chosen: DataFrame, on: str | list[str]) -> DataFrame:
    on = [on] if isinstance(on, str) else on
    return df.join(chosen.select(*on), on, "left_semi")


def hidden(filtered: DataFrame, allowed: DataFrame, on: str) -> DataFrame:
    """Distinct keys that are filtered and not allowed again."""
    return without(filtered.select(on).distinct(), allowed, on)


def visible(df: DataFrame, filtered: DataFrame, allowed: DataFrame, on: str) -> DataFrame:
    return without(df, hidden(filtered, allowed, on), on)


def colliding(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key value occurs more than once."""
    return within(df, df.groupBy(key).count().filter("count > 1"), key)


def top(df: DataFrame, by: str | list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each group; the order must be total for a defined result."""
    by = [by] if isinstance(by, str) else by
    out = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__rn") <= n)
    return out.withColumnRenamed("__rn", rank) if rank else out.drop("__rn")


def largest(df: DataFrame, by: str, size: str, tie: list[str]) -> DataFrame:
    """The row of greatest size per group; ties go to the first by the tie columns."""
    return top(df, by, [F.col(size).desc_nulls_last(), *[F.col(t).asc() for t in tie]])


def page(df: DataFrame, order: list[Column], offset: int = 0, limit: int = 0, cap: int = 4000) -> DataFrame:
    """A page of already visible rows, with total and has_more on each. A limit above cap is cap, a limit
    of 0 or less gives all rows from offset; past the end there are no rows."""
    total, offset = df.count(), max(0, offset)
    if limit > 0:
        rows, end = df.orderBy(*order).offset(offset).limit(min(limit, cap)), min(total, offset + min(limit, cap))
    else:
        rows, end = resume(df, order, offset) if offset else df.orderBy(*order), total
    return rows.withColumns({"total": F.lit(total).cast("bigint"), "has_more": F.lit(end < total)})


def resume(df: DataFrame, order: list[Column], start: int) -> DataFrame:
    """The rows of a total order from the start-th on, by global positions, as an offset without a limit
    takes one partition."""
    return positions(df, order, "__at").filter(F.col("__at") >= start).drop("__at")


def optional_filters(df: DataFrame, given: dict[str, object], rules: dict[str, Callable[[object], Column]]) -> DataFrame:
    """Applies the rules whose argument is given: None, an empty text, an empty list and False count as not
    given. An argument without a rule is an error."""
    unknown = set(given) - set(rules)
    if unknown:
        raise KeyError(f"no filter named {sorted(unknown)}")
    for name, value in given.items():
        if value is not None and value is not False and value != "" and value != []:
            df = df.filter(rules[name](value))
    return df


def flagged(df: DataFrame, filtered: DataFrame, recycled: DataFrame, on: str) -> DataFrame:
    """Unpaged listing: recycled rows are left out, filtered ones stay with hidden set."""
    marks = filtered.select(on).distinct().withColumn("hidden", F.lit(True))
    return without(df, recycled, on).join(marks, on, "left").withColumn("hidden", F.coalesce("hidden", F.lit(False)))


def facets(df: DataFrame, columns: dict[str, Column | str]) -> DataFrame:
    """facet, value, n for each named column; null values aren't counted. One pass: rows are unpivoted
    before one aggregation."""
    pairs = F.array(*[F.struct(F.lit(k).alias("facet"), (F.col(c) if isinstance(c, str) else c).cast("string").alias("value")) for k, c in columns.items()])
    return df.select(F.explode(pairs).alias("p")).select("p.*").filter("value is not null").groupBy("facet", "value").agg(F.count("*").alias("n"))


def override(base: DataFrame, over: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """base with the columns' values from over where it has them."""
    o = over.select(on, *[F.col(c).alias(f"__{c}") for c in columns])
    out = base.join(o, on, "left")
    return out.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*[f"__{c}" for c in columns])


def stride(df: DataFrame, order: list[Column], shards: int, k: int) -> DataFrame:
    """Every shards-th row of a total order, from the k-th. Positions are global: partitions are range
    sorted and counted, so no task holds the table."""
    return positions(df, order, "__at").filter(F.pmod("__at", F.lit(shards)) == k).drop("__at")


#: Rows, about, that one task joins and counts in `left_distinct`.
TASK_ROWS = 1_000_000


def left_distinct(left: DataFrame, right: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """key and the number of different values that right has for it, for each key of left, 0 without any. Both sides
    are dealt once, over as many tasks as their rows need, so a task's memory doesn't grow with the tables."""
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(left.count() + right.count()) // TASK_ROWS))
    a, b = left.select(key).repartition(tasks, key), right.select(key, value).repartition(tasks, key)
    return a.join(b.hint("merge"), key, "left").groupBy(key).agg(F.countDistinct(value).alias(name))


def positions(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The 0-based place of each row in an order; rows that tie in it follow a hash of all their columns.

    One range exchange sorts the rows, and each gets its partition's number and its place there; the table
    is then written, so that counting the partitions and numbering the rows see the same ranges. The tie
    hash also lets Spark part a key that many rows share."""
    ties = F.xxhash64(*[f"`{f.name}`" for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))])
    keyed = df.withColumn("__tie", ties)
    ranged = keyed.repartitionByRange(*order, F.col("__tie")).sortWithinPartitions(*order, F.col("__tie")).drop("__tie")
    # The identifier's upper bits are the partition, its lower 33 bits the place.
    ranged = cut(ranged.withColumn("__id", F.monotonically_increasing_id()), "positions")
    part = F.shiftright("__id", 33)
    counts = ranged.groupBy(part.alias("__p")).count()
    before = F.sum("count").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))  # a row per partition
    starts = counts.select("__p", F.coalesce(before, F.lit(0)).alias("__from"))
    within = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.withColumn("__p", part).join(F.broadcast(starts), "__p").withColumn(name, F.col("__from") + within).drop("__p", "__id", "__from")


def hash_order(seed: int, *keys: str) -> Column:
    """A seeded pseudo-random order that doesn't depend on partitioning."""
    return F.sha2(F.concat_ws("\x1f", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]), 256)


def sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(hash_order(seed, key), key).limit(n)


def stratified(df: DataFrame, by: str, n: int, key: str, seed: int = 42) -> DataFrame:
    return top(df, by, [hash_order(seed, key), F.col(key)], n)


def stratified_top(df: DataFrame, by: str, strata: int, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """n rows of each of the `strata` commonest values, ties to the smaller value, in a seeded order of the keys."""
    common = df.filter(F.col(by).isNotNull()).groupBy(by).count().orderBy(F.col("count").desc(), by).limit(strata).select(by)
    return top(df.join(F.broadcast(common), by), by, [hash_order(seed, *keys), *map(F.col, keys)], n).select(*df.columns)


def even_picks(df: DataFrame, by: str, order: list[Column], n: int = 3) -> DataFrame:
    """n rows per group at places floor(i * count / n); all rows of smaller groups."""
    w = Window.partitionBy(by)
    rows = df.withColumn("__rn", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(w))
    chosen = F.col("__n") <= n
    for i in range(n):
        chosen = chosen | (F.col("__rn") == F.floor(F.lit(i) * F.col("__n") / n))
    return rows.filter(chosen).drop("__rn", "__n")


def numbered(df: DataFrame, order: list[Column], existing: DataFrame | None, id_col: str, prefix: str, digits: int = 7) -> DataFrame:
    """Serial ids for new rows, continuing after the largest existing one; ids of another form count as
    none."""
    last = 0
    if existing is not None:
        at = len(prefix) + 1
        last = existing.select(F.max(F.expr(f"try_cast(substring(`{id_col}`, {at}) as bigint)"))).first()[0] or 0
    out = positions(df, order, "__n")
    return out.withColumn(id_col, F.format_string(f"{prefix}%0{digits}d", (F.col("__n") + 1 + last).cast("bigint"))).drop("__n")
