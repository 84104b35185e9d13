"""Scans along an order inside each group, however large the group: range partitions and a carry between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut


def before(df: DataFrame, group: list[str], order: list[Column], name: str, last: Column | None = None, total: Column | None = None) -> DataFrame:
    """df with a column of what comes before each row in its group: the last value of `last` that isn't null
    (null if there is none), or the sum of `total` (0). Rows of null groups have no order and are left out.

    One range exchange sorts all groups, and the sorted rows are written. A window sees the part of a group
    that lies in one partition; what a group has in earlier partitions is carried, by one row for each partition that
    goes on with the group of an earlier one, so a group of any size is spread over partitions."""
    keys = [F.col(g) for g in group]
    rows = df.filter(" and ".join(f"`{g}` is not null" for g in group)).withColumn("__value", last if last is not None else total)
    rows = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    # The identifier's upper bits are the partition, its lower ones the place there.
    rows = cut(rows.withColumn("__at", F.monotonically_increasing_id()), "sweep").withColumn("__part", F.shiftright("__at", 33))
    here = Window.partitionBy("__part", *group).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    if last is not None:
        whole = F.max_by("__value", F.when(F.col("__value").isNotNull(), F.col("__at")))
        inside, carried = F.last("__value", ignorenulls=True).over(here), F.last("__whole", ignorenulls=True).over(earlier)
    else:
        whole, inside, carried = F.sum("__value"), F.sum("__value").over(here), F.sum("__whole").over(earlier)
    carry = rows.groupBy("__part", *group).agg(whole.alias("__whole")).withColumn("__carry", carried).filter("__carry is not null")
    out = rows.withColumn("__in", inside).join(F.broadcast(carry.select("__part", *group, "__carry")), ["__part", *group], "left")
    both = F.coalesce("__in", "__carry") if last is not None else F.coalesce("__in", F.lit(0)) + F.coalesce("__carry", F.lit(0))
    return out.withColumn(name, both).select(*df.columns, name)


def next_beyond(times: DataFrame, group: str, at: str, width, name: str) -> DataFrame:
    """Distinct (group, at) with the first time of the group that is more than width later; null without any. Times
    and the places that look for one are sorted together, backwards."""
    kind = dict(times.dtypes)[at]
    data = times.select(group, F.col(at).alias("__v"), F.lit(0).alias("__ask"), F.col(at).alias("__t"))
    asks = times.select(group, (F.col(at) + F.lit(width)).cast(kind).alias("__v"), F.lit(1).alias("__ask"), F.col(at).alias("__t"))
    seen = before(data.unionByName(asks), [group], [F.col("__v").desc(), F.col("__ask").desc()], name, last=F.when(F.col("__ask") == 0, F.col("__t")))
    return seen.filter("__ask = 1").select(group, F.col("__t").alias(at), name)


def marks(times: DataFrame, group: str, at: str, width) -> DataFrame:
    """Distinct (group, at) with the anchor of each: a group's first time is an anchor, and so is the first
    time more than width after the last anchor.

    A time more than width after the one before it is an anchor whatever came earlier, so stretches between such
    gaps are apart. Each time points to the first one beyond its width; the pointers are doubled, and in each
    round all anchors so far mark the ones their pointers lead to: rounds grow with the logarithm of a
    stretch's anchors."""
    times = times.select(group, at).filter(F.col(group).isNotNull() & F.col(at).isNotNull()).distinct()
    prior = before(times, [group], [F.col(at)], "__prior", last=F.col(at))
    known = prior.withColumn("__start", F.col("__prior").isNull() | (F.col(at) - F.col("__prior") > F.lit(width))).select(group, at, "__start")
    known = cut(known, "times")
    starts = known.filter("__start").select(group, F.col(at).alias("__to"))
    found = cut(known.filter("__start").select(group, at), "anchors")
    hop = next_beyond(known, group, at, width, "__to").filter("__to is not null").join(starts, [group, "__to"], "left_anti")
    hop = cut(hop.select(group, at, "__to"), "hops")
    while not hop.isEmpty():
        reached = found.join(hop, [group, at]).select(group, F.col("__to").alias(at))
        found = cut(found.unionByName(reached), "anchors")
        on = hop.select(group, F.col(at).alias("__to"), F.col("__to").alias("__on"))
        hop = cut(hop.join(on, [group, "__to"]).select(group, at, F.col("__on").alias("__to")), "hops")
    flagged = known.select(group, at).join(found.withColumn("__hit", F.lit(True)), [group, at], "left")
    seen = before(flagged, [group], [F.col(at)], "__last", last=F.when(F.col("__hit"), F.col(at)))
    return seen.select(group, at, F.when(F.col("__hit"), F.col(at)).otherwise(F.col("__last")).alias("anchor"))


def nearest(df: DataFrame, key: str, group: str, at: str, width, cap: int, carry: list[str] = (), ask: str | None = None) -> DataFrame:
    """key, near, dt, rank and near_<c> of the carried columns: for each row the `cap` other rows of its group
    nearest in time, none further than width; of equally near ones the smaller keys. No other pairs are built. ask: a
    boolean column of the rows that get neighbours; all are neighbours.

    No row needs more than the first cap + 1 keys of one time. Those candidates are numbered along the time,
    forwards and backwards, and stand in blocks of twice cap that overlap by half, so that the cap candidates before
    or after any time lie in one block: each row meets two blocks and the candidates of its own time."""
    rows = df.filter(F.col(group).isNotNull() & F.col(at).isNotNull()).select(F.col(group).alias("g"), F.col(at).alias("t"), F.col(key).alias("k"), (F.col(ask) if ask else F.lit(True)).alias("ask"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    item = F.struct("t", "k", *[f"c{i}" for i in range(len(carry))])
    rank = F.row_number().over(Window.partitionBy("g", "t").orderBy("k"))
    held = cut(rows.withColumn("r", rank - 1).filter(F.col("r") <= cap), "candidates")
    ties = cut(held.groupBy("g", "t").agg(F.count("*").alias("m"), F.sort_array(F.collect_list(item)).alias("own")), "ties")
    out = ties
    sides = []
    for side, order in (("after", F.col("t").asc()), ("ahead", F.col("t").desc())):
        sums = cut(before(ties.select("g", "t", "m"), ["g"], [order], "base", total=F.col("m")), "bases")
        placed = held.join(sums.select("g", "t", "base"), ["g", "t"]).withColumn("p", F.col("base") + F.col("r"))
        block = F.expr(f"cast(p div {cap} as bigint)")
        placed = placed.select("g", F.explode(F.array(block - 1, block)).alias("block"), F.struct("p", item.alias("x")).alias("x")).filter("block >= 0")
        blocks = cut(placed.groupBy("g", "block").agg(F.sort_array(F.collect_list("x")).alias(side)), "blocks")
        # The first candidate on this side comes after all of the row's own time.
        first = (F.col("base") + F.col("m")).alias(f"{side}_from")
        out = out.join(sums.select("g", "t", first, F.expr(f"cast((base + m) div {cap} as bigint)").alias(f"{side}_block")), ["g", "t"])
        sides.append((side, blocks))
    out = cut(out, "ties")
    for side, blocks in sides:
        out = out.join(blocks.withColumnRenamed("block", f"{side}_block"), ["g", f"{side}_block"], "left")
        first = F.col(f"{side}_from")
        near = F.transform(F.slice(F.filter(side, lambda x: x["p"] >= first), 1, cap), lambda x: x["x"])  # noqa: B023
        out = out.withColumn(side, F.coalesce(near, F.slice("own", 1, 0)))
    out = cut(out.select("g", "t", "own", F.concat("ahead", "after").alias("others")), "neighbours")
    every = rows.filter("ask").join(out, ["g", "t"])
    far = lambda x: F.abs(x["t"] - F.col("t"))
    fits = F.filter(F.concat(F.filter("own", lambda x: x["k"] != F.col("k")), "others"), lambda x: far(x) <= F.lit(width))
    best = F.slice(F.sort_array(F.transform(fits, lambda x: F.struct(far(x).alias("dt"), x["k"].alias("k"), x.alias("x")))), 1, cap)
    found = every.withColumn("best", best).select(F.col("k").alias(key), F.posexplode("best").alias("i", "n"))
    more = [F.col(f"n.x.c{i}").alias(f"near_{c}") for i, c in enumerate(carry)]
    return found.select(key, F.col("n.k").alias("near"), F.col("n.dt").alias("dt"), (F.col("i") + 1).alias("rank"), *more)
