"""The trie of conversation prefixes, by Patricia construction.

Turns are sorted into their conversations by one range exchange. A prefix is named by two 64-bit exclusive-or sums
of hashes of (place, turn), so it can be followed along a conversation of any length in blocks. Prefixes that
lie on one unary chain have the same members, hence the same smallest member and number of members: grouping by
these two gives the points of the compressed tree (branches, ends and leaves), each with the edge above it. What
lies below a point is summed over the compressed paths, and unary nodes get their values back from their
edge's point by a suffix sum of the edge.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, ship

#: Turns of one conversation that are scanned together; longer conversations are scanned in blocks.
BLOCK = 4096
#: Bytes of a text of joined ids that travels as one row.
CHUNK = 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()


def number_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, at (1, 2, ... in each conversation), k1, k2 (the hashes of role and text), bytes (of the text in UTF-8).

    Turns go by number, null first; those of one number by role, then text. Null roles and texts are empty.
    Rows without a conversation are left out. The texts themselves travel only where two turns of a
    conversation have one number.
    """
    r, t = F.coalesce(F.col(f"`{role}`"), F.lit("")), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    turns = df.filter(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("bigint").alias("conv"),
        F.col(f"`{turn}`").alias("turn"),
        F.xxhash64(r, t).alias("k1"),
        F.xxhash64(F.lit("second"), t, r).alias("k2"),
        F.octet_length(t).cast("bigint").alias("bytes"),
        r.alias("role"),
        t.alias("text"),
    )
    twice = cut(turns.groupBy("conv", "turn").count().filter("count > 1").select(F.col("conv").alias("c"), F.col("turn").alias("n")), "trie-ties")
    if twice.isEmpty():
        turns = turns.withColumn("tie", F.lit(None).cast("string"))
    else:
        hit = (F.col("conv") == F.col("c")) & F.col("turn").eqNullSafe(F.col("n"))
        turns = turns.join(twice, hit, "left").withColumn("tie", F.when(F.col("c").isNotNull(), F.col("text"))).drop("c", "n")
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("tie"), F.col("k1"), F.col("k2")]
    ranged = turns.drop("text").repartitionByRange(*order).sortWithinPartitions(*order)
    # The identifier's upper bits are the partition, its lower ones the place there.
    ranged = cut(ranged.select("conv", "k1", "k2", "bytes", F.monotonically_increasing_id().alias("id")), "trie-sorted")
    discard(twice)
    ranged = ranged.withColumn("part", F.shiftright("id", 33))
    # A conversation that began in an earlier partition goes on from its rows there: one at most for each partition.
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    later = ranged.groupBy("conv", "part").agg(F.count("*").alias("n")).withColumn("before", before).filter("before is not null")
    place = F.row_number().over(Window.partitionBy("conv", "part").orderBy("id"))
    numbered = ranged.withColumn("place", place).join(F.broadcast(later.select("conv", "part", "before")), ["conv", "part"], "left")
    return cut(numbered.select("conv", (F.col("place") + F.coalesce("before", F.lit(0))).cast("bigint").alias("at"), "k1", "k2", "bytes"), "trie-turns")


def lengths(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv").agg(F.max("at").alias("n"))


def share_heads(turns: DataFrame, family: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Conversations and turns after each conversation c has changed its first h turns for those of
    conversation c - c % family, where h is the crc32 of c in decimal, modulo most + 1. The other may be shorter
    or missing; what is left of c after its first h turns follows, if anything."""
    c = F.col("conv")
    heads = turns.filter(F.col("at") <= most).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("at", "k1", "k2", "bytes"))).alias("head"))
    heads = heads.select(F.col("conv").alias("base"), "head")
    convs = lengths(turns).withColumns({"base": c - c % family, "h": F.pmod(F.crc32(c.cast("string")), F.lit(most + 1)).cast("int")})
    convs = convs.join(heads, "base", "left")
    taken = F.slice("head", F.lit(1), F.col("h"))
    convs = convs.withColumn("head", F.coalesce(taken, F.slice(F.array(F.struct(*[F.lit(0).cast("bigint").alias(x) for x in ("at", "k1", "k2", "bytes")])), 1, 0)))
    convs = cut(convs.select("conv", "h", "head", (F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("bigint").alias("n")), "trie-convs")
    first = convs.select("conv", F.explode("head").alias("x")).select("conv", "x.at", "x.k1", "x.k2", "x.bytes")
    shift = convs.select("conv", "h", (F.size("head") - F.col("h")).alias("shift"))
    own = turns.join(shift, "conv").filter("at > h").select("conv", (F.col("at") + F.col("shift")).alias("at"), "k1", "k2", "bytes")
    return convs.select("conv", "n"), first.unionByName(own)


def _along(rows: DataFrame) -> DataFrame:
    """Adds the hashes h1, h2 of each prefix and its bytes: exclusive-or and plain sums along each
    conversation, within blocks, and from block to block where a conversation has several."""
    e = {"e1": F.xxhash64("at", "k1", "k2"), "e2": F.xxhash64(F.lit("prefix"), "k2", "at", "k1"), "block": F.expr(f"(at - 1) div {BLOCK}")}
    rows = rows.withColumns(e)
    w = Window.partitionBy("conv", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({"h1": F.bit_xor("e1").over(w), "h2": F.bit_xor("e2").over(w), "upto": F.sum("bytes").over(w)})
    out = cut(out.select("conv", "at", "block", "e1", "e2", "bytes", "h1", "h2", "upto"), "trie-rows")
    if out.filter("block > 0").isEmpty():
        return out
    long = out.filter("block > 0").select("conv").distinct()
    ends = out.join(long, "conv", "left_semi").groupBy("conv", "block").agg(F.bit_xor("e1").alias("b1"), F.bit_xor("e2").alias("b2"), F.sum("bytes").alias("b3"))
    w = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("conv", "block", F.bit_xor("b1").over(w).alias("b1"), F.bit_xor("b2").over(w).alias("b2"), F.sum("b3").over(w).alias("b3"))
    add = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    joined = out.join(cut(ends, "trie-blocks"), ["conv", "block"], "left")
    joined = joined.withColumns({"h1": F.col("h1").bitwiseXOR(add("b1")), "h2": F.col("h2").bitwiseXOR(add("b2")), "upto": F.col("upto") + add("b3")})
    return cut(joined.select("conv", "at", "e1", "e2", "bytes", "h1", "h2", "upto"), "trie-rows")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h1, h2, conv), sorted: the ids of each run joined by commas, in texts of about CHUNK bytes."""
    key, first, ids, size, out = None, 0, [], 0, []

    def flush():
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["h1", "h2", "first", "ids"])

    for b in batches:
        for h1, h2, c in zip(*[x.to_pylist() for x in b.columns]):
            if ids and (key != (h1, h2) or size > CHUNK):
                out.append((*key, first, ",".join(ids)))
                ids, size = [], 0
            if not ids:
                key, first = (h1, h2), c
            ids.append(str(c))
            size += len(ids[-1]) + 1
        if len(out) > 1000:
            yield flush()
            out = []
    if ids:
        out.append((*key, first, ",".join(ids)))
    yield flush()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (h1, h2, first): SHA-256 of the pieces of each run, joined by commas. Only the digest's
    state is held."""
    key, state, out = None, None, []

    def flush():
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["h1", "h2", "sha"])

    for b in batches:
        for h1, h2, ids in zip(*[b.column(i).to_pylist() for i in (0, 1, 3)]):
            if key != (h1, h2):
                if state:
                    out.append((*key, state.hexdigest()))
                key, state = (h1, h2), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if len(out) > 10_000:
            yield flush()
            out = []
    if state:
        out.append((*key, state.hexdigest()))
    yield flush()


def end_digests(ends: DataFrame) -> DataFrame:
    """h1, h2, sha: for each prefix the digest of the conversations (h1, h2, conv) that end there, ascending. A
    digest can't be made in parts, so a prefix's ids are sorted and joined by many tasks and only digested by one."""
    ship(ends.sparkSession)
    by = ["h1", "h2", "conv"]
    pieces = ends.select(*by).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_pieces, "h1 bigint, h2 bigint, first bigint, ids string")
    return pieces.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "first").mapInArrow(_digests, "h1 bigint, h2 bigint, sha string")


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per node of the trie of conversations (conv, n turns) and their turns (conv, at from 1, k1, k2, bytes):
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    The root holds all conversations, also those without turns, and has no parent; it has no text, so it saves
    nothing itself. A conversation that occurs several times in another's wording is a member of the same
    nodes. No conversations give no rows.
    """
    convs = cut(convs, "trie-members")
    root = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n"), F.count_if(F.col("n") == 0).alias("ends")).first()
    schema = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
    if not root["n"]:
        return convs.sparkSession.createDataFrame([], schema)
    rows = _along(turns)
    nodes = rows.groupBy("h1", "h2").agg(
        F.min("conv").alias("conv"),
        F.count("*").alias("n"),
        F.first("at").alias("depth"),
        F.first("bytes").alias("bytes"),
        F.first("upto").alias("upto"),
        F.first(F.col("h1").bitwiseXOR(F.col("e1"))).alias("p1"),
        F.first(F.col("h2").bitwiseXOR(F.col("e2"))).alias("p2"),
    )
    nodes = cut(nodes, "trie-nodes")
    # Points with their edges: the deepest node of those with one smallest member and one number of members.
    points = nodes.groupBy("conv", "n").agg(
        F.max("depth").alias("depth"),
        F.min("depth").alias("top"),
        F.max_by(F.struct("h1", "h2", "upto"), "depth").alias("x"),
        F.min_by(F.struct("p1", "p2", (F.col("upto") - F.col("bytes")).alias("above")), "depth").alias("y"),
    )
    points = cut(points.select("conv", "n", "depth", "top", "x.*", "y.*").withColumn("edge", (F.col("n") - 1) * (F.col("upto") - F.col("above"))), "trie-points")
    kids = points.groupBy(F.col("p1").alias("h1"), F.col("p2").alias("h2")).agg(F.count("*").alias("kids"))
    kids = cut(kids, "trie-kids")
    # Each smallest member passes what lies on its own edges to every point above: a window over the points of
    # one path, of which a tree of r turns has at most about the square root of 2 r, then one aggregate.
    owners = points.select("conv").distinct()
    own = points.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("conv").alias("owner"), F.col("depth").alias("point"), "edge")
    path = rows.select("conv", "h1", "h2").join(own, (F.col("h1") == F.col("o1")) & (F.col("h2") == F.col("o2"))).join(cut(owners, "trie-owners"), "conv", "left_semi")
    mine = F.col("owner") == F.col("conv")
    lower = Window.partitionBy("conv").orderBy(F.col("point").desc()).rowsBetween(Window.unboundedPreceding, -1)
    leaf = F.col("kids").isNull()
    path = path.join(kids.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), "kids"), ["o1", "o2"], "left")
    path = path.withColumns(
        {
            "below": F.coalesce(F.sum(F.when(mine, F.col("edge"))).over(lower), F.lit(0)),
            "leaves": F.coalesce(F.sum(F.when(mine & leaf, F.lit(1))).over(lower), F.lit(0)),
        }
    )
    sums = path.groupBy("h1", "h2").agg(F.sum("below").alias("below"), F.sum("leaves").alias("leaves"))
    # The ends of each point: conversations whose last turn it is.
    last = rows.select("conv", "at", "h1", "h2").join(convs, "conv").filter("at = n").select("h1", "h2", "conv")
    none = convs.filter("n = 0").select(F.lit(0).cast("bigint").alias("h1"), F.lit(0).cast("bigint").alias("h2"), "conv")
    ends = cut(end_digests(last.unionByName(none)), "trie-ends")
    done = points.join(sums, ["h1", "h2"], "left").join(kids, ["h1", "h2"], "left").join(ends, ["h1", "h2"], "left")
    parents = points.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("conv").alias("parent"))
    done = cut(
        done.select(
            "conv", "n", "p1", "p2", "edge", "upto", "top", "depth",
            F.coalesce("below", F.lit(0)).alias("below"),
            F.when(F.col("kids").isNull(), F.lit(1)).otherwise(F.col("leaves")).alias("leaves"),
            F.coalesce("kids", F.lit(0)).alias("kids"),
            F.coalesce("sha", F.lit(NO_ENDS)).alias("sha"),
        ),
        "trie-sums",
    )
    under_root = (F.col("p1") == 0) & (F.col("p2") == 0)
    low = done.filter(~under_root).join(parents, ["p1", "p2"]).unionByName(done.filter(under_root).withColumn("parent", F.lit(root["conv"])))
    low = cut(low.drop("p1", "p2"), "trie-edges")
    # Unary nodes: the values of their edge's point, and the bytes from here down to it.
    point = low.select("conv", "n", "parent", "top", "below", "leaves", "kids", "sha", F.col("depth").alias("bottom"), F.col("upto").alias("end"))
    all_nodes = nodes.select("conv", "n", "depth", (F.col("upto") - F.col("bytes")).alias("before")).join(point, ["conv", "n"])
    at_point = F.col("depth") == F.col("bottom")
    out = all_nodes.select(
        F.col("conv").alias("conv_id"),
        F.col("depth").cast("bigint").alias("depth"),
        F.when(F.col("depth") == F.col("top"), F.col("parent")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(at_point, F.col("kids")).otherwise(F.lit(1)).cast("bigint").alias("n_children"),
        F.col("leaves").cast("bigint").alias("n_leaves"),
        (F.col("below") + (F.col("n") - 1) * (F.col("end") - F.col("before"))).alias("saved_tokens"),
        F.when(at_point, F.col("sha")).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    return out.unionByName(_root_row(low, kids, ends, root, schema))


def _root_row(low: DataFrame, kids: DataFrame, ends: DataFrame, root, schema: str) -> DataFrame:
    at_root = "h1 = 0 and h2 = 0"
    below = low.agg(F.sum("edge").alias("saved"), F.count_if(F.col("kids") == 0).alias("leaves")).first()
    k = kids.filter(at_root).first()
    sha = ends.filter(at_root).first()
    row = (root["conv"], 0, None, root["n"], k["kids"] if k else 0, below["leaves"] or 1, below["saved"] or 0, sha["sha"] if sha else NO_ENDS)
    return low.sparkSession.createDataFrame([row], schema)


def conversation_trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of the conversations as they are; see `number_turns` for their order and `prefix_trie` for the
    rows. Other columns are left out."""
    turns = number_turns(df, conv, turn, role, text)
    return prefix_trie(lengths(turns), turns)


def shared_heads_trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of the conversations with the heads that `share_heads` gives them."""
    return prefix_trie(*share_heads(number_turns(df, conv, turn, role, text)))
