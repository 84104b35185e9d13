"""Near-duplicate detection: SuperMinHash signatures, banding, verification, union-find.

SuperMinHash gives each shingle a random permutation of the signature's slots; slot k holds the smallest
rank + fraction that any shingle brings to it. Ranks of one shingle are all different, which lowers the
variance below MinHash's, and a text stops at the first rank beyond every slot's value. Here the
permutations are affine maps modulo a prime number of slots, a doubly transitive family: ranks of two
slots are distributed as under uniform permutations, so the estimate and its variance are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, partitions, ship
from .components import components
from .wordhash import U64, mix, plain, shingle_sets, text_chunks, words_of

#: Slots of a signature: a prime of at least BANDS * ROWS. A pair with similarity 0.8 meets in no band
#: with probability (1 - 0.8**6)**47 = 6e-7.
SLOTS, BANDS, ROWS = 283, 47, 6
SHINGLE, PERCENT = 5, 80
#: Members of a bucket, or of each of two blocks of one, that are compared in one group.
BLOCK = 2_000
#: Ids that are broadcast to pick texts, at most: 8 bytes each.
BROADCAST_IDS = 4_000_000
#: By so much may an estimate fall short of the similarity and the pair still be compared on whole sets: 5.5
#: standard deviations, so that this passes over a pair at the threshold with probability 2e-8 or less,
#: far below what banding does.
HOPE = 0.13
#: Stands for no id while documents are compared, after all ids.
NO_ID = (1 << 63) - 1
_TOP = U64((1 << 64) - 1)


def superminhash(h: np.ndarray, bounds: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures of sets of 64-bit hashes; set d is h[bounds[d]:bounds[d+1]]. A slot's value is
    rank * 2**32 + fraction; sets without members keep the largest value in each slot."""
    n = len(bounds) - 1
    sig = np.full(n * slots, _TOP, dtype=np.uint64)
    size = np.diff(bounds)
    doc = np.repeat(np.arange(n), size)
    offset = (mix(h ^ U64(0x51ED270B)) % U64(slots)).astype(np.int64)
    stride = (mix(h ^ U64(0x7F4A7C15)) % U64(slots - 1)).astype(np.int64) + 1
    at = offset
    live = np.flatnonzero(size > 0)
    base = doc * slots
    for rank in range(slots):
        if not len(live):
            break
        r = (mix(h + U64(rank * 0x9E3779B97F4A7C15 % (1 << 64))) >> U64(32)) | U64(rank << 32)
        np.minimum.at(sig, base + at, r)
        full = sig.reshape(n, slots)[live].max(axis=1) < U64((rank + 1) << 32)
        if full.any():
            live = live[~full]
            keep = np.zeros(n, dtype=bool)
            keep[live] = True
            keep = keep[doc]
            h, doc, at, stride, base = h[keep], doc[keep], at[keep], stride[keep], base[keep]
        at = at + stride
        at[at >= slots] -= slots
    return sig.reshape(n, slots)


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key per set and band, mixed from the band's number and its slots' ranks and fractions."""
    x = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), bands))
    parts = sig[:, : bands * rows].reshape(len(sig), bands, rows)
    for r in range(rows):
        x = mix(x * U64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return x


def _signer(shingle: int, bands: int, rows: int, slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = plain(batch.column(1))
            for a, b in text_chunks(text):
                h, first = shingle_sets(words_of(text.slice(a, b - a), lower=True), shingle)
                n = b - a
                size = np.diff(first)
                doc = np.repeat(np.arange(n), size)
                keys = []
                for salt in (0xA5A5A5A5, 0x3C6EF372FE94F82B):  # two sums name a set whatever its order
                    s = np.zeros(n, dtype=np.uint64)
                    np.add.at(s, doc, mix(h ^ U64(salt)))
                    keys.append(s.view(np.int64))
                sig = band_keys(superminhash(h, first, slots), bands, rows).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(sig.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, n), batch.column(2).slice(a, n), pa.array(size.astype(np.int64)), pa.array(keys[0]), pa.array(keys[1]), lists],
                    names=["id", "th", "n", "k1", "k2", "bands"],
                )

    return run


def _verifier(shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = plain(batch.column(2)), plain(batch.column(3))
            ids = [batch.column(0), batch.column(1)]
            for a, b in text_chunks(x):
                hx, fx = shingle_sets(words_of(x.slice(a, b - a), lower=True), shingle)
                ok = []
                for c, d in text_chunks(y.slice(a, b - a)):  # y's texts may be much longer than x's
                    hy, fy = shingle_sets(words_of(y.slice(a + c, d - c), lower=True), shingle)
                    part, f = hx[fx[c] : fx[d]], fx[c : d + 1] - fx[c]
                    h = np.concatenate([part, hy])
                    doc = np.concatenate([np.repeat(np.arange(d - c), np.diff(f)), np.repeat(np.arange(d - c), np.diff(fy))])
                    order = np.lexsort((h, doc))
                    h, doc = h[order], doc[order]
                    both = np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=d - c)
                    either = np.diff(f) + np.diff(fy) - both
                    ok.append((either > 0) & (100 * both >= percent * either))
                hit = np.flatnonzero(np.concatenate(ok)) + a
                if len(hit):
                    take = pa.array(hit)
                    yield pa.RecordBatch.from_arrays([ids[0].take(take), ids[1].take(take)], names=["u", "v"])

    return run


def _of_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of some ids. Ids are counted: up to BROADCAST_IDS of them go to every task, so texts that
    aren't asked for don't move; more are joined by shuffle."""
    ids = cut(ids, "near-ids")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")


def verified(edges: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The edges (u, v) whose full shingle sets are similar enough. Texts come by two joins and stream
    through the check pair by pair; a node with many edges is a skewed join, which Spark splits."""
    ends = edges.select(F.col("u").alias("id")).union(edges.select(F.col("v").alias("id"))).distinct()
    texts = _of_ids(texts, ends).groupBy("id").agg(F.first("text").alias("text"))  # of repeated rows one; their texts are equal
    pairs = edges.join(texts.select(F.col("id").alias("v"), F.col("text").alias("y")), "v")
    pairs = pairs.join(texts.select(F.col("id").alias("u"), F.col("text").alias("x")), "u")
    return pairs.select("u", "v", "x", "y").mapInArrow(_verifier(shingle, percent), "u bigint, v bigint")


def _fits(a: str, b: str, percent: int):
    """Sizes that allow the similarity."""
    return 100 * F.least(F.col(a), F.col(b)) >= percent * F.greatest(F.col(a), F.col(b))


def _set_rows(shingle: int, bands: int, rows: int, slots: int):
    """id, keys of all bands, one byte per slot with the keys folded to 32 bits behind them, and the shingle
    set folded to 32 bits, from (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = plain(batch.column(1))
            for a, b in text_chunks(text):
                h, first = shingle_sets(words_of(text.slice(a, b - a), lower=True), shingle)
                sig = superminhash(h, first, slots)
                keys = band_keys(sig, bands, rows).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1)))
                tags = keys.astype(np.uint32)
                short = pa.array([x.tobytes() + t.tobytes() for x, t in zip((mix(sig) >> U64(56)).astype(np.uint8), tags)], pa.binary())
                sets = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array((h >> U64(32)).astype(np.uint32).view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists, short, sets], names=["id", "bands", "short", "set"])

    return run


def _links_inside(group: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links between members of different components of one bucket, or of two blocks of one: rows of (key,
    pair, block, id, comp, n, bands, set). Every pair that meets first in this bucket is compared on its
    whole sets, unless its components have met already; one link is kept where two components meet."""
    ids = [g[3] for g in group]
    comp = np.array([g[4] for g in group])
    names, comp = np.unique(comp, return_inverse=True)
    n = np.array([g[5] for g in group])
    block = np.array([g[2] for g in group])
    keys = np.stack([g[6] for g in group])
    band = int(np.flatnonzero(keys[0] == group[0][0])[0])
    flat = np.concatenate([g[7] for g in group])
    starts = np.cumsum([0] + [len(g[7]) for g in group])[:-1]
    _, dense = np.unique(flat, return_inverse=True)
    mark = np.zeros(int(dense.max()) + 1, dtype=np.int32)
    ends = np.append(starts[1:], len(flat))
    parent = list(range(len(names)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    usual = int(np.bincount(comp).argmax())
    cross = len(set(block.tolist())) > 1
    roots = comp.copy()
    out = []
    done = np.zeros(len(group), dtype=bool)
    for i in np.flatnonzero(comp != usual):
        done[i] = True
        ok = (roots != roots[i]) & ~done & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
        if cross:
            ok &= block != block[i]
        at = np.flatnonzero(ok)
        if band and len(at):
            at = at[~(keys[at, :band] == keys[i, :band]).any(axis=1)]
        if not len(at):
            continue
        own = dense[starts[i] : ends[i]]
        mark[own] = 1
        both = np.add.reduceat(mark[dense], starts)[at]
        mark[own] = 0
        hit = at[100 * both >= percent * (n[i] + n[at] - both)]
        for j in hit:
            a, b = root(int(roots[i])), root(int(roots[j]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        if len(hit):
            roots = np.array([root(x) for x in range(len(names))])[comp]
    return out


def _groups(batches: Iterator[pa.RecordBatch], columns: int, more) -> Iterator[list[tuple]]:
    """Runs of rows with equal (key, pair): their first columns and what more(batch) gives for each row."""
    group: list[tuple] = []
    for batch in batches:
        firsts = zip(*(batch.column(i).to_pylist() for i in range(columns)))
        for row, rest in zip(firsts, more(batch)):
            if group and group[0][:2] != row[:2]:
                yield group
                group = []
            group.append((*row, *rest))
    if group:
        yield group


def _hopeful(percent: int, slots: int, bands: int):
    """key, pair, id of members that meet one of another component first in this bucket and whose signature
    is near enough to its: within HOPE of the similarity, so that a pair that has it is lost with
    probability 2e-8."""
    least = max(1, int((percent / 100 - HOPE) * slots))

    def found(group: list[tuple]) -> list[tuple]:
        comp = np.array([g[4] for g in group])
        _, comp = np.unique(comp, return_inverse=True)
        n, block = np.array([g[5] for g in group]), np.array([g[2] for g in group])
        raw = np.frombuffer(b"".join(g[6] for g in group), dtype=np.uint8).reshape(len(group), slots + 4 * bands)
        short, tags = raw[:, :slots], np.ascontiguousarray(raw[:, slots:]).view("<u4")
        band = int(np.flatnonzero(tags[0] == group[0][0] & 0xFFFFFFFF)[0])
        cross = block.min() != block.max()
        hope = np.zeros(len(group), dtype=bool)
        for i in np.flatnonzero(comp != np.bincount(comp).argmax()):
            ok = (comp != comp[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
            if cross:
                ok &= block != block[i]
            at = np.flatnonzero(ok)
            if band and len(at):
                at = at[~(tags[at, :band] == tags[i, :band]).any(axis=1)]
            if len(at):
                at = at[(short[at] == short[i]).sum(axis=1) >= least]
                if len(at):
                    hope[i] = True
                    hope[at] = True
        return [group[i][:2] + (group[i][3],) for i in np.flatnonzero(hope)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group in _groups(batches, 7, lambda b: [()] * b.num_rows):
            out += found(group)
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["key", "pair", "id"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["key", "pair", "id"])

    return run


def _bucket_links(percent: int):
    def arrays(batch: pa.RecordBatch) -> list[tuple]:
        bands, sets = batch.column(6), batch.column(7)
        keys, flat = bands.values.to_numpy(), sets.values.to_numpy().view(np.uint32)
        at, ends = bands.offsets.to_numpy(), sets.offsets.to_numpy()
        return [(keys[at[i] : at[i + 1]].copy(), flat[ends[i] : ends[i + 1]].copy()) for i in range(batch.num_rows)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for group in _groups(batches, 6, arrays):
            out += _links_inside(group, percent)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["u", "v"])

    return run


def open_links(shared: DataFrame, comp: DataFrame, docs: DataFrame, shingle: int, percent: int, bands: int, rows: int, slots: int) -> DataFrame:
    """Links across the components that buckets still hold, from (key, id, n) and (node, component). A
    bucket is compared inside one task; one of more than BLOCK members is dealt as pairs of blocks. Short
    signatures go first and say which members need their whole sets. No pair leaves the task unless it is a
    link that joins two components."""
    left = shared.join(comp.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("comp"))
    mixed = left.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("m")).filter("a != b")
    mixed = cut(mixed.select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "near-mixed")
    left = cut(left.join(mixed, "key"), "near-open")
    ids = left.select("id").distinct()
    made = _of_ids(docs, ids).dropDuplicates(["id"])  # of repeated rows one; their texts are equal
    sets = cut(made.mapInArrow(_set_rows(shingle, bands, rows, slots), "id bigint, bands array<bigint>, short binary, set array<int>"), "near-sets")
    left = left.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    pairs = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(o, F.col("block")) * F.col("blocks") + F.greatest(o, F.col("block")))
    )
    left = left.withColumn("pair", F.explode(pairs.cast("array<bigint>"))).select("key", "pair", "block", "id", "comp", "n")
    n = partitions(docs.sparkSession)
    light = left.join(sets.select("id", "short"), "id").select("key", "pair", "block", "id", "comp", "n", "short")
    light = light.repartition(n, "key", "pair").sortWithinPartitions("key", "pair", "id")
    hopeful = cut(light.mapInArrow(_hopeful(percent, slots, bands), "key bigint, pair bigint, id bigint"), "near-hopeful")
    full = left.join(hopeful, ["key", "pair", "id"], "left_semi").join(sets.drop("short"), "id").select("key", "pair", "block", "id", "comp", "n", "bands", "set")
    full = full.repartition(n, "key", "pair").sortWithinPartitions("key", "pair", "id")
    return full.mapInArrow(_bucket_links(percent), "u bigint, v bigint")


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
    slots: int = SLOTS,
) -> DataFrame:
    """One row per row of df: id, n_shingles, component_id, kept, text_hash, group.

    Words are A-Z lower-cased; documents link when 100 * intersection >= percent * union of their shingle
    sets. Ids are integers. component_id is the smallest id reachable over links, kept marks it. Documents
    without words (null, empty or blank texts) link with nothing. Equal sets form one class first and are
    compared through its smallest id. Rows without an id are documents told apart by their texts, and come after
    all others: their component_id is null where none of its component has an id, and then kept marks the text with
    the smallest hash. Repeated rows are repeated; rows of one id with different texts are documents of
    their own, told apart by text_hash, and group is one number per component even where two components
    have one smallest id. An empty table gives no rows.

    In a band's bucket every class is compared with the one of smallest id. Once components are known,
    buckets that still hold several are compared across them, inside a task; classes in one component need
    no further comparison. Aggregates are written before they are joined, as Spark splits a hot key of a
    join only between scans.
    """
    ship(df.sparkSession)
    text = F.col(f"`{text_col}`")
    docs = df.select(F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(NO_ID)).alias("id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"))
    schema = "id bigint, th bigint, n bigint, k1 bigint, k2 bigint, bands array<bigint>"
    signed = cut(docs.select("id", "text", "th").mapInArrow(_signer(shingle, bands, rows, slots), schema), "near-signed")
    again = signed.groupBy("id").agg(F.min("th").alias("a"), F.max("th").alias("b"), F.count("*").alias("n")).filter(f"n > 1 or id = {NO_ID}")
    again = cut(again.select("id", (F.expr(f"a != b or id = {NO_ID}")).alias("many"), (F.col("n") > 1).alias("repeated")), "near-several")
    several = again.filter("many").select("id", "many")
    one_text, repeated = several.isEmpty(), not again.filter("repeated").isEmpty()

    def noded(rows: DataFrame) -> DataFrame:
        """Adds node: the id, or a hash where rows of one id, or of none, have different texts."""
        if one_text:
            return rows.withColumn("node", F.col("id"))
        return rows.join(several, "id", "left").withColumn("node", F.when(F.col("many"), F.xxhash64("id", "th")).otherwise(F.col("id"))).drop("many")

    texts = noded(docs).select(F.col("node").alias("id"), "text")
    named = noded(signed)
    classes = named.filter("n > 0").groupBy("k1", "k2").agg(F.min(F.struct("id", "node")).alias("r"))
    classes = cut(classes.select("k1", "k2", F.col("r.id").alias("least"), F.col("r.node").alias("rep")), "near-classes")
    reps = named.select(F.col("node").alias("id"), "n", "bands").join(classes.select(F.col("rep").alias("id")), "id", "left_semi")
    if repeated:  # rows alike are one member of a bucket
        reps = reps.groupBy("id").agg(F.first("n").alias("n"), F.first("bands").alias("bands"))
    buckets = reps.select("id", "n", F.explode("bands").alias("key"))
    centres = buckets.groupBy("key").agg(F.min(F.struct("id", "n")).alias("c"), F.count("*").alias("m")).filter("m > 1")
    centres = cut(centres.select("key", F.col("c.id").alias("c"), F.col("c.n").alias("cn")), "near-centres")
    shared = cut(buckets.join(centres, "key"), "near-buckets")
    edges = shared.filter("c != id").filter(_fits("n", "cn", percent)).select(F.col("c").alias("u"), F.col("id").alias("v"))
    edges = cut(edges.distinct(), "near-edges")
    links = cut(verified(edges, texts, shingle, percent), "near-links")
    discard(centres, edges)
    comp = cut(components(links), "near-components")
    more = cut(open_links(shared.select("key", "id", "n"), comp, texts, shingle, percent, bands, rows, slots).distinct(), "near-more")
    links = links.union(cut(verified(more, texts, shingle, percent), "near-links"))
    discard(shared, more)
    of_class = classes.join(components(links).withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", "least", F.coalesce("component", "rep").alias("group"))
    of_class = cut(of_class, "near-groups")
    if one_text:
        of_class = of_class.select("k1", "k2", "group", F.col("group").alias("component_id"))
    else:
        smallest = cut(of_class.groupBy("group").agg(F.min("least").alias("component_id")), "near-smallest")
        of_class = cut(of_class.join(smallest, "group").select("k1", "k2", "group", "component_id"), "near-groups")
    out = named.select("id", "th", "node", "n", "k1", "k2").join(of_class, ["k1", "k2"], "left")
    cid = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    group = F.when(F.col("n") > 0, F.col("group")).otherwise(F.col("node"))
    out = out.select("id", "th", "n", cid.alias("cid"), group.alias("group"))
    kept = F.col("cid") == F.col("id")
    if not one_text:
        nameless = cut(out.filter(f"cid = {NO_ID}").groupBy("group").agg(F.min("th").alias("least_text")), "near-nameless")
        out = out.join(nameless, "group", "left")
        kept = kept & F.coalesce(F.col("th") == F.col("least_text"), F.lit(True))
    named_id = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return out.select(named_id("id").alias(id_col), F.col("n").alias("n_shingles"), named_id("cid").alias("component_id"), kept.alias("kept"), F.col("th").alias("text_hash"), "group")
