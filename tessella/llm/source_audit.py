"""Audit of how sources of a language differ in their terms, by sorted streams.

Tasks count terms per document and add documents of one (language, term, source) up; the partial counts are
repartitioned and sorted by (language, term, source), and a run-length scan gives each source's counts. A
second sorted scan sees all sources of a term together: it gives the term's document frequency, and later, when
the totals are known, what the term adds to each pair of sources that both have it, and its divergence from the
language in each source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ship

#: What parts terms: ASCII characters that aren't letters.
GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS = 30
SMOOTH = 5
UNIT = 1_000_000_000
TOP = 50
#: Bytes of texts that are split at once, partial counts that a task holds, pairs of sources that it holds.
BYTES, HELD, PAIRS = 2 << 20, 150_000, 200_000
#: Shares of terms in sources that are compared at once.
CELLS = 1 << 20
#: (language, source) groups up to this many are sent to all tasks; more are joined by shuffle.
BROADCAST_GROUPS = 100_000

_COUNTS = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("docs", pa.int64()), ("count", pa.int64())])


def _count(texts: pa.Array, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """term, group, docs, count of a slice of texts: each text's terms are counted, then texts of a group added up."""
    # Lower case of a slice is only right for strings with 32-bit offsets.
    parts = pc.split_pattern_regex(pc.ascii_lower(texts.cast(pa.string())), pattern=GAP)
    doc = pc.list_parent_indices(parts).to_numpy()
    flat = pc.list_flatten(parts)
    full = pc.not_equal(flat, "")
    doc, codes = doc[full.to_numpy(zero_copy_only=False)], flat.filter(full).dictionary_encode()
    n = max(1, len(codes.dictionary))
    key, count = np.unique(doc.astype(np.int64) * n + codes.indices.to_numpy().astype(np.int64), return_counts=True)
    key = group[key // n] * n + key % n
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    docs = np.diff(np.r_[at, len(key)])
    total = np.add.reduceat(count, at) if len(at) else count
    return codes.dictionary.take(pa.array(key[at] % n)).cast(pa.string()), key[at] // n, docs, total


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, text -> lang, term, source, docs, count, added up over as many documents as HELD allows."""
    held: list[pa.Table] = []

    for b in batches:
        lang, source = (b.column(i).dictionary_encode() for i in (0, 1))
        n = max(1, len(source.dictionary))
        group = lang.indices.to_numpy().astype(np.int64) * n + source.indices.to_numpy()
        ends = np.cumsum(pc.binary_length(b.column(2)).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(group):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + BYTES, side="right")))
            terms, groups, docs, count = _count(b.column(2).slice(start, stop - start), group[start:stop])
            held.append(pa.table([lang.dictionary.take(pa.array(groups // n)), terms, source.dictionary.take(pa.array(groups % n)), pa.array(docs), pa.array(count)], schema=_COUNTS))
            start = stop
            if len(held) >= 16 or sum(map(len, held)) > HELD:
                held = [_added(pa.concat_tables(held))]
                if len(held[0]) > HELD // 2:
                    yield from held[0].to_batches(max_chunksize=20_000)
                    held = []
                pa.default_memory_pool().release_unused()
    if held:
        yield from _added(pa.concat_tables(held)).to_batches(max_chunksize=20_000)


def _added(t: pa.Table) -> pa.Table:
    """One row per (lang, term, source)."""
    t = t.group_by(["lang", "term", "source"], use_threads=False).aggregate([("docs", "sum"), ("count", "sum")])
    return t.rename_columns({"docs_sum": "docs", "count_sum": "count"}).select(_COUNTS.names).cast(_COUNTS)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by their first column, a key's hash, in tables that hold all rows of each hash they begin: a run
    that a batch leaves open is carried on. Keys of one hash are told apart by whoever adds the rows up."""
    left: list[pa.Table] = []
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        if left and left[-1].column(0)[-1] == b.column(0)[-1]:  # the whole batch may go on with the open run
            if b.column(0)[0] == b.column(0)[-1]:
                left.append(t)
                continue
        h = b.column(0).to_numpy()
        last = int(np.searchsorted(h, h[-1], side="left"))
        if last or left and left[-1].column(0)[-1].as_py() != h[0]:
            yield pa.concat_tables([*left, t.slice(0, last)]).combine_chunks()
            left = []
        left.append(t.slice(last))
    if left:
        yield pa.concat_tables(left).combine_chunks()


def _source_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted partial counts -> one row per (lang, term, source)."""
    for t in _runs(batches):
        h = t.column("h").to_numpy()
        at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        run = pa.array(np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(h)])))
        heads = t.take(pa.array(at))
        if all(pc.all(pc.equal(t.column(c), heads.column(c).take(run))).as_py() for c in ("lang", "term", "source")):
            sums = [pa.array(np.add.reduceat(t.column(c).to_numpy(), at)) for c in ("docs", "count")]
            out = pa.table([*[heads.column(c) for c in ("lang", "term", "source")], *sums], schema=_COUNTS)
        else:  # two keys have one hash
            out = _added(t.drop_columns(["h"]))
        yield from out.combine_chunks().to_batches(max_chunksize=20_000)


def _frequent(least: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of the terms in at least so many documents."""
        for t in _runs(batches):
            lang, term = (t.column(c).combine_chunks().dictionary_encode() for c in ("lang", "term"))
            lang, term = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (lang, term))
            key = lang.indices.to_numpy().astype(np.int64) * len(term.dictionary) + term.indices.to_numpy()
            _, key = np.unique(key, return_inverse=True)
            docs = np.zeros(key.max() + 1, dtype=np.int64)
            np.add.at(docs, key, t.column("docs").to_numpy())
            kept = t.select(_COUNTS.names).filter(pa.array(docs[key] >= least))
            yield from kept.combine_chunks().to_batches(max_chunksize=20_000)

    return scan


def _beyond(p: np.ndarray, p0: np.ndarray) -> np.ndarray:
    """For each pair of columns, sources, the sum over the rows, terms, of what they differ by beyond what they'd differ by if each
    lacked what the other has. p has p0 where a source lacks a term, which adds nothing."""
    out = np.zeros((len(p0), len(p0)), dtype=np.int64)
    for i in range(len(p0) - 1):
        x, y = p[:, i : i + 1], p[:, i + 1 :]
        out[i, i + 1 :] = (np.abs(x - y) - np.abs(x - p0[i + 1 :]) - np.abs(p0[i] - y) + np.abs(p0[i] - p0[i + 1 :])).sum(axis=0)
    return out


def _divergences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows h, lang, term, source, count, p, p0 (of a term that the source lacks), below (the language's
    divisor), sorted by h, the hash of (lang, term): rows `pair`, what the terms add for two sources that have them (`_beyond`),
    and rows `term`, where a source's p is above the language's. A task adds pairs up until it holds PAIRS of them."""
    pairs: dict[tuple[str, str, str], int] = {}
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def flush() -> pa.RecordBatch:
        rows = [(lang, a, "pair", b, v) for (lang, a, b), v in pairs.items()]
        pairs.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.field(i).type) for i in range(5)], schema=schema)

    def add(lang: str, names: list[str], found: np.ndarray) -> None:
        for i, j in zip(*np.nonzero(found)):
            k = (lang, *sorted((names[i], names[j]), key=str.encode))
            pairs[k] = pairs.get(k, 0) + int(found[i, j])

    for t in _runs(batches):
        for lang in pc.unique(t.column("lang")).to_pylist():
            part = t.filter(pc.equal(t.column("lang"), lang)).combine_chunks()
            term, source = (part.column(c).chunk(0).dictionary_encode() for c in ("term", "source"))
            tc, sc = term.indices.to_numpy(), source.indices.to_numpy()
            names, n = source.dictionary.to_pylist(), len(term.dictionary)
            count, p, p0 = (part.column(c).to_numpy() for c in ("count", "p", "p0"))
            below = int(part.column("below")[0].as_py())
            order = np.argsort(tc, kind="stable")
            at = np.searchsorted(tc[order], np.arange(n))
            totals = np.add.reduceat(count[order], at)
            # Whole numbers of any size: a term's count times UNIT may need more than 64 bits.
            q = np.array([1 + UNIT * (int(x) + SMOOTH) // below for x in totals.tolist()], dtype=np.int64)
            over = np.flatnonzero(p > q[tc])
            if len(over):
                take = pa.array(over)
                columns = [pa.array([lang] * len(over)), part.column("source").take(take).combine_chunks(), pa.array(["term"] * len(over)), part.column("term").take(take).combine_chunks(), pa.array(p[over] - q[tc[over]])]
                yield pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], schema=schema)
            lacked = np.zeros(len(names), dtype=np.int64)
            lacked[sc] = p0
            if 4 * len(p) >= n * len(names):  # most sources have most terms
                step = max(1, CELLS // len(names))
                for first in range(0, n, step):
                    inside = (tc >= first) & (tc < first + step)
                    table = np.repeat(lacked[None], min(step, n - first), axis=0)
                    table[tc[inside] - first, sc[inside]] = p[inside]
                    add(lang, names, _beyond(table, lacked))
            else:
                for a, b in zip(at.tolist(), [*at[1:].tolist(), len(tc)]):
                    rows = order[a:b]
                    add(lang, [names[i] for i in sc[rows]], _beyond(p[rows][None], p0[rows]))
                    if len(pairs) > PAIRS:
                        yield flush()
        if len(pairs) > PAIRS:
            yield flush()
    yield flush()


def _share(count: Column, below: Column) -> Column:
    """1 + floor(UNIT (count + SMOOTH) / below) in whole decimals; null where nothing is below."""
    top = (count + SMOOTH).cast("decimal(28,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.when(below > 0, 1 + F.call_function("div", top, below.cast("decimal(28,0)")))


def _sorted(df: DataFrame, *key: str) -> DataFrame:
    """df by the hash of a key, in front as h: one number sorts much faster than texts, and puts a key's rows together. It is
    made behind the exchange, where it needn't be written."""
    return df.repartition(*key).select(F.xxhash64(*key).alias("h"), *df.columns).sortWithinPartitions("h")


def audit_sources(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part `pair`: for each source of a language every other one, by the summed differences of their smoothed shares
    (of a thousand millionths) over the language's terms in at least least_docs documents. Part `term`: the `top` terms
    whose share in the source is furthest above that in the language. A row is a document; a null text,
    language or source is empty. A language with one source has no pairs, one without frequent terms pairs of
    value 0. An empty table gives no rows. Other columns are left out.
    """
    spark = df.sparkSession
    ship(spark)
    docs = df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    parts = docs.mapInArrow(_partial_counts, "lang string, term string, source string, docs bigint, count bigint")
    runs = _sorted(parts, "lang", "term", "source").mapInArrow(_source_counts, parts.schema)
    kept = _sorted(runs, "lang", "term").mapInArrow(_frequent(least_docs), parts.schema)
    kept = cut(kept, "audit-counts")
    # Totals: of each source and language over its frequent terms; V is the number of the language's.
    terms = kept.groupBy("lang", "term").agg(F.lit(1).alias("x")).groupBy("lang").agg(F.count("*").alias("v"))
    sums = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count("*").alias("has"))
    groups = cut(docs.select("lang", "source").distinct().join(cut(sums, "audit-sums"), ["lang", "source"], "left"), "audit-groups")
    langs = groups.groupBy("lang").agg(F.sum("n").alias("all_n")).join(terms, "lang", "left")
    groups = groups.join(cut(langs, "audit-langs"), "lang").na.fill(0, ["n", "has", "all_n", "v"])
    below = F.col("n") + SMOOTH * F.col("v")
    groups = groups.withColumns({"below": below, "all_below": F.col("all_n") + SMOOTH * F.col("v")})
    groups = cut(groups.withColumn("p0", F.coalesce(_share(F.lit(0).cast("bigint"), F.col("below")), F.lit(0).cast("bigint"))), "audit-shares")
    few = groups.count() <= BROADCAST_GROUPS
    side = groups.select("lang", "source", "below", "all_below", "p0")
    shares = kept.join(F.broadcast(side) if few else side, ["lang", "source"]).withColumn("p", _share(F.col("count"), F.col("below")))
    shares = cut(shares.select("lang", "term", "source", "count", "p", "p0", F.col("all_below").alias("below")), "audit-terms")
    found = _sorted(shares, "lang", "term").mapInArrow(_divergences, "lang string, source string, part string, item string, value bigint")
    found = cut(found, "audit-found")
    # A pair's value: each source's terms against the other's share of a term that it lacks, the terms that both
    # lack, and what the scan has added for those that both have. A source has at most about the square root
    # of twice its words of different shares.
    shape = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("k")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "k")).alias("shape"))
    full = cut(groups.select("lang", "source", "has", "v", "p0").join(shape, ["lang", "source"], "left"), "audit-shapes")
    a = full.select("lang", "source", "v", F.col("has").alias("has_a"), F.col("p0").alias("p0_a"), F.col("shape").alias("shape_a"))
    b = full.select("lang", F.col("source").alias("item"), F.col("has").alias("has_b"), F.col("p0").alias("p0_b"), F.col("shape").alias("shape_b"))
    pairs = a.join(b, "lang").filter("source < item")  # these pairs are the result: all sources of a language, once each
    both = found.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("both"))
    away = lambda s, p: F.coalesce(F.aggregate(s, F.lit(0).cast("bigint"), lambda acc, x: acc + x["k"] * F.abs(x["p"] - F.col(p))), F.lit(0))
    lacked = (F.col("v") - F.col("has_a") - F.col("has_b")) * F.abs(F.col("p0_a") - F.col("p0_b"))
    pairs = pairs.withColumn("value", away("shape_a", "p0_b") + away("shape_b", "p0_a") + lacked).select("lang", "source", "item", "value")
    pairs = pairs.join(both, ["lang", "source", "item"], "left").withColumn("value", F.col("value") + F.coalesce("both", F.lit(0)))
    way = F.array(F.struct(F.col("source"), F.col("item")), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    pairs = pairs.select("lang", F.explode(way).alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    terms = found.filter("part = 'term'").withColumn("rank", rank).filter(F.col("rank") <= top)
    return cut(pairs, "audit-pairs").withColumn("rank", rank).unionByName(terms)
