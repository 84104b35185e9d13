"""Substring dedup with suffix automata.

A window of so many words that starts in two places of the corpus is removed from both. The reference is
the corpus itself, which has no size bound, so its automata aren't broadcast: each window is assigned to
an anchor inside it, the smallest hash among its shorter word runs. Equal windows have equal anchors, so
an anchor's contexts hold every place where a window of its own can start. Anchors that occur once go no
further. For each other one a suffix automaton is built over its contexts, these stream through it for
their matching statistics, and the windows that end in states seen at two places are marked. Contexts of
an anchor that has too many for one task are dealt anew by longer anchors, the longest being the window
itself; the windows are still judged by automata. `strip_reference` is the same search for a reference
whose size is checked; there the automata are broadcast and documents stream through whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, partitions, ship
from .wordhash import U64, _WORD_POWERS, Words, mix, plain, text_chunks, words_of

WINDOW = 35
#: Distinct contexts of one automaton, at most; an anchor with more is split by longer anchors.
CONTEXTS = 500
#: Words of a broadcast reference, at most, and of one of its automata.
MAX_REFERENCE_WORDS, SHARD_WORDS = 5_000_000, 250_000


class SuffixAutomaton:
    """Of several sequences. seen[state] counts the places where a state's strings end."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.seen = [0]

    def _state(self, length: int, nxt: dict, link: int) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        self.seen.append(0)
        return len(self.next) - 1

    def _split(self, p: int, c, q: int) -> int:
        """The state of p's string + c, split from q if q also has longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, sequence, times: int = 1) -> None:
        last = 0
        for c in sequence:
            q = self.next[last].get(c)
            if q is not None:
                last = self._split(last, c, q)
            else:
                new, p = self._state(self.length[last] + 1, {}, 0), last
                while p >= 0 and c not in self.next[p]:
                    self.next[p][c] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, c, self.next[p][c])
                last = new
            self.seen[last] += times

    def close(self) -> None:
        """Adds up the counts of longer strings; once, after the last sequence."""
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.seen[self.link[s]] += self.seen[s]

    def statistics(self, sequence) -> Iterator[tuple[int, int]]:
        """For each position the state and length of the longest string of the automaton that ends there."""
        s, n = 0, 0
        for c in sequence:
            while s > 0 and c not in self.next[s]:
                s = self.link[s]
                n = self.length[s]
            if c in self.next[s]:
                s, n = self.next[s][c], n + 1
            else:
                s, n = 0, 0
            yield s, n

    def repeated(self, sequence, window: int) -> list[tuple[int, int]]:
        """Runs (first, number) of windows of the sequence that occur at two places or more."""
        runs: list[tuple[int, int]] = []
        for at, (s, n) in enumerate(self.statistics(sequence)):
            if n >= window:
                while self.length[self.link[s]] >= window:
                    s = self.link[s]
                if self.seen[s] > 1:
                    first = at - window + 1
                    if runs and sum(runs[-1]) == first:
                        runs[-1] = (runs[-1][0], runs[-1][1] + 1)
                    else:
                        runs.append((first, 1))
        return runs


def ladder(window: int) -> list[int]:
    """Words of an anchor: about a third of the window, two thirds, the window."""
    return sorted({max(1, (window + 1) // 3), max(1, 2 * window // 3), window})


def anchors(words: Words, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Text, first word in the text, windows, anchor hash and context hash of each anchor: the windows
    that start at `first` and the following places share the anchor, the leftmost smallest run's."""
    none = tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    runs, doc, at = words.ngrams(anchor)
    span = window - anchor + 1
    if len(runs) < span:
        return none
    inside = doc[span - 1 :] == doc[: len(doc) - span + 1]
    low = np.empty(len(inside), dtype=np.int64)
    view = np.lib.stride_tricks.sliding_window_view(runs, span)
    for a in range(0, len(view), 65536):
        low[a : a + 65536] = view[a : a + 65536].argmin(axis=1)
    start = np.flatnonzero(inside)
    if not len(start):
        return none
    low = low[start] + start
    new = np.ones(len(low), dtype=bool)
    new[1:] = low[1:] != low[:-1]  # of different texts they differ
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(low)))
    first, text = at[start[head]], doc[start[head]]
    w = len(words.hash)
    up, down = _WORD_POWERS.upto(w + 1)
    sums = np.zeros(w + 1, dtype=np.uint64)
    np.cumsum(words.hash * up[:w], out=sums[1:])
    ctx = mix((sums[first + count + window - 1] - sums[first]) * down[first] + count.astype(np.uint64))
    # Where in the context the anchor lies is part of its name.
    ctx = mix(ctx ^ (low[head] - start[head]).astype(np.uint64) * U64(0x9E3779B97F4A7C15))
    return text, first - words.first[text], count, runs[low[head]].view(np.int64), ctx.view(np.int64)


def _anchor_rows(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = plain(batch.column(2))
            key, th = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            for a, b in text_chunks(text):
                doc, first, count, fp, ctx = anchors(words_of(text.slice(a, b - a)), window, anchor)
                if len(doc):
                    doc = a + doc
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[doc]), pa.array(th[doc]), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(fp), pa.array(ctx)],
                        names=["key", "th", "first", "wins", "fp", "ctx"],
                    )

    return run


def _slices(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> pa.ListArray:
    """A list array of ranges of the values."""
    ends = np.cumsum(size)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values[at]))


def _contexts(window: int):
    """Words of the contexts asked for, from each text and its list of (fp, ctx, first, wins, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, asked = plain(batch.column(0)), batch.column(1)
            for a, b in text_chunks(text):
                words = words_of(text.slice(a, b - a))
                part = asked.slice(a, b - a)
                rows, doc = part.flatten(), np.repeat(np.arange(b - a), pc.list_value_length(part).to_numpy(zero_copy_only=False))
                first = words.first[doc] + rows.field("first").to_numpy()
                size = rows.field("wins").to_numpy() + (window - 1)
                for c in range(0, len(doc), 20_000):
                    d = min(len(doc), c + 20_000)
                    seq = _slices(words.hash.view(np.int64), first[c:d], size[c:d])
                    yield pa.RecordBatch.from_arrays([*(rows.field(x).slice(c, d - c) for x in ("fp", "ctx", "n")), seq], names=["fp", "ctx", "n", "words"])

    return run


def _again(window: int, anchor: int):
    """The longer anchors inside contexts (fp, ctx, n, words): place is where a new context starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(3)
            values, ends = flat.values.to_numpy().view(np.uint64), flat.offsets.to_numpy().astype(np.int64)
            values, ends = values[ends[0] : ends[-1]], ends - ends[0]
            none = np.zeros(0, dtype=np.int64)
            row, place, count, fp, ctx = anchors(Words(none, none, none, values, ends, ends), window, anchor)
            take, seq = pa.array(row), _slices(values.view(np.int64), ends[row] + place, count + (window - 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(place), pa.array(fp), pa.array(ctx), batch.column(2).take(take), seq],
                names=["fp", "ctx", "place", "fp2", "ctx2", "n", "words"],
            )

    return run


def _automata(window: int):
    """Rows sorted by fp come in; each fp's contexts make one automaton and stream through it. A run of
    repeated windows of a context comes out as a row."""

    def marks(group: list[tuple]):
        auto = SuffixAutomaton()
        for _, _, n, seq in group:
            auto.add(seq, n)
        auto.close()
        return [(fp, ctx, at, size) for fp, ctx, _, seq in group for at, size in auto.repeated(seq, window)]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["fp", "ctx", "at", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, out = [], []
        for batch in batches:
            flat = batch.column(3)
            ends, values = flat.offsets.to_numpy(), flat.values.to_numpy()
            for i, (fp, ctx, n) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)))):
                if group and group[0][0] != fp:
                    out += marks(group)
                    group = []
                    if len(out) > 10_000:
                        yield table(out)
                        out = []
                group.append((fp, ctx, n, values[ends[i] : ends[i + 1]].tolist()))
        if group:
            out += marks(group)
        if out:
            yield table(out)

    return run


def _cover(n_words: int, spans: pa.Array, doc_first: np.ndarray, window: int) -> np.ndarray:
    """Which of all words the runs of windows in `spans`, a list of (first, size) per text, cover."""
    doc = np.repeat(np.arange(len(spans)), pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False))
    rows = spans.flatten()
    first = doc_first[doc] + rows.field("first").to_numpy(zero_copy_only=False)
    delta = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(delta, first, 1)
    np.add.at(delta, first + rows.field("size").to_numpy(zero_copy_only=False) + (window - 1), -1)
    return np.cumsum(delta[:n_words]) > 0


def kept_bytes(words: Words, removed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each text's kept words, joined by one space, and their bounds."""
    keep = np.flatnonzero(~removed)
    doc = words.doc[keep]
    more = np.zeros(len(keep), dtype=np.int64)
    more[:-1] = doc[1:] == doc[:-1]
    data = words.data.copy()
    data[words.end[keep][more > 0]] = 32
    delta = np.zeros(len(data) + 2, dtype=np.int8)
    np.add.at(delta, words.start[keep], 1)
    np.add.at(delta, words.end[keep] + more, -1)
    inside = np.cumsum(delta, dtype=np.int8)[: len(data)] > 0
    ends = np.concatenate([[0], np.cumsum(inside)])
    return data[inside], ends[words.text_from]


def _finish(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, spans = plain(batch.column(1)), batch.column(2)
            for a, b in text_chunks(text):
                part = text.slice(a, b - a)
                words = words_of(part)
                removed = _cover(len(words.hash), spans.slice(a, b - a), words.first, window)
                gone = np.concatenate([[0], np.cumsum(removed)])
                gone = gone[words.first[1:]] - gone[words.first[:-1]]
                data, ends = kept_bytes(words, removed)
                raw = data.tobytes()
                kept = [raw[ends[i] : ends[i + 1]] for i in range(b - a)]
                columns = [batch.column(0).slice(a, b - a), pa.array(words.counts), pa.array(gone)]
                if with_text:
                    old = batch.column(1).slice(a, b - a).to_pylist()
                    columns.append(pa.array([k.decode("utf-8") if g else o for k, g, o in zip(kept, gone, old)], pa.string()))
                else:
                    columns.append(pa.array([hashlib.sha256(k).hexdigest() for k in kept]))
                for k in range(3, batch.num_columns):
                    columns.append(batch.column(k).slice(a, b - a))
                yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])

    return run


def _marked(held: DataFrame, window: int, anchors_: list[int], most: int) -> DataFrame:
    """fp, ctx, at, size: runs of repeated windows in the contexts (fp, ctx, n, words). Anchors with more than
    `most` contexts are dealt by the next longer anchor; the last one is a whole window, whose contexts
    are all equal."""
    spark = held.sparkSession
    crowded = held.groupBy("fp").count().filter(F.col("count") > most).select("fp")
    crowded = cut(crowded, "sub-crowded") if anchors_ else None
    split = crowded is not None and not crowded.isEmpty()
    alone = held.join(crowded, "fp", "left_anti") if split else held
    out = alone.select("fp", "ctx", "n", "words").repartition(partitions(spark), "fp").sortWithinPartitions("fp", "ctx")
    out = out.mapInArrow(_automata(window), "fp bigint, ctx bigint, at int, size int")
    if not split:
        return cut(out, "sub-marks")
    out = cut(out, "sub-marks")
    schema = "fp bigint, ctx bigint, place bigint, fp2 bigint, ctx2 bigint, n bigint, words array<bigint>"
    inner = held.join(crowded, "fp", "left_semi").select("fp", "ctx", "n", "words").mapInArrow(_again(window, anchors_[0]), schema)
    inner = cut(inner, "sub-inner")
    kinds = inner.groupBy(F.col("fp2").alias("fp"), F.col("ctx2").alias("ctx")).agg(F.sum("n").alias("n"), F.first("words").alias("words"))
    kinds = cut(kinds, "sub-contexts")
    more = _marked(kinds, window, anchors_[1:], most).withColumnsRenamed({"fp": "fp2", "ctx": "ctx2"})
    back = inner.join(more, ["fp2", "ctx2"]).select("fp", "ctx", (F.col("at") + F.col("place")).cast("int").alias("at"), "size")
    return cut(out.union(back), "sub-marks")


def repeated_spans(docs: DataFrame, window: int = WINDOW, most: int = CONTEXTS) -> DataFrame:
    """key, th, spans for each text (key bigint, th int, text) that has a repeated window; a span is the first
    word of the first of some consecutive windows that are repeated, and their number."""
    anchor, *longer = ladder(window)
    occ = cut(docs.mapInArrow(_anchor_rows(window, anchor), "key bigint, th int, first int, wins int, fp bigint, ctx bigint"), "sub-anchors")
    # Aggregates are written before they are joined: Spark splits a hot key of a join only between scans.
    twice = cut(occ.groupBy("fp").count().filter("count > 1").select("fp"), "sub-twice")
    cand = cut(occ.join(twice, "fp"), "sub-candidates")
    discard(occ, twice)
    kinds = cand.groupBy("fp", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("key", "th", "first", "wins")).alias("at"))
    asked = kinds.groupBy(F.col("at.key").alias("key"), F.col("at.th").alias("th")).agg(
        F.collect_list(F.struct("fp", "ctx", F.col("at.first").alias("first"), F.col("at.wins").alias("wins"), "n")).alias("asked")
    )
    asked = cut(asked, "sub-asked")
    # Rows of one key and text repeat each other: all of them count in n, but one of them gives the contexts, and
    # their places are taken once.
    repeats = cut(docs.groupBy("key", "th").count().filter("count > 1").select("key", "th"), "sub-repeats")
    repeated = not repeats.isEmpty()
    texts = docs
    if repeated:
        one = docs.join(repeats, ["key", "th"], "left_semi").groupBy("key", "th").agg(F.first("text").alias("text"))
        texts = docs.join(repeats, ["key", "th"], "left_anti").unionByName(one)
        cand = cut(cand.select("key", "th", "first", "fp", "ctx").distinct(), "sub-candidates")
    held = texts.join(asked, ["key", "th"]).select("text", "asked").mapInArrow(_contexts(window), "fp bigint, ctx bigint, n bigint, words array<bigint>")
    held = cut(held, "sub-contexts")
    marks = _marked(held, window, longer, most)
    discard(asked, held, repeats)
    spans = cand.join(marks, ["fp", "ctx"]).select("key", "th", (F.col("first") + F.col("at")).alias("first"), "size")
    spans = spans.groupBy("key", "th").agg(F.collect_list(F.struct("first", "size")).alias("spans"))
    # Repeated rows make a hot key of the join with their spans, which Spark splits only between scans.
    return cut(spans, "sub-spans") if repeated else spans


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """One row per row of df: id, n_words, n_removed and kept_sha256 of the kept words joined by one space;
    or with_text all columns of df, the text without its removed words, and n_words, n_removed.

    Words are compared unchanged. Each word covered by a window of `window` words whose sequence also
    starts anywhere else, in another document or the same, is removed; windows are judged on the input.
    Null, empty and short texts lose nothing; a text that loses nothing is returned as it was, one that
    loses words has single spaces between the others. Rows with a null id, or with one id, are told apart
    by their texts; repeated rows repeat each other's windows, so they lose them. An empty table gives no
    rows. Any window of at least one word will do.
    """
    ship(df.sparkSession)
    if window < 1:
        raise ValueError("a window has at least one word")
    kind = dict(df.dtypes)[id_col]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    key = F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.xxhash64(text))
    spans = repeated_spans(df.select(key.alias("key"), F.hash(text).alias("th"), F.col(f"`{text_col}`").alias("text")), window)
    others = [c for c in df.columns if c not in (id_col, text_col, "n_words", "n_removed")] if with_text else []
    rows = df.select(
        key.alias("key"), F.hash(text).alias("th"), F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"), *[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(others)]
    )
    rows = rows.join(spans, ["key", "th"], "left").select("__id", "__text", "spans", *[f"__{i}" for i in range(len(others))])
    kinds = dict(df.dtypes)
    schema = f"c0 {kind}, c1 bigint, c2 bigint, c3 string" + "".join(f", c{i + 4} {kinds[c]}" for i, c in enumerate(others))
    out = rows.mapInArrow(_finish(window, with_text), schema)
    if not with_text:
        return out.toDF(id_col, "n_words", "n_removed", "kept_sha256")
    out = out.toDF(id_col, "n_words", "n_removed", text_col, *others)
    return out.select(*[f"`{c}`" for c in df.columns if c not in ("n_words", "n_removed")], "n_words", "n_removed")


def strip_reference(df: DataFrame, reference: DataFrame, id_col: str = "doc_id", text_col: str = "text", reference_text: str = "text", window: int = WINDOW) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 of df's texts without their maximal spans of at least `window`
    words that occur in the reference. The reference is counted first and refused above
    MAX_REFERENCE_WORDS; shards of it become suffix automata, which are broadcast, and documents stream
    through each for their matching statistics. Use `dedup_substrings` for larger references."""
    spark = df.sparkSession
    ship(spark)
    n = reference.select(F.sum(F.size(F.split(F.coalesce(F.col(reference_text), F.lit("")), r"[\x20\x09-\x0D]+")).cast("bigint"))).first()[0] or 0
    if n > MAX_REFERENCE_WORDS:
        raise ValueError(f"the reference has {n} words, more than {MAX_REFERENCE_WORDS}")
    shards, held = [[]], 0
    for r in reference.select(reference_text).toLocalIterator():
        seq = words_of(pa.array([r[0] or ""])).hash.tolist()
        if held + len(seq) > SHARD_WORDS and shards[-1]:
            shards.append([])
            held = 0
        shards[-1].append(seq)
        held += len(seq)
    automata = []
    for shard in shards:
        auto = SuffixAutomaton()
        for seq in shard:
            auto.add(seq)
        automata.append(auto)
    sent = spark.sparkContext.broadcast(automata)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = plain(batch.column(1))
            for a, b in text_chunks(text):
                words = words_of(text.slice(a, b - a))
                delta = np.zeros(len(words.hash) + 1, dtype=np.int64)
                for d in range(b - a):
                    f, t = int(words.first[d]), int(words.first[d + 1])
                    seq = words.hash[f:t].tolist()
                    for auto in sent.value:
                        for at, (_, n) in enumerate(auto.statistics(seq)):
                            if n >= window:
                                delta[f + at - n + 1] += 1
                                delta[f + at + 1] -= 1
                removed = np.cumsum(delta[:-1]) > 0
                gone = np.concatenate([[0], np.cumsum(removed)])
                gone = gone[words.first[1:]] - gone[words.first[:-1]]
                data, ends = kept_bytes(words, removed)
                raw = data.tobytes()
                digests = [hashlib.sha256(raw[ends[i] : ends[i + 1]]).hexdigest() for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(words.counts), pa.array(gone), pa.array(digests)], names=["c0", "c1", "c2", "c3"])

    kind = dict(df.dtypes)[id_col]
    out = df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, f"c0 {kind}, c1 bigint, c2 bigint, c3 string")
    return out.toDF(id_col, "n_words", "n_removed", "kept_sha256")
