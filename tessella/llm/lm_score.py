"""Masked pseudo-likelihood of documents under a bidirectional window network trained in NumPy.

Every word is predicted from two words on either side, never from itself, along a path of a tree over the
whole vocabulary: log P(word | window) = log P(class | window) + log P(leaf | class, window)
+ log P(word | leaf). The network has a softmax over the classes and one over each class's leaves, both
on the same hidden layer. Frequent words have a leaf each; all others share leaves by their form and hash,
and in their leaf have the share of their exact count, with a mass for words never seen. A path's
probabilities sum to one. Named words and leaves grow with the square root of the distinct words, the table
of counts with the vocabulary; counts of frequent words go to all tasks, the others are joined by shuffle.

Training masks a share of the words of every document and predicts those. Documents are dealt by hash to
shards of about SHARD_WORDS words, which depend on the data alone, not on tasks; each shard trains from the
same start in a fixed order, and the weights are averaged by words, so scores don't depend on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, ship
from .wordhash import U64, HashIndex, Words, plain, text_chunks, words_of

FORMS = 24
#: Words whose counts go to all tasks, at most; the counts of all others are joined by shuffle.
HOT = 1 << 18
#: Distinct words that a task holds while counting, about.
HELD = 1 << 21
#: Words with a class of their own.
FREQUENT = 40
SIDES = (-2, -1, 1, 2)
HIDDEN = 32
#: Share of each document's words that training masks and predicts.
MASKED = 0.15
SHARD_WORDS = 4_000_000
ROUNDS, BATCH, RATE = 1, 4096, 0.05
#: Weights in one row on their way to the average.
BLOCK = 1 << 14

_DIGIT_OR_SIGN = np.zeros(256, dtype=bool)
_DIGIT_OR_SIGN[[*range(33, 39), *range(40, 44), *range(47, 63), *range(64, 65), *range(91, 97), *range(123, 127)]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".,;:!?"]] = True


def forms_of(words: Words) -> np.ndarray:
    """With or without bytes above 127, digits or signs, a final stop, in three bands of length."""
    if not len(words.hash):
        return np.zeros(0, dtype=np.int64)
    high = np.concatenate([[0], np.cumsum(words.data > 127)])
    sign = np.concatenate([[0], np.cumsum(_DIGIT_OR_SIGN[words.data])])
    a, b = words.start, words.end
    return (high[b] > high[a]).astype(np.int64) + 2 * (sign[b] > sign[a]) + 4 * _STOP[words.data[b - 1]] + 8 * np.digitize(b - a, [4, 8])


@dataclass
class Tree:
    """Leaves are numbered so that a class's leaves follow each other. own: leaf of each named word, by
    falling count; shared: leaf of form * spread + low bits of the hash, for all other words."""

    own: np.ndarray
    shared: np.ndarray
    spread: int
    class_of: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, forms: np.ndarray, distinct: int) -> Tree:
        """From the forms of the frequent words by falling count and the number of distinct words."""
        root = int(np.ceil(np.sqrt(distinct)))
        n = min(len(forms), max(FREQUENT, 1 << root.bit_length()))
        spread = 1 << max(0, (root // FORMS).bit_length())
        form = np.concatenate([forms[:n], np.repeat(np.arange(FORMS), spread)])
        leaves, alone = len(form), min(n, FREQUENT)
        order = np.concatenate([np.arange(alone), alone + np.argsort(form[alone:], kind="stable")])
        kind = np.concatenate([np.arange(alone), alone + form[order[alone:]]])
        head = np.flatnonzero(np.diff(kind, prepend=-1))
        within = np.arange(leaves) - np.repeat(head, np.diff(np.append(head, leaves)))
        most = 1 << int(np.sqrt(leaves)).bit_length()
        first = np.flatnonzero(within % most == 0)
        number = np.empty(leaves, dtype=np.int64)
        number[order] = np.arange(leaves)
        return cls(number[:n], number[n:], spread, np.repeat(np.arange(len(first)), np.diff(np.append(first, leaves))), np.append(first, leaves))

    def __len__(self) -> int:
        return len(self.class_of)


@dataclass
class Vocabulary:
    """The tree, the frequent words' leaves and counts, and each leaf's words and distinct words."""

    tree: Tree
    hot: HashIndex
    hot_leaf: np.ndarray
    hot_count: np.ndarray
    total: np.ndarray
    distinct: np.ndarray

    def leaves_of(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each word, and its place among the frequent words or -1."""
        at = self.hot.find(words.hash)
        leaf = self.hot_leaf[at] if len(self.hot_leaf) else np.zeros(len(at), dtype=np.int64)
        rare = np.flatnonzero(at < 0)
        if len(rare):
            few = Words(words.data, words.start[rare], words.end[rare], words.hash[rare], words.first, words.text_from)
            leaf[rare] = self.tree.shared[forms_of(few) * self.tree.spread + (few.hash & U64(self.tree.spread - 1)).astype(np.int64)]
        return leaf, at

    def log_inside(self, leaf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log P(word | leaf), 0 where the count isn't here, and whether it isn't."""
        out = np.zeros(len(leaf))
        shares = np.flatnonzero((at >= len(self.tree.own)) & (at >= 0))
        out[shares] = np.log((self.hot_count[at[shares]] - 0.5) / (self.total[leaf[shares]] + 1.0))
        return out, at < 0


class WindowNetwork:
    """Leaf embeddings at four places, a tanh layer, softmaxes over classes and over a class's leaves;
    trained by Adagrad on the rows that a batch touches."""

    def __init__(self, tree: Tree, weights: np.ndarray):
        self.tree, self.weights = tree, weights.astype(np.float32)
        leaves, classes = len(tree), len(tree.first) - 1
        self.shapes = ((len(SIDES) * (leaves + 1), HIDDEN), (1, HIDDEN), (classes, HIDDEN), (classes, 1), (leaves, HIDDEN), (leaves, 1))
        self.squares = np.full_like(self.weights, 1e-8)
        self.parts, self.sums = self._views(self.weights), self._views(self.squares)
        self.wide = np.flatnonzero(np.diff(tree.first) > 1)

    def _views(self, flat: np.ndarray) -> list[np.ndarray]:
        out, at = [], 0
        for shape in self.shapes:
            out.append(flat[at : at + shape[0] * shape[1]].reshape(shape))
            at += shape[0] * shape[1]
        return out

    @staticmethod
    def start(tree: Tree, total: np.ndarray, seed: int = 1) -> np.ndarray:
        """Random embeddings; output layers give the corpus frequencies."""
        leaf = np.log(total + 1.0)
        by_class = np.log(np.add.reduceat(total + 1.0, tree.first[:-1]))
        table = np.random.default_rng(seed).normal(0, 0.3, len(SIDES) * (len(tree) + 1) * HIDDEN)
        zeros = lambda n: np.zeros(n * HIDDEN)
        return np.concatenate([table, zeros(1), zeros(len(by_class)), by_class - by_class.max(), zeros(len(leaf)), leaf - leaf.max()]).astype(np.float32)

    def _hidden(self, around: np.ndarray) -> np.ndarray:
        table, bias = self.parts[:2]
        at = around + np.arange(len(SIDES)) * (len(self.tree) + 1)
        h = table[at[:, 0]]
        for k in range(1, len(SIDES)):
            h += table[at[:, k]]
        h += bias
        return np.tanh(h, out=h)

    def _classes(self, leaf: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """First and last leaf of each class with several leaves, and the rows whose leaf is among them."""
        of = self.tree.class_of[leaf]
        order = np.argsort(of, kind="stable")
        ends = np.searchsorted(of[order], self.wide, "right").tolist()
        begins = np.searchsorted(of[order], self.wide, "left").tolist()
        for c, a, b in zip(self.wide.tolist(), begins, ends):
            if a < b:
                yield int(self.tree.first[c]), int(self.tree.first[c + 1]), order[a:b]

    @staticmethod
    def _softmax(z: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities by row, in place, and the target's log probability."""
        z -= z.max(axis=1, keepdims=True)
        hit = z[np.arange(len(z)), target]
        np.exp(z, out=z)
        sums = z.sum(axis=1)
        z /= sums[:, None]
        return z, hit - np.log(sums)

    def log_probs(self, around: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """log P(leaf | window) for rows of four leaves."""
        _, _, u, cu, v, cv = self.parts
        h = self._hidden(around)
        out = self._softmax(h @ u.T + cu.T, self.tree.class_of[leaf])[1]
        for a, b, rows in self._classes(leaf):
            out[rows] += self._softmax(h[rows] @ v[a:b].T + cv[a:b].T, leaf[rows] - a)[1]
        return out

    def gradients(self, around: np.ndarray, leaf: np.ndarray) -> list[tuple[int, np.ndarray | slice, np.ndarray]]:
        """Of the mean negative log probability: (part, its rows, values)."""
        _, _, u, cu, v, cv = self.parts
        n, out = len(leaf), []
        h = self._hidden(around)

        def step(z: np.ndarray, target: np.ndarray) -> np.ndarray:
            d, _ = self._softmax(z, target)
            d[np.arange(len(d)), target] -= 1
            d /= n
            return d

        d = step(h @ u.T + cu.T, self.tree.class_of[leaf])
        out += [(2, slice(None), d.T @ h), (3, slice(None), d.sum(axis=0)[:, None])]
        back = d @ u
        for a, b, rows in self._classes(leaf):
            d = step(h[rows] @ v[a:b].T + cv[a:b].T, leaf[rows] - a)
            out += [(4, slice(a, b), d.T @ h[rows]), (5, slice(a, b), d.sum(axis=0)[:, None])]
            back[rows] += d @ v[a:b]
        back *= 1 - h * h
        out.append((1, slice(None), back.sum(axis=0)[None, :]))
        at = (around + np.arange(len(SIDES)) * (len(self.tree) + 1)).ravel()
        order = np.argsort(at, kind="stable")
        head = np.flatnonzero(np.diff(at[order], prepend=-1))
        out.append((0, at[order][head], np.add.reduceat(back[order // len(SIDES)], head, axis=0)))
        return out

    def train(self, around: np.ndarray, leaf: np.ndarray, rate: float) -> None:
        for k, rows, g in self.gradients(around, leaf):
            s = self.sums[k][rows] + g * g
            self.sums[k][rows] = s
            self.parts[k][rows] -= rate * g / np.sqrt(s)


def windows(leaves: np.ndarray, first: np.ndarray, edge: int, at: np.ndarray | None = None) -> np.ndarray:
    """The leaves at the four places around each word, or around those at some places; `edge` beyond its text."""
    size = np.diff(first)
    low, high = np.repeat(first[:-1], size), np.repeat(first[1:], size)
    if at is None:
        at = np.arange(len(leaves))
    else:
        low, high = low[at], high[at]
    out = np.empty((len(at), len(SIDES)), dtype=np.int64)
    for k, side in enumerate(SIDES):
        j = at + side
        out[:, k] = np.where((j >= low) & (j < high), leaves[np.clip(j, 0, len(leaves) - 1)], edge) if len(leaves) else edge
    return out


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    h, f, n = (np.concatenate(x) for x in zip(*parts))
    u, first, back = np.unique(h, return_index=True, return_inverse=True)
    return u, f[first], np.bincount(back, weights=n, minlength=len(u)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[tuple[np.ndarray, ...]] = []

    def rows():
        h, f, n = _merged(parts)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(f.astype(np.int32)), pa.array(n)], names=["hash", "form", "n"])

    for batch in batches:
        text = plain(batch.column(0))
        for a, b in text_chunks(text):
            words = words_of(text.slice(a, b - a))
            u, first, n = np.unique(words.hash, return_index=True, return_counts=True)
            parts.append((u, forms_of(words)[first], n))
            if sum(len(x[0]) for x in parts) > 2 * HELD:
                parts = [_merged(parts)]
                if len(parts[0][0]) > HELD:
                    yield rows()
                    parts = []
    if parts:
        yield rows()


def corpus_counts(docs: DataFrame) -> DataFrame:
    """hash, form, n of each distinct word of all texts, exact; written to the shared folder."""
    return cut(docs.select("text").mapInArrow(_count, "hash bigint, form int, n bigint").groupBy("hash", "form").agg(F.sum("n").alias("n")), "lm-words")


def frequent_words(counts: DataFrame, most: int = HOT):
    """The words above the least count that at most `most` words exceed, by falling count."""
    left, least = most, None
    for r in counts.groupBy("n").count().orderBy(F.col("n").desc()).toLocalIterator():
        if r["count"] > left:
            break
        left, least = left - r["count"], r["n"]
    got = counts.filter(F.col("n") >= least if least is not None else F.lit(False)).toPandas()
    return got.sort_values(["n", "hash"], ascending=[False, True])


def vocabulary_of(counts: DataFrame, hot: int = HOT) -> Vocabulary:
    """The driver gets the frequent words and a sum per shared leaf."""
    top = frequent_words(counts, hot)
    hashes, n, forms = (top[c].to_numpy(dtype=np.int64) for c in ("hash", "n", "form"))
    tree = Tree.of(forms, counts.count())
    leaf = tree.shared[forms * tree.spread + (hashes & (tree.spread - 1))]
    leaf[: len(tree.own)] = tree.own
    total, distinct = (np.bincount(leaf, weights=w, minlength=len(tree)).astype(np.float64) for w in (n, None))
    cold = counts.filter(F.col("n") < int(n[-1])) if len(n) else counts
    low = F.col("hash").bitwiseAND(F.lit(tree.spread - 1).cast("bigint"))
    rest = cold.groupBy((F.col("form") * tree.spread + low).alias("g")).agg(F.sum("n").alias("n"), F.count("*").alias("d")).toPandas()
    at = tree.shared[rest["g"].to_numpy(dtype=np.int64)]
    total[at] += rest["n"].to_numpy(dtype=np.float64)
    distinct = distinct + np.bincount(at, weights=rest["d"].to_numpy(dtype=np.float64), minlength=len(tree))
    return Vocabulary(tree, HashIndex(hashes.view(np.uint64)), leaf, n.astype(np.float64), total, distinct)


def _train(sent, rate: float):
    """The weights of a partition's shard, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weights = sent.value
        net, seen = WindowNetwork(vocabulary.tree, weights.copy()), 0
        shard = TaskContext.get().partitionId()
        pick_words = np.random.default_rng(shard)
        for batch in batches:
            text = plain(batch.column(0))
            for a, b in text_chunks(text):
                words = words_of(text.slice(a, b - a))
                leaf, _ = vocabulary.leaves_of(words)
                at = np.flatnonzero(pick_words.random(len(leaf)) < MASKED)
                pick_words.shuffle(at)
                for k in range(0, len(at), BATCH):
                    pick = at[k : k + BATCH]
                    net.train(windows(leaf, words.first, len(vocabulary.tree), pick), leaf[pick], rate * min(1.0, len(pick) / BATCH))
                seen += len(leaf)
        if seen:
            for k in range(0, len(net.weights), BLOCK):
                row = (k, shard, seen, net.weights[k : k + BLOCK].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["block", "shard", "seen", "x"])

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Means of the rows (block, shard, seen, x), which come sorted by block and shard."""
    block, total, seen = None, None, 0

    def row():
        return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([(total / seen).astype(np.float32).tobytes()])], names=["block", "x"])

    for batch in batches:
        for k, n, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if k != block and block is not None:
                yield row()
            if k != block:
                block, total, seen = k, 0.0, 0
            total = total + np.frombuffer(x, dtype=np.float32).astype(np.float64) * n
            seen += n
    if block is not None:
        yield row()


def fit(docs: DataFrame, rounds: int = ROUNDS, rate: float = RATE, hot: int = HOT, shard_words: int = SHARD_WORDS) -> tuple[Vocabulary, np.ndarray, DataFrame]:
    """Vocabulary, weights and the counts of all words from all texts (text, and salt: what tells apart rows
    with one text)."""
    spark = docs.sparkSession
    counts = corpus_counts(docs)
    vocabulary = vocabulary_of(counts, hot)
    weights = WindowNetwork.start(vocabulary.tree, vocabulary.total)
    shards = max(1, -(-int(vocabulary.total.sum()) // shard_words))
    key = F.xxhash64("text", "salt")
    dealt = docs.withColumn("h", key).withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
    dealt = dealt.repartitionById(shards, "shard").sortWithinPartitions("h").select("text")
    for r in range(rounds):
        sent = spark.sparkContext.broadcast((vocabulary, weights))
        parts = dealt.mapInArrow(_train(sent, rate / (1 + r)), "block bigint, shard bigint, seen bigint, x binary")
        parts = parts.repartition(partitions(spark), "block").sortWithinPartitions("block", "shard")
        got = sorted((x["block"], bytes(x["x"])) for x in parts.mapInArrow(_average, "block bigint, x binary").collect())
        if got:
            weights = np.frombuffer(b"".join(x for _, x in got), dtype=np.float32)
    return vocabulary, weights, counts


def _score(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weights = sent.value
        net = WindowNetwork(vocabulary.tree, weights)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            text = plain(batch.column(1))
            for a, b in text_chunks(text):
                words = words_of(text.slice(a, b - a))
                leaf, at = vocabulary.leaves_of(words)
                logp, open_ = vocabulary.log_inside(leaf, at)
                around = windows(leaf, words.first, len(vocabulary.tree))
                for k in range(0, len(leaf), 16384):
                    logp[k : k + 16384] += net.log_probs(around[k : k + 16384], leaf[k : k + 16384])
                total = np.diff(np.concatenate([[0.0], np.cumsum(logp)])[words.first])
                held = np.concatenate([[0], np.cumsum(open_)])[words.first]
                rare = lambda x, held=held: pa.ListArray.from_arrays(pa.array(held.astype(np.int32)), pa.array(x))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(b - a)), batch.column(0).slice(a, b - a), pa.array(words.counts), pa.array(total), rare(words.hash[open_].view(np.int64)), rare(leaf[open_].astype(np.int32))],
                    names=["row", "id", "n", "s", "hashes", "leaves"],
                )
                row += b - a

    return run


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", training: DataFrame | None = None, rounds: int = ROUNDS, hot: int = HOT) -> DataFrame:
    """One row per row of df: id, n_words, log_likelihood (summed over words), mean_log_likelihood.

    The model is trained on all of df's texts, or on those of `training`. A word without a count there is
    taken for one of twice as many unseen words as its leaf has seen ones. The counts of the `hot` most
    frequent words go to all tasks. Null, empty and blank texts have no words, a sum of 0 and a null mean.
    Null ids and repeated rows are kept; an empty table gives no rows; other columns are left out.
    """
    spark = df.sparkSession
    ship(spark)
    source = df if training is None else training
    salt = F.col(f"`{id_col}`") if id_col in source.columns else F.lit(0)
    vocabulary, weights, counts = fit(source.select(F.col(f"`{text_col}`").alias("text"), salt.alias("salt")), rounds, hot=hot)
    sent = spark.sparkContext.broadcast((vocabulary, weights))
    kind = dict(df.dtypes)[id_col]
    schema = f"row bigint, id {kind}, n bigint, s double, hashes array<bigint>, leaves array<int>"
    rows = cut(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(_score(sent), schema), "lm-scores")
    sizes = spark.createDataFrame([(i, float(t), float(d)) for i, (t, d) in enumerate(zip(vocabulary.total, vocabulary.distinct))], "g int, total double, distinct double")
    rare = rows.select("row", F.explode(F.arrays_zip("hashes", "leaves")).alias("x")).select("row", F.col("x.hashes").alias("hash"), F.col("x.leaves").alias("g"))
    share = F.coalesce(F.col("n") - 0.5, (F.col("distinct") / 2 + 1) / (2 * F.col("distinct") + 2)) / (F.col("total") + 1)
    cold = counts.select("hash", "n").filter(F.col("n") < int(vocabulary.hot_count.min()) if len(vocabulary.hot_count) else F.lit(True))
    more = rare.join(cold, "hash", "left").join(F.broadcast(sizes), "g").groupBy("row").agg(F.sum(F.log(share)).alias("more"))
    s = F.col("s") + F.coalesce("more", F.lit(0.0))
    out = rows.select("row", "id", "n", "s").join(more, "row", "left").select("id", "n", s.alias("s"), F.when(F.col("n") > 0, s / F.col("n")).alias("m"))
    return out.toDF(id_col, "n_words", "log_likelihood", "mean_log_likelihood")
