"""Near-dedup, BPE, substring dedup, records, language-model scores."""

import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import bpe, components, lm_score, near_dedup, records, substring_dedup, wordhash

RANKS, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")


def test_words(odd_rows):
    texts = [t or "" for _, t in odd_rows]
    column = pa.array(texts)
    hashes = {}
    for a, b in wordhash.text_chunks(column, 500):
        w = wordhash.words_of(column.slice(a, b - a))
        flat = [x for t in texts[a:b] for x in brute.words(t)]
        assert len(flat) == len(w.hash) and w.counts.tolist() == [len(brute.words(t)) for t in texts[a:b]]
        for x, h in zip(flat, w.hash.tolist()):
            assert hashes.setdefault(x, h) == h
    assert len(set(hashes.values())) == len(hashes)


@pytest.mark.parametrize("n", [4, 5])
def test_shingle_sets(odd_rows, n):
    w = wordhash.words_of(pa.array([t or "" for _, t in odd_rows]), lower=True)
    h, first = wordhash.shingle_sets(w, n)
    sets = [set(h[first[i] : first[i + 1]].tolist()) for i in range(len(odd_rows))]
    want = [brute.shingles(t, n) for _, t in odd_rows]
    assert [len(s) for s in sets] == [len(s) for s in want]
    for i in range(20, 45):
        for j in range(20, i):
            if j < len(sets) and i < len(sets):
                assert len(sets[i] & sets[j]) == len(want[i] & want[j])


def test_superminhash_estimates():
    r = np.random.default_rng(1)
    for n, j in ((20, 0.8), (300, 0.5), (3000, 0.8)):
        errors = []
        for _ in range(60):
            k = round(2 * n * j / (1 + j))
            a = r.integers(0, 1 << 63, n, dtype=np.uint64)
            b = np.concatenate([a[:k], r.integers(0, 1 << 63, n - k, dtype=np.uint64)])
            s = near_dedup.superminhash(np.concatenate([a, b]), np.array([0, n, 2 * n]))
            errors.append((s[0] == s[1]).mean() - k / (2 * n - k))
        assert abs(np.mean(errors)) < 0.012 and np.std(errors) < 1.1 * (j * (1 - j) / near_dedup.SLOTS) ** 0.5


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates(odd, odd_rows, n):
    want = brute.groups(odd_rows, n)
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(odd, shingle=n).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_near_duplicate_families(spark, monkeypatch):
    """A family of near copies whose links form chains, and one passage in many texts."""
    r = random.Random(9)
    v = [f"w{i}" for i in range(3000)]
    base = r.choices(v, k=150)
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(r.randrange(0, 9)):
            w[r.randrange(150)] = r.choice(v)
        rows.append((i, " ".join(w)))
    passage = r.choices(v, k=60)
    rows += [(1000 + i, " ".join(r.choices(v, k=60) + passage)) for i in range(80)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.groups(rows, 4)
    for block in (2000, 16):  # a small block also takes the dealt path
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_dedup.near_duplicates(df, shingle=4).collect()}
        assert got == want


def test_near_duplicates_edges(spark, odd):
    assert near_dedup.near_duplicates(odd.limit(0)).count() == 0
    twice = spark.createDataFrame([(5, "a b c"), (5, "a b c"), (6, "a b c"), (None, "a b c")], "doc_id long, text string")
    columns = ["doc_id", "n_shingles", "component_id", "kept"]
    rows = lambda df: sorted(map(str, map(tuple, near_dedup.near_duplicates(df).select(*columns).collect())))
    assert rows(twice) == sorted(map(str, [(5, 1, 5, True), (5, 1, 5, True), (6, 1, 5, False), (None, 1, 5, False)]))
    # Rows without an id: each text is a document, alike ones are linked, and one text of a group is kept.
    base = [f"w{i}" for i in range(60)]
    nameless = [(None, " ".join(base)), (None, " ".join(base)), (None, " ".join([*base, "end"])), (None, None), (None, "other words"), (8, "x y z")]
    got = near_dedup.near_duplicates(spark.createDataFrame(nameless, "doc_id long, text string")).collect()
    assert len(got) == 6 and [r["component_id"] for r in got if r["doc_id"] == 8] == [8]
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None) and len({r["group"] for r in got}) == 4
    kept = sorted((r["n_shingles"], r["kept"]) for r in got if r["doc_id"] is None)
    assert kept in ([(0, True), (1, True), (56, False), (56, False), (57, True)], [(0, True), (1, True), (56, True), (56, True), (57, False)])


def test_near_duplicates_of_many_repeated_rows(spark):
    """Rows alike are one member of a bucket, so their number costs no more than their rows."""
    r = random.Random(2)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    near = [" ".join([*base[:i], f"e{i}", *base[i + 1 :]]) for i in (5, 50, 150)]
    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.lit(3)).cast("bigint").alias("doc_id"), F.lit(" ".join(base)).alias("text"))
    rows = rows.union(spark.createDataFrame([(10 + i, t) for i, t in enumerate(near)] * 50, "doc_id long, text string"))
    got = near_dedup.near_duplicates(rows.repartition(8)).groupBy("doc_id", "component_id", "kept").count().collect()
    assert {tuple(x) for x in got} == {(3, 3, True, 2000), (None, 3, False, 2000), *((10 + i, 3, False, 50) for i in range(3))}


def test_near_duplicates_of_one_id_with_several_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(3, a), (4, b), (5, a), (5, b + " more"), (5, c), (9, c + " tail"), (9, None)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == [(3, 26, 3), (4, 26, 4), (5, 26, 3), (5, 26, 5), (5, 27, 4), (9, 0, 9), (9, 27, 5)]
    assert len({r["group"] for r in got}) == 4


def test_components(spark):
    edges = [(i, i + 1) for i in range(100) if i % 17] + [(5, 5), (None, 3), (50, 52)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: i for i in range(101)}
    for a, b in sorted((a, b) for a, b in edges if a is not None):
        want = {i: min(want[a], want[b]) if c in (want[a], want[b]) else c for i, c in want.items()}
    assert all(got.get(i, i) == want[i] for i in range(101))


def test_bpe(odd, odd_rows):
    ranks = bpe.read_ranks(RANKS)
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in bpe.encode_decode(odd, RANKS, public_tokenizers.PATTERN).collect()}
    digests = {r["doc_id"]: r for r in bpe.encode_decode(odd, RANKS, public_tokenizers.PATTERN, digests=True).collect()}
    assert len(got) == len(odd_rows)
    for i, t in odd_rows:
        ids = reference.encode_ordinary(t or "")
        raw = np.array(ids, "<u4").tobytes()
        assert bytes(got[i]["ids"]) == raw and bytes(got[i]["decoded"]) == (t or "").encode() and got[i]["n_tokens"] == len(ids)
        assert (digests[i]["ids_sha256"], digests[i]["decoded_sha256"]) == (brute.sha(raw), brute.sha((t or "").encode()))
    assert bpe.encode_decode(odd.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_pieces():
    ranks = bpe.read_ranks(RANKS)
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bp = bpe.BytePairs(RANKS, public_tokenizers.PATTERN, cache_pieces=50)
    for t in ["a" * 30000, "aab" * 900, "".join(random.Random(2).choices("abcdefé", k=1500)), "中文字符没有空格" * 900, "ab" * 700 + "é" * 400, "x" * 255 + " " + "y" * 256 + " " + "qz" * 128, "'s'S 's", "=" * 300, "<|endoftext|>", "\u2003x\u00a0 y\x1c"]:
        assert np.frombuffer(bp.encode([t])[0], "<u4").tolist() == reference.encode_ordinary(t)


def check_substrings(df, rows, window=35):
    want = brute.without_repeats(rows, window)
    got = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(df, window=window).collect()}
    assert len(got) == len(rows)
    for i, (n, gone, kept) in want.items():
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (n, gone, brute.sha(" ".join(kept).encode())), i


def test_substrings(odd, odd_rows):
    check_substrings(odd, odd_rows)


@pytest.mark.parametrize("most, window", [(500, 35), (0, 35), (2, 5), (500, 100), (1, 1)])
def test_substrings_of_periodic_and_overlapping_texts(spark, monkeypatch, most, window):
    monkeypatch.setattr(substring_dedup.repeated_spans, "__defaults__", (35, most))
    r = random.Random(4)
    v = [f"w{i}" for i in range(40)]
    p = r.choices(v, k=80)
    rows = [(0, "a b " * 60), (1, "a " * 34), (2, "a " * 35), (3, "a " * 36), (4, " ".join(p)), (5, " ".join(r.choices(v, k=20) + p[10:50] + r.choices(v, k=20)))]
    rows += [(6 + i, " ".join(r.choices(v, k=5) + p[i : i + 34 + i % 4] + r.choices(v, k=9))) for i in range(30)]
    rows += [(100 + i, " ".join((["x", "y", "z"][: 1 + i % 3]) * 40)) for i in range(6)]
    check_substrings(spark.createDataFrame(rows, "doc_id long, text string"), rows, window)


def test_substrings_of_one_id_with_several_texts(spark):
    p = " ".join(f"w{i}" for i in range(40))
    rows = [(1, "short"), (1, "a b " + p), (1, p + " tail"), (2, p), (2, None)]
    got = substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in got) == [(1, 1, 0), (1, 41, 40), (1, 42, 40), (2, 0, 0), (2, 40, 40)]


def test_substrings_with_text(spark, odd, odd_rows):
    want = brute.without_repeats(odd_rows)
    out = substring_dedup.dedup_substrings(odd, with_text=True)
    assert out.columns == [*odd.columns, "n_words", "n_removed"]
    old = dict(odd_rows)
    for r in out.collect():
        assert r["text"] == (" ".join(want[r["doc_id"]][2]) if want[r["doc_id"]][1] else old[r["doc_id"]]) and r["kept"] == "clash"
    assert substring_dedup.dedup_substrings(odd.limit(0)).count() == 0
    p = " ".join(f"w{i}" for i in range(40))
    rows = spark.createDataFrame([(None, p), (1, p + " tail"), (2, "short"), (2, "short")], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in substring_dedup.dedup_substrings(rows).collect()) == [0, 0, 40, 40]


def test_suffix_automaton():
    r = random.Random(8)
    for _ in range(40):
        seqs = [[r.randrange(3) for _ in range(r.randrange(1, 25))] for _ in range(4)]
        auto = substring_dedup.SuffixAutomaton()
        for s in seqs:
            auto.add(s)
        auto.close()
        text = [r.randrange(3) for _ in range(30)]
        subs = {tuple(s[a:b]) for s in seqs for a in range(len(s)) for b in range(a + 1, len(s) + 1)}
        for at, (_, n) in enumerate(auto.statistics(text)):
            assert n == max((k for k in range(at + 2) if k == 0 or tuple(text[at + 1 - k : at + 1]) in subs), default=0)
        for s in seqs:
            marked = {i for a, n in auto.repeated(s, 4) for i in range(a, a + n)}
            for i in range(len(s) - 3):
                count = sum(x[k : k + 4] == s[i : i + 4] for x in seqs for k in range(len(x) - 3))
                assert (i in marked) == (count > 1)


def test_strip_reference(spark):
    p = [f"p{i}" for i in range(50)]
    docs = spark.createDataFrame([(1, "start " + " ".join(p[5:45]) + " end"), (2, " ".join(p[:34])), (3, None)], "doc_id long, text string")
    ref = spark.createDataFrame([(" ".join(p),), (None,)], "text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.strip_reference(docs, ref).collect()}
    assert got == {1: (42, 40, brute.sha(b"start end")), 2: (34, 0, brute.sha(" ".join(p[:34]).encode())), 3: (0, 0, brute.sha(b""))}


def test_records(spark, odd, odd_rows):
    tok = Tokenizer.from_file(WORDS)
    uri, files, width = records.write_records(odd, WORDS)
    got = {r["doc_id"]: tuple(r)[1:] for r in records.read_records(spark, uri, files, width).collect()}
    start = 0
    for i, t in sorted(odd_rows):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
        start += len(ids)
    assert len(got) == len(odd_rows)
    same = spark.createDataFrame([(7, f"t{i % 5}") for i in range(40)] + [(None, "x")] * 3, "doc_id long, text string")
    got = records.read_records(spark, *records.write_records(same, WORDS)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None] * 3 + [7] * 40 and [b["start"] - a["start"] for a, b in zip(got, got[1:])] == [r["n_tokens"] for r in got[:-1]]
    uri, files, width = records.write_records(odd.limit(0), WORDS)
    assert files == [] and records.read_records(spark, uri, files, width).count() == 0


def encodes_alike(enc, tok, texts):
    flat, at = enc.encode(pa.array(texts))
    assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_word_encoder_equals_whole_texts(odd_rows):
    tok, enc = Tokenizer.from_file(WORDS), records.WordEncoder(WORDS, cache_words=300)
    texts = [t or "" for _, t in odd_rows]
    texts += ["İstanbul Σίσυφος ΣΑΣ. ÀÉÎ, ǅ straße! don't. O'Neil's Aé? x<|endoftext|>y a\u0301b e\u0301. \u00a0nbsp\u00a0 fin", "A" * 3000 + "."]
    for _ in range(2):
        encodes_alike(enc, tok, texts)
        for t in texts:
            encodes_alike(enc, tok, [t])
    assert enc.short


def test_word_encoder_on_random_characters():
    """Marks, capitals, contractions, combining and odd white-space characters in every order."""
    r = random.Random(11)
    tok = Tokenizer.from_file(WORDS)
    parts = [*"aAbTsSdéÉÇñßİıΣσςKǅ.,;:!?'\"-_<>|019²٣中の\u0301\u0307\u00a0\u0085\u2003\x1c\x1f\x0b\n \t×÷…»👍", "'S", "'ll", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>.", "I\u0307", " "]
    for words in (40, 5000):
        enc = records.WordEncoder(WORDS, cache_words=words)
        for _ in range(6):
            encodes_alike(enc, tok, ["".join(r.choices(parts, k=r.randrange(0, 60))) for _ in range(250)])
    encodes_alike(enc, tok, [])


def test_record_frames():
    data = b"".join(map(records.frame, (b"", b"abc", b"x" * 1000)))
    at, out = 0, []
    while at < len(data):
        payload, at = records.unframe(data, at)
        out.append(payload)
    assert out == [b"", b"abc", b"x" * 1000]
    for k in (3, 9, 20, len(data) - 1):
        bad = bytearray(data)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            at = 0
            while at < len(bad):
                _, at = records.unframe(bytes(bad), at)
    with pytest.raises(ValueError):
        records.unframe(data[:10])


def test_lm_prefers_real_text(spark):
    """Held out: real documents score above the same words shuffled; edges give their defined results."""
    import os

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test tables")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    train, held = docs.filter("doc_id % 10 <> 0"), docs.filter("doc_id % 10 = 0").collect()
    r = random.Random(1)
    rows = []
    for x in held:
        w = brute.words(x["text"])
        if len(w) >= 50:
            rows.append((x["doc_id"], x["text"]))
            r.shuffle(w)
            rows.append((-x["doc_id"] - 1, " ".join(w)))
    rows += [(10**9, None), (10**9 + 1, " ")]
    got = {x["doc_id"]: x for x in lm_score.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), training=train).collect()}
    wins = [got[i]["log_likelihood"] > got[-i - 1]["log_likelihood"] for i, _ in rows if 0 <= i < 10**9]
    assert len(wins) > 40 and sum(wins) / len(wins) > 0.75
    assert got[10**9]["log_likelihood"] == 0 and got[10**9 + 1]["mean_log_likelihood"] is None
    assert lm_score.score_documents(docs.limit(0)).count() == 0


def small_network(seed=3, leaves=600):
    r = np.random.default_rng(seed)
    tree = lm_score.Tree.of(r.integers(0, 24, 200), leaves)
    total = r.integers(0, 50, len(tree)).astype(float)
    net = lm_score.WindowNetwork(tree, lm_score.WindowNetwork.start(tree, total))
    net.weights += r.normal(0, 0.2, len(net.weights)).astype(np.float32)
    return r, tree, total, net


def test_lm_tree():
    for n, distinct in ((0, 0), (5, 5), (3000, 10**5)):
        tree = lm_score.Tree.of(np.random.default_rng(1).integers(0, 24, n), distinct)
        assert sorted([*tree.own, *tree.shared]) == list(range(len(tree)))
        sizes = np.diff(tree.first)
        assert (np.repeat(np.arange(len(sizes)), sizes) == tree.class_of).all() and sizes.min() == 1 and sizes.max() <= 2 * max(4, len(tree) ** 0.5)
        assert len(set(tree.class_of[tree.own[: lm_score.FREQUENT]])) == min(n, lm_score.FREQUENT)
    assert len(lm_score.Tree.of(np.zeros(5000, np.int64), 10**6)) > 5 * len(lm_score.Tree.of(np.zeros(5000, np.int64), 10**4))


def test_lm_paths_sum_to_one():
    r, tree, total, net = small_network()
    around = r.integers(0, len(tree) + 1, (3, 4))
    every = np.arange(len(tree))
    for row in around:
        p = np.exp(net.log_probs(np.repeat(row[None], len(tree), axis=0), every).astype(np.float64))
        assert abs(p.sum() - 1) < 1e-4


def test_lm_start_is_the_corpus_frequency():
    r, tree, total, _ = small_network()
    net = lm_score.WindowNetwork(tree, lm_score.WindowNetwork.start(tree, total))
    p = np.exp(net.log_probs(r.integers(0, len(tree), (len(tree), 4)), np.arange(len(tree))))
    assert p == pytest.approx((total + 1) / (total + 1).sum(), rel=1e-3)


def test_lm_gradient_against_differences():
    r, tree, total, net = small_network()
    net.weights = net.weights.astype(np.float64)
    net.parts = net._views(net.weights)
    around, leaf = r.integers(0, len(tree) + 1, (40, 4)), r.integers(0, len(tree), 40)
    dense = [np.zeros(s) for s in net.shapes]
    for k, rows, g in net.gradients(around, leaf):
        dense[k][rows] += g
    flat = np.concatenate([d.ravel() for d in dense])
    touched = np.flatnonzero(flat)
    for i in [*r.choice(touched, 120), *r.integers(0, len(flat), 30)]:
        old, loss = net.weights[i], []
        for step in (1e-5, -1e-5):
            net.weights[i] = old + step
            loss.append(-net.log_probs(around, leaf).mean())
        net.weights[i] = old
        assert (loss[0] - loss[1]) / 2e-5 == pytest.approx(flat[i], abs=1e-7, rel=1e-4)


def test_lm_learns():
    r, tree, total, _ = small_network()
    net = lm_score.WindowNetwork(tree, lm_score.WindowNetwork.start(tree, total))
    around = r.integers(0, len(tree), (600, 4))
    target = around[:, 1]
    before = net.log_probs(around, target).mean()
    for _ in range(150):
        net.train(around, target, 0.05)
    assert net.log_probs(around, target).mean() > 0.3 * before


def lm_corpus():
    r = random.Random(3)
    common = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(r.choices(common, weights=range(60, 0, -1), k=r.randrange(0, 40)) + [f"rare{r.randrange(50)}", f"once{i}x"])) for i in range(120)]
    return rows + [(500, None), (501, ""), (7, rows[7][1]), (None, "w1 w2 neverseen")]


def test_lm_sums_recomputed(spark):
    """Each document's sum again from the weights, one word at a time."""
    rows = lm_corpus()
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, hash string, n int")
    train = df.filter("doc_id is not null")
    for hot in (50, lm_score.HOT):
        v, weights, counts = lm_score.fit(train.select("text", F.col("doc_id").alias("salt")), hot=hot)
        n_of = {x["hash"]: x["n"] for x in counts.collect()}
        net, edge = lm_score.WindowNetwork(v.tree, weights), len(v.tree)
        got = sorted(((-1 if x["doc_id"] is None else x["doc_id"], x["n_words"], x["log_likelihood"]) for x in lm_score.score_documents(df, training=train, hot=hot).collect()))
        want = []
        for i, t in rows:
            w = wordhash.words_of(pa.array([t or ""]))
            leaf, total = v.leaves_of(w)[0], 0.0
            for k in range(len(leaf)):
                at = [leaf[k + d] if 0 <= k + d < len(leaf) else edge for d in (-2, -1, 1, 2)]
                total += float(net.log_probs(np.array([at]), leaf[k : k + 1])[0])
                if leaf[k] not in v.tree.own:
                    n, d = n_of.get(w.hash.view(np.int64)[k]), v.distinct[leaf[k]]
                    total += np.log((n - 0.5 if n else (d / 2 + 1) / (2 * d + 2)) / (v.total[leaf[k]] + 1))
            want.append((-1 if i is None else i, len(leaf), total))
        assert [x[:2] for x in got] == sorted(x[:2] for x in want)
        assert [x[2] for x in got] == pytest.approx([x[2] for x in sorted(want)], rel=1e-5, abs=1e-4)
        assert v.total.sum() == sum(len(brute.words(t)) for i, t in rows if i is not None)


def test_lm_does_not_depend_on_partitions(spark):
    """Several shards, rows dealt and ordered differently: the same weights and scores."""
    df = spark.createDataFrame([x for x in lm_corpus() if x[0] is not None], "doc_id long, text string")
    fits = [lm_score.fit(d.select("text", F.col("doc_id").alias("salt")), shard_words=900) for d in (df.repartition(3, "text"), df.orderBy(F.col("doc_id").desc()).coalesce(1))]
    assert np.array_equal(fits[0][1], fits[1][1])


def test_lm_counts_words_exactly(spark):
    """Rare words have their own counts, however many words share their form; the model grows."""
    r = random.Random(3)
    w = lambda i: "".join(chr(97 + int(c)) for c in f"{i:09d}")
    twice, once = [w(i) for i in range(30000)], [w(10**8 + i) for i in range(30000)]
    pool = twice + twice + once
    r.shuffle(pool)
    train = spark.createDataFrame([(" ".join(pool[i : i + 100]), 0) for i in range(0, len(pool), 100)], "text string, salt int")
    counts = lm_score.corpus_counts(train)
    assert {tuple(x) for x in counts.groupBy("n").count().collect()} == {(1, 30000), (2, 30000)}
    rows = [(i, twice[i]) for i in range(100)] + [(1000 + i, once[i]) for i in range(100)] + [(2000 + i, w(5 * 10**8 + i)) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (64, lm_score.HOT):
        got = {x["doc_id"]: x["log_likelihood"] for x in lm_score.score_documents(df, training=train.select("text"), hot=hot).collect()}
        mean = [sum(got[k + i] for i in range(100)) / 100 for k in (0, 1000, 2000)]
        assert mean[0] > mean[1] + 0.9 and mean[1] > mean[2] + 0.3


def test_repeated_rows_of_one_id(spark):
    """Ten thousand rows of one id and text, as many without an id, and texts that share a passage with them: all
    are judged, and their number costs no more than their rows."""
    r = random.Random(12)
    text = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    one, none, alone = text(400), text(400), text(300)
    half = " ".join(one.split(" ")[100:200]) + " " + text(50)
    rows = spark.range(10_000).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit(one).alias("text"))
    rows = rows.union(spark.range(10_000).select(F.lit(None).cast("bigint"), F.lit(none)))
    rows = rows.union(spark.createDataFrame([(1, alone), (2, half), (7, text(80))], "doc_id long, text string"))
    got = substring_dedup.dedup_substrings(rows.repartition(8)).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert {tuple(x) for x in got} == {(7, 400, 400, 10_000), (None, 400, 400, 10_000), (1, 300, 0, 1), (2, 150, 100, 1), (7, 80, 0, 1)}
