"""Fingerprints, URL filters, quality rules, sharding, packing."""

import bisect
import itertools
import random
import struct
from collections import defaultdict

import brute
import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import common as C
from tessella.llm import fingerprint as P
from tessella.llm import packing, quality, sharding, url_filter


def test_fingerprints_of_edits(odd, odd_rows):
    got = {r["doc_id"]: r for r in P.fingerprint_edits(odd).collect()}
    order = sorted(odd_rows, key=lambda x: -x[0])
    assert len(got) == len(order)
    for k, (i, t) in enumerate(order):
        t, u = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == brute.sha(edited.encode()), i
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if edited == t:
            assert r["near_edited"] == 1 and r["fingerprint"] == r["edited_fingerprint"]
    assert len({got[i]["fingerprint"] for i in range(10, 14)}) == 1
    text, after = (next(t for j, t in order if j == 60), next(t for j, t in order if j < 60))
    five = lambda t: {tuple(brute.words(t)[k : k + 5]) for k in range(len(brute.words(t)) - 4)}
    a, b = five(text), five(text[: len(text) - len(text) // 2] + after[: len(text) // 2])
    assert got[60]["near_edited"] == pytest.approx(len(a & b) / len(a | b), abs=0.05) and got[60]["near_next"] < 0.05
    assert got[0]["fingerprint"] == got[2]["fingerprint"] == "" and got[3]["fingerprint"] != ""


def test_sketches_merge(spark):
    rows = spark.createDataFrame([("a b c d e f g h i j " * 3 + "k l m", "n o p q r s t u"), ("x", "y"), ("x", ""), ("", "")], "a string, b string")
    df = P.with_sketch(P.with_sketch(rows, "a", "p"), "b", "q")
    for r in df.select("p", "q", P.merge(F.col("p"), F.col("q")).alias("m"), P.likeness(F.col("p"), F.col("p")).alias("l")).collect():
        low = sorted(x for x in {*r["p"], *r["q"]} if x < 1 << P.KEPT_BITS)
        assert r["m"] == (low or sorted({*r["p"], *r["q"]})[:1]) and r["l"] == 1


def test_fingerprint_one_and_none(spark, odd):
    assert P.fingerprint_edits(odd.limit(0)).count() == 0
    r = P.fingerprint_edits(spark.createDataFrame([(7, "abcd")], "doc_id long, text string")).first()
    assert r["edited_sha256"] == brute.sha(b"abab") and r["near_next"] == 1
    twice = spark.createDataFrame([(1, "aa bb"), (1, "aa bb"), (None, "cc")], "doc_id long, text string")
    assert P.fingerprint_edits(twice).count() == 3


URLS = [
    None, "", "no scheme", "http://a.net/", "http://NET/x", "http://x.net", "http://xnet/", "https://m.Example.NET/en/1?x#y", "http://example.net/EN/", "http://example.com/de/", "http://a.example.com/de",
    "http://org/fr/a/../b", "ftp://u:p@www.org/fr/?q", "http://org/en/", "http://a.net?x=/en/", "http://example.net#f", "x://y://b.net/", "http:///path", "http://.net/", "http://net./", "http://a.example.net/en/z/", "http://q.org\n/fr/",
]


def test_url_filters(spark):
    rows = [(i, u, "mine", "h") for i, u in enumerate(URLS * 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string, host string")
    got = {r["page_id"]: r for r in url_filter.filter_urls(df).collect()}
    assert len(got) == len(rows)
    for i, u, *_ in rows:
        host, path, rule, verdict = brute.url(u)
        r = got[i]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow"), u
    assert url_filter.filter_urls(df.limit(0)).count() == 0
    assert url_filter.filter_urls(df, rules=[], default="deny").filter("verdict = 'deny' and rule is null").count() == len(rows)
    odd_rule = [url_filter.Rule("block", "example.com", "/d"), url_filter.Rule("allow", "a.example.com", "/de")]
    r = url_filter.filter_urls(df, odd_rule).filter("url = 'http://a.example.com/de'").first()
    assert (r["rule"], r["verdict"]) == ("a.example.com/de", "allow")


def test_quality_rules(odd, odd_rows):
    got = {r["doc_id"]: r for r in quality.judge(odd).collect()}
    assert len(got) == len(odd_rows)
    for i, t in odd_rows:
        want = brute.rules(t)
        assert {k: got[i][k] for k in want} == want, i
        assert not (got[i]["kept"] and got[i]["base_failed"])
    assert quality.judge(odd.limit(0)).count() == 0
    assert "text" in quality.judge(odd, keep_text=True).columns


def test_bad_host_goes(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, good if i % 20 else "bad", "good", 0) for i in range(400)] + [(1000 + i, "bad" if i % 10 else good, "bad", 0) for i in range(200)] + [(5000, "bad", "tiny", 0), (5001, good, "tiny", 0)]
    out = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string, n long"))
    kept = {r["doc_id"]: r["kept"] for r in out.collect()}
    assert all(kept[i] for i in range(400) if i % 20) and not any(kept[1000 + i] for i in range(200)) and kept[5001]


def test_sharding(odd, odd_rows):
    for shards in (1, 3, 8):
        rows = sharding.shard(odd, shards).collect()
        assert len(rows) == len(odd_rows)
        want = {i: (len((t or "").encode()) + 1, brute.crc((t or "").encode())) for i, t in odd_rows}
        slots = defaultdict(list)
        for r in rows:
            assert (r["size"], r["text_crc32"]) == want[r["doc_id"]]
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    assert sharding.shard(odd.limit(0)).count() == 0


def test_sharding_splits_only_large_groups(spark):
    rows = [(i, f"text {i} " + "x" * (i % 50)) for i in range(4000)] + [(10_000 + i, "copy " * 20) for i in range(2000)] + [(None, "no id"), (None, "no id")]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    sizes, where = defaultdict(int), defaultdict(set)
    texts = dict(rows)
    for r in got:
        sizes[r["shard"]] += r["size"]
        where[texts[r["doc_id"]]].add(r["shard"])
    mean = sum(sizes.values()) / 8
    assert len(got) == len(rows) and len(sizes) == 8 and max(sizes.values()) <= 1.06 * mean and min(sizes.values()) >= 0.94 * mean
    assert all(len(s) == 1 for t, s in where.items() if not t.startswith("copy"))
    assert len({(r["shard"], r["slot"]) for r in got}) == len(rows)


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_boundaries_are_optimal(k):
    lengths, counts = [1, 3, 4, 9, 10, 25, 26], [5, 1, 7, 2, 2, 9, 1]

    def padding(bounds):
        return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts))

    best = min(padding([*s, lengths[-1]]) for n in range(k) for s in itertools.combinations(lengths[:-1], n))
    got = packing.choose_boundaries(lengths, counts, k)
    assert got[-1] == lengths[-1] and len(got) <= k and padding(got) == best
    assert packing.choose_boundaries([], [], k) == []


def test_packing(odd, odd_rows):
    rows = packing.pack(odd, buckets=5, budget=300).collect()
    assert len(rows) == len(odd_rows)
    n = {i: len(brute.words(t)) for i, t in odd_rows}
    batches = defaultdict(list)
    for r in rows:
        assert r["n_tokens"] == n[r["doc_id"]] <= r["boundary"] and r["padding"] == r["boundary"] - r["n_tokens"]
        batches[r["batch"]].append(r)
    assert sorted(batches) == list(range(len(batches)))
    last = {}
    for b in sorted(batches):
        rs = batches[b]
        assert len({r["boundary"] for r in rs}) == 1 and sorted(r["place"] for r in rs) == list(range(len(rs)))
        assert len(rs) == 1 or rs[0]["boundary"] * len(rs) <= 300
        last.setdefault(rs[0]["boundary"], []).append(len(rs))
    assert all(len(set(s[:-1])) <= 1 for s in last.values())
    assert packing.pack(odd.limit(0)).count() == 0


def test_boundaries_of_many_lengths_are_optimal():
    """Against the plain quadratic recurrence, on lengths far apart and counts far apart."""
    r = random.Random(6)
    for n, k in ((40, 6), (120, 16), (7, 9), (1, 3)):
        lengths = sorted(r.sample(range(10**7), n))
        counts = [r.choice([1, 2, 50, 10**6]) for _ in lengths]
        best = [0] + [float("inf")] * n
        for _ in range(min(k, n)):
            best = [0] + [min(best[i] + sum(counts[j] * (lengths[e - 1] - lengths[j]) for j in range(i, e)) for i in range(e)) for e in range(1, n + 1)]
        bounds = packing.choose_boundaries(lengths, counts, k)
        assert len(bounds) <= k and bounds[-1] == lengths[-1]
        assert sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts)) == best[n]


def h64(x, seed=42):
    """Spark's xxhash64 of a text, or of a hash after another one."""
    return xxhash.xxh64_intdigest(x, seed)


def sketch(text):
    """The kept hashes of a text, without Spark."""
    w = [h64(x.encode()) for x in brute.words(text)]
    hashes = set()
    for i in range(len(w) - 4 if len(w) >= 5 else min(1, len(w))):
        h = 42
        for x in w[i : i + 5]:
            h = h64(struct.pack("<Q", x), h)
        hashes.add(h % P._SPACE)
    return sorted(x for x in hashes if x < 1 << P.KEPT_BITS) or sorted(hashes)[:1]


def test_fingerprints_recomputed(odd, odd_rows):
    got = {r["doc_id"]: r for r in P.fingerprint_edits(odd).collect()}
    order = sorted(odd_rows, key=lambda x: -x[0])
    like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)

    def union(a, b):
        low = {x for x in {*a, *b} if x < 1 << P.KEPT_BITS}
        return low or set(sorted({*a, *b})[:1])

    for k, (i, t) in enumerate(order):
        t, u = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        own, edited, after = sketch(t), sketch(t[: len(t) - half] + u[:half]), sketch(u)
        text = lambda s: ",".join(f"{x:x}" for x in s)
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (text(own), text(edited)), i
        for name, other in (("near_edited", edited), ("near_next", after)):
            both = union(own, other)
            assert got[i][name] == pytest.approx(len(set(own) & set(other)) / len(both) if both else 1.0)
    assert like(set(), set()) == 1.0


def test_containment_of_short_and_long_texts(spark):
    """A short text held by a long one is held wholly or, where all its hashes are above the threshold, unknown."""
    words = [f"w{i}" for i in range(3000)]
    rows = [(" ".join(words[i : i + 5]), " ".join(words)) for i in range(0, 200, 5)] + [(" ".join(words[i : i + 60]), " ".join(words)) for i in range(0, 600, 60)] + [("a b c", "a b c"), ("", "x")]
    df = P.with_sketch(P.with_sketch(spark.createDataFrame(rows, "a string, b string"), "a", "p"), "b", "q")
    held = [r["c"] for r in df.select(P.containment(F.col("p"), F.col("q")).alias("c")).collect()]
    assert set(held[:40]) == {1.0, None} and held[:40].count(1.0) in range(3, 22) and held[40:] == [1.0] * 12
    back = [r["c"] for r in df.select(P.containment(F.col("q"), F.col("p")).alias("c")).collect()]
    assert all(x < 0.1 for x in back[:40])


def test_ranges_beyond_a_literal_list(spark):
    from tessella.llm.common import range_bounds, with_range

    r = random.Random(2)
    for n in (0, 1, 255, 256, 257, 1000):
        bounds = sorted(r.sample(range(-5000, 5000), n))
        rows = with_range(spark.range(-5100, 5100, 7), bounds, "id", "at").collect()
        assert all(x["at"] == bisect.bisect_right(bounds, x["id"]) for x in rows) and len(rows) == 1458
    cuts = range_bounds(spark.range(100_000).select((F.col("id") * 3).alias("k")), "k", 20)
    sizes = with_range(spark.range(100_000).select((F.col("id") * 3).alias("k")), cuts, "k", "at").groupBy("at").count().collect()
    assert len(sizes) == 20 and max(x["count"] for x in sizes) < 2 * 5000
    assert range_bounds(spark.range(0).withColumnRenamed("id", "k"), "k", 9) == []


def test_shards_recomputed(odd, odd_rows):
    """Keys are hashes of texts; shards are ranges of (key, id), slots the places in them."""
    for shards in (3, 8):
        got = {r["doc_id"]: r for r in sharding.shard(odd, shards).collect()}
        key = {i: h64((t or "").encode()) >> 2 for i, t in odd_rows}
        order = sorted(key, key=lambda i: (key[i], i))
        numbers = [got[i]["shard"] for i in order]
        assert numbers == sorted(numbers)
        seen = defaultdict(int)
        for i in order:
            assert got[i]["slot"] == seen[got[i]["shard"]], i
            seen[got[i]["shard"]] += 1
        # Each boundary is the nearest to its target that lies between two texts.
        size, total, ends = 0, sum(r["size"] for r in got.values()), [0]
        for a, b in zip(order, [*order[1:], None]):
            size += got[a]["size"]
            if b is None or key[a] != key[b]:
                ends.append(size)
        below = [sum(r["size"] for r in got.values() if r["shard"] < s) for s in range(1, shards)]
        for s, b in enumerate(below, 1):
            nearest = min(abs(e - total * s / shards) for e in ends)
            assert abs(b - total * s / shards) <= nearest + 0.01 * total / shards


def test_sharding_with_odd_names_and_ids(spark):
    rows = [(-5, "a"), (-5, "a"), (None, "a"), (3, None), (0, "")]
    out = sharding.shard(spark.createDataFrame(rows, "`the id` long, `my text` string"), 2, "the id", "my text").collect()
    assert len(out) == 5 and len({(r["shard"], r["slot"]) for r in out}) == 5
    hot = spark.createDataFrame([(i - 500, "same text") for i in range(1000)] + [(None, "same text")], "doc_id long, text string")
    got = sharding.shard(hot, 4).collect()
    assert len(got) == 1001 and max(sum(r["shard"] == s for r in got) for s in range(4)) <= 263
    assert next(r for r in got if r["doc_id"] is None)["shard"] == 0 and {r["shard"] for r in got if r["doc_id"] == 499} == {3}


def test_url_filters_keep_columns_whatever_their_names(spark):
    df = spark.createDataFrame([("http://b.net/x", "v", "r", 1, "p")], "url string, __verdict string, __rest string, c0 int, prefix string")
    r = url_filter.filter_urls(df).first().asDict()
    assert r == {"url": "http://b.net/x", "__verdict": "v", "__rest": "r", "c0": 1, "prefix": "p", "host": "b.net", "path": "/x", "rule": "net/", "verdict": "block"}


def test_url_rules_without_a_slash(spark):
    df = spark.createDataFrame([("http://example.comde/",), ("http://example.com/de/x",), ("http://example.com",)], "url string")
    got = [r["verdict"] for r in url_filter.filter_urls(df, [url_filter.Rule("block", "example.com", "de/")]).collect()]
    assert got == ["allow", "block", "allow"]
    with pytest.raises(ValueError):
        url_filter.filter_urls(df, [url_filter.Rule("block", ".".join("a" * (1 + i % 150)), "/" + "x" * i) for i in range(150)])


def test_quality_keeps_columns_whatever_their_names(spark):
    df = spark.createDataFrame([(1, "a b c", None, True, "x", 2)], "doc_id long, text string, source string, host_ok boolean, __words string, __host int")
    r = quality.judge(df).first().asDict()
    assert (r["host_ok"], r["__words"], r["__host"], r["n_words"], r["kept"]) == (True, "x", 2, 3, False)


def test_long_texts_and_texts_without_spaces(spark):
    long = " ".join(f"w{i % 5000}" for i in range(30_000))
    df = spark.createDataFrame([(1, long, "s"), (2, "x" * 200_000, "s"), (3, "\n" * 50_000, "s")], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality.judge(df).collect()}
    assert [got[i]["n_words"] for i in (1, 2, 3)] == [30_000, 1, 0] and got[1]["n_repeat_words"] == brute.rules(long)["n_repeat_words"]
    assert {r["doc_id"]: r["n_tokens"] for r in packing.pack(df).collect()} == {1: 30_000, 2: 1, 3: 0}
    prints = {r["doc_id"]: r for r in P.fingerprint_edits(df).collect()}
    assert prints[1]["n_chars"] == len(long) and prints[3]["fingerprint"] == ""
    assert sharding.shard(df, 3).count() == 3


def test_many_rows_alike_are_spread(spark):
    """Most rows have no id and one text: batches are full and slots gapless all the same, and rows alike are dealt by where
    they were read; other rows keep their places whatever the partitions."""
    rows = [(None, "same few words")] * 3000 + [(None, f"other {i}") for i in range(40)] + [(i, f"text {i} more") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (7, 2):
        packed = packing.pack(df.repartition(parts), buckets=2, budget=30).collect()
        batches = defaultdict(list)
        for r in packed:
            batches[r["batch"]].append(r["place"])
        assert len(packed) == len(rows) and all(sorted(p) == list(range(len(p))) for p in batches.values()) and sorted(batches) == list(range(len(batches)))
        cut = sharding.shard(df.repartition(parts), 4).collect()
        slots = defaultdict(list)
        for r in cut:
            slots[r["shard"]].append(r["slot"])
        assert len(cut) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    part = spark.createDataFrame([(i, i % 5, i % 3) for i in range(90)] + [(500, 9, 1)], "n int, like long, __part int")
    got = {r["n"]: r["__sub"] for r in C.spread_alike(part, "like", 10).collect()}
    assert got[500] == 0 and all(got[i] == i % 3 + 1 for i in range(90))
