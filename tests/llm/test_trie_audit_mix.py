"""Prefix trie, source audit and mixing against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from math import exp, log

import brute
import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import mixing, prefix_trie, source_audit

TURNS = "conv_id long, turn long, role string, text string, depth string, n long"


def trie(rows, shared):
    """What the trie's rows must be, from (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    seq = dict(own)
    if shared:
        for c, v in own.items():
            h = zlib.crc32(str(c).encode()) % 9
            base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
            seq[c] = own.get(base, [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in sorted(seq.items()):
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    out = {}
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(len(z) == len(q) + 1 and z[: len(q)] == q for z in below)]
        ends = ",".join(str(c) for c in m if len(seq[c]) == len(p))
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        out[m[0], len(p)] = (members[p[:-1]][0] if p else None, len(m), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def as_dict(df):
    rows = df.collect()
    out = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in rows}
    assert len(out) == len(rows)
    return out


def some_turns(seed, convs, longest, words=3):
    r = random.Random(seed)
    rows = []
    for c in convs:
        for t in range(r.randrange(longest + 1)):
            rows.append((c, r.choice([t, t, t, None]), r.choice(["user", "assistant", None]), r.choice(["é", "ab", "", None, "x" * 40][:words])))
    return rows


def test_trie_of_odd_conversations(spark, seed=1):
    """Null and repeated turns, null roles and texts, copies, negative and missing ids, rows without an id."""
    rows = some_turns(seed, [*range(-7, 40), 1000], 9, 2 + seed) + [(None, 1, "user", "lost"), (3, 2, "user", "twice"), (3, 2, "user", "twice"), (3, 2, "user", "other")]
    df = spark.createDataFrame([(*x, "clash", -1) for x in rows], TURNS)
    assert as_dict(prefix_trie.shared_heads_trie(df)) == trie(rows, True)
    assert as_dict(prefix_trie.conversation_trie(df)) == trie(rows, False)


def test_trie_in_blocks_and_pieces(spark, monkeypatch):
    """Conversations of several blocks, each the start of the next one, and ids in several pieces."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    rows = [(c, t, "user", f"t{t}") for c in range(20) for t in range(c)] + [(100 + c, t, "user", f"t{t}") for c in range(30) for t in range(11)]
    rows += [(200, t, "user", "odd" if t == 10 else f"t{t}") for t in range(25)]
    df = spark.createDataFrame([(*x, "", 0) for x in rows], TURNS).repartition(5)
    assert as_dict(prefix_trie.conversation_trie(df)) == trie(rows, False)


def test_trie_of_little(spark):
    none = spark.createDataFrame([], TURNS)
    assert prefix_trie.shared_heads_trie(none).count() == 0 and prefix_trie.conversation_trie(none).count() == 0
    # crc32("1") % 9 is 0 and crc32("3") % 9 is 3: conversation 3 loses its two turns to the missing conversation 0.
    rows = [(c, t, "user", "a") for c in (3,) for t in range(2)]
    h = zlib.crc32(b"3") % 9
    got = as_dict(prefix_trie.shared_heads_trie(spark.createDataFrame([(*x, "", 0) for x in rows], TURNS)))
    assert got == trie(rows, True)
    if h >= 2:
        assert list(got) == [(3, 0)] and got[3, 0][3] == 1


def test_trie_with_a_hot_group(spark):
    """A third of the conversations are copies, and their ids make one digest."""
    rows = [(c, t, "user", f"hot{t}") for c in range(0, 1500, 3) for t in range(4)] + [(c, t, "user", f"{c}") for c in range(1500) if c % 3 for t in range(2)]
    df = spark.createDataFrame([(*x, "", 0) for x in rows], TURNS)
    got = as_dict(prefix_trie.conversation_trie(df))
    ids = ",".join(map(str, range(0, 1500, 3)))
    assert got[0, 4] == (0, 500, 0, 1, 499 * 4, hashlib.sha256(ids.encode()).hexdigest())
    assert got[0, 0][1:4] == (1500, 1001, 1001)


def audit(rows, least=30, top=50):
    """{(lang, source, part): [(item, value), ...]} from (text, lang, source), with whole numbers."""
    docs = defaultdict(Counter)
    counts, langs = defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        langs[lang].add(source)
        found = [x.translate(brute.LOWER) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        docs[lang].update(set(found))
        counts[lang, source].update(found)
    out = {}
    for lang, sources in langs.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        v = len(kept)

        def share(c, kept=kept, v=v):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * v) for t in kept}

        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})
        q = share(whole)
        p = {s: share(counts[lang, s]) for s in sources}
        for s in sources:
            pair = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            term = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, items, most in (("pair", pair, None), ("term", term, top)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                if items:
                    out[lang, s, part] = items
    return out


def audited(df):
    out = defaultdict(dict)
    for r in df.collect():
        assert r["rank"] not in out[r["lang"], r["source"], r["part"]]
        out[r["lang"], r["source"], r["part"]][r["rank"]] = (r["item"], r["value"])
    return {k: [v[i] for i in range(1, len(v) + 1)] for k, v in out.items()}


@pytest.mark.parametrize("least,top", [(3, 5), (1, 50), (30, 50)])
def test_audit(spark, monkeypatch, least, top):
    """Nulls, empty and very long texts, other scripts, repeated rows, sources without terms, clashing columns;
    slices of a few bytes and few held counts, so that runs and terms cross all borders."""
    monkeypatch.setattr(source_audit, "HELD", 40)
    monkeypatch.setattr(source_audit, "BYTES", 300)
    monkeypatch.setattr(source_audit, "PAIRS", 3)
    r = random.Random(least)
    vocabulary = ["The", "the", "ÉTÉ", "été", "don't", "中文", "x1y", "\U0001f600", "Zz", "q", "straße", "AB-CD", "_a_", "K"]
    rows = []
    for i in range(400):
        lang = r.choice(["de", "fr", "fr", None, ""])
        source = r.choice(["a", "b", "B", None, "ü", "c"])
        rows.append((" ".join(r.choices(vocabulary[: 3 + len(source or "") * 4 + i % 9], k=r.randrange(12))), lang, source))
    rows += [(None, "de", "none"), ("", "xx", "alone"), ("12 34", "yy", "p"), (None, "yy", "q"), ("long word " * 4000, "fr", "a")] + [("same text", "fr", "c")] * 50
    df = spark.createDataFrame([(*x, 1, "clash") for x in rows], "text string, lang string, source string, rank int, term string").repartition(7)
    assert audited(source_audit.audit_sources(df, least_docs=least, top=top)) == audit(rows, least, top)
    assert source_audit.audit_sources(df.limit(0)).count() == 0


def test_counts_of_slices():
    """Terms of slices that begin anywhere in a large batch."""
    r = random.Random(3)
    texts = ["".join(r.choice("Aé中\U0001f600b -1\n") for _ in range(r.randrange(400))) for _ in range(6000)]
    whole = pa.array(texts)
    for start, n in ((0, 500), (1000, 1000), (4321, 1500)):
        group = np.array([i % 3 for i in range(n)])
        terms, groups, docs, count = source_audit._count(whole.slice(start, n), group)
        want, seen = Counter(), Counter()
        for i, t in enumerate(texts[start : start + n]):
            found = [x.translate(brute.LOWER) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]
            want.update((x, i % 3) for x in found)
            seen.update((x, i % 3) for x in set(found))
        keys = list(zip(terms.to_pylist(), groups.tolist()))
        assert dict(zip(keys, count.tolist())) == want and dict(zip(keys, docs.tolist())) == seen and len(keys) == len(want)


def test_keys_of_one_hash_are_told_apart():
    """Two terms with one hash, interleaved, and runs over several batches."""
    rows = [(1, "de", "a", "s", 1, 2), (1, "de", "b", "s", 1, 1), (1, "de", "a", "s", 2, 3), (2, "fr", "c", "s", 1, 1), (2, "fr", "c", "s", 4, 4), (3, "fr", "d", "t", 1, 1)]
    names = ["h", "lang", "term", "source", "docs", "count"]
    for size in (1, 2, 6):
        batches = pa.Table.from_pylist([dict(zip(names, r)) for r in rows]).to_batches(max_chunksize=size)
        out = [tuple(r.values()) for b in source_audit._source_counts(iter(batches)) for r in b.to_pylist()]
        assert sorted(out) == [("de", "a", "s", 3, 5), ("de", "b", "s", 1, 1), ("fr", "c", "s", 5, 5), ("fr", "d", "t", 1, 1)]
        kept = [r["term"] for b in source_audit._frequent(3)(iter(batches)) for r in b.to_pylist()]
        assert sorted(kept) == ["a", "a", "c", "c"]


MIXED = "doc_id long, text string, source string, size string, rate string"


def targets(sizes):
    """Targets by repeated sharing, as fractions; sizes by source in order."""
    w = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    total, stopped = sum(sizes), set()
    while True:
        left = total - 3 * sum(sizes[i] for i in stopped)
        weight = sum(w[i] for i in range(len(w)) if i not in stopped)
        share = Fraction(left, weight) if weight else 0
        more = {i for i in range(len(w)) if i not in stopped and w[i] * share > 3 * sizes[i]}
        if not more:
            return [3 * sizes[i] if i in stopped else w[i] * share for i in range(len(w))]
        stopped |= more


def check_mix(rows, got):
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
    names = sorted((s for s in by if s is not None)) + ([None] if None in by else [])
    sizes = [sum(r["size"] for r in by[s]) for s in names]
    want = Counter()
    for i, t, s in rows:
        want[i, len(brute.words(t)), s] += 1
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in got) == want
    for s, size, target in zip(names, sizes, targets(sizes)):
        rates = [(r["size"], r["rate"]) for r in by[s] if r["size"]]
        assert all(r["source_size"] == size and r["target"] == pytest.approx(float(target), rel=1e-12) for r in by[s])
        if not size:
            continue
        # The rates meet the target, and are exponential in the size up to the cap.
        assert sum(a * b for a, b in rates) == pytest.approx(float(target), rel=1e-6)
        slopes = [log(b) / a for a, b in rates if b < 3 * (1 - 1e-9)]
        assert max(slopes, default=0) - min(slopes, default=0) < 1e-9 and all(b <= 3 + 1e-9 for _, b in rates)
        if slopes:
            assert all(exp(min(700, slopes[0] * a)) > 3 - 1e-6 for a, b in rates if b >= 3 * (1 - 1e-9))
        taken = sum(r["taken"] for r in by[s])
        left = [r["size"] for r in by[s] if r["size"] and r["copies"] < 3]
        assert taken <= float(target) + 1e-6
        assert float(target) - taken <= max(1, min(left, default=1), 0.02 * float(target)), (s, target, taken)


def test_mix(spark):
    r = random.Random(8)
    rows = []
    for s, n in (("a", 300), ("B", 40), ("ü", 200), ("中", 150), ("\U0001f600", 90), (None, 120), ("tiny", 12)):
        rows += [(r.randrange(10**6), " ".join(["w"] * int(1 + r.expovariate(1 / 60))), s) for _ in range(n)]
    rows += [(1, None, "a"), (2, "", "a"), (3, " \n", "empty"), (None, "x " * 30000, "a"), (None, None, None)] + [(None, "same words here", "ü")] * 400
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, "clash", "y") for x in rows], MIXED)
    got = mixing.mix(df.repartition(6)).collect()
    check_mix(rows, got)
    again = mixing.mix(df.orderBy("text").coalesce(2)).collect()
    assert Counter(map(repr, got)) == Counter(map(repr, again))


def test_mix_of_little(spark):
    one = spark.createDataFrame([(1, "a b c", "s", "", "")], MIXED)
    assert mixing.mix(one.limit(0)).count() == 0
    r = mixing.mix(spark.createDataFrame([(1, None, None, "", "")], MIXED)).first()
    assert (r["size"], r["source_size"], r["target"], r["taken"]) == (0, 0, 0.0, 0)
    two = spark.createDataFrame([(1, "a " * 10, "p", "", ""), (2, "a " * 1000, "q", "", "")], MIXED)
    got = {r["doc_id"]: r for r in mixing.mix(two).collect()}
    assert got[1]["target"] == 30 and got[1]["taken"] == 30 and got[2]["target"] == 980


def test_mix_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    rows = [(i, "w " * (1 + i % 37), f"s{i % 4}") for i in range(400)]
    check_mix(rows, mixing.mix(spark.createDataFrame([(*x, "", "") for x in rows], MIXED)).collect())


def test_mix_of_many_alike(spark):
    """One text is most of a source: its rows get different numbers of copies."""
    rows = [(None, "one two three", "hot")] * 900 + [(i, "w " * 50, "cold") for i in range(300)]
    got = mixing.mix(spark.createDataFrame([(*x, "", "") for x in rows], MIXED).repartition(8)).collect()
    check_mix(rows, got)
    hot = [r["copies"] for r in got if r["source"] == "hot"]
    assert sum(hot) * 3 == sum(r["taken"] for r in got if r["source"] == "hot")
