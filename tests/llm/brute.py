"""Plain Python versions of what the operators return."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def shingles(text, n):
    w = words((text or "").translate(LOWER))
    if len(w) < n:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def groups(rows, n, percent=80):
    """id -> (set size, smallest id reachable)."""
    sets = {i: shingles(t, n) for i, t in rows}
    meets, common = defaultdict(list), Counter()
    for i, s in sets.items():
        for g in s:
            meets[g].append(i)
    for ids in meets.values():
        for k, a in enumerate(ids):
            for b in ids[:k]:
                common[b, a] += 1
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), c in common.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def without_repeats(rows, window=35):
    """id -> (words, removed, kept words)."""
    all_words = [(i, words(t)) for i, t in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in all_words for k in range(len(w) - window + 1))
    out = {}
    for i, w in all_words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out[i] = (len(w), sum(gone), [x for x, g in zip(w, gone) if not g])
    return out


def rules(text):
    w = words(text)
    t = text or ""
    lines = [x for x in t.split("\n") if WORD.search(x)]
    wins = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    twice = set()
    for k in range(len(w) - 4):
        if wins[tuple(w[k : k + 5])] > 1:
            twice.update(range(k, k + 5))
    n = len(w)
    failed = n < 10 or 100 * len(twice) > 20 * n
    return {"n_words": n, "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(twice), "base_failed": failed}


def url(u):
    if u is None or "://" not in u:
        return "", "", None, None
    rest = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(LOWER)
    fits = [(v, h, p) for v, h, p in (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda x: len(x[1]) + len(x[2]), default=None)
    return host, path, best and best[1] + best[2], best and best[0]


def sha(b):
    return hashlib.sha256(b).hexdigest()


def crc(b):
    return zlib.crc32(b)
