"""Scans along orders, nearest in time, boxes on grids, star clusters in rounds, overlapping sets, pruned products."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.operators import graph as G
from tessella.operators import sets as K
from tessella.operators import similarity as M
from tessella.operators import stars as S
from tessella.operators import sweep


def timed(seed, n, groups=("a", "b", None), most=60):
    r = random.Random(seed)
    return [(i, "hot" if r.random() < 0.4 else r.choice(groups), r.choice([None, *[r.randrange(most)] * 20])) for i in range(n)]


def test_before_carries_over_partitions(spark):
    rows = [(i, "hot" if i % 3 else f"g{i % 7}", (i * 7919) % 3001, i % 5 if i % 11 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, g string, t int, v int").repartition(7)
    got = {r["k"]: (r["x"], r["s"]) for r in sweep.before(df, ["g"], [F.col("t")], "x", last=F.col("v")).join(sweep.before(df, ["g"], [F.col("t")], "s", total=F.coalesce("v", F.lit(0))).select("k", "s"), "k").collect()}
    last, total = {}, {}
    for k, g, t, v in sorted(rows, key=lambda x: x[2]):
        assert got[k] == (last.get(g), total.get(g, 0)), k
        if v is not None:
            last[g] = v
        total[g] = total.get(g, 0) + (v or 0)


@pytest.mark.parametrize("width", [0, 25])
def test_anchors_by_doubling(spark, width):
    rows = timed(width, 300, most=400 if width else 60)
    want = {}
    for g in {x[1] for x in rows} - {None}:
        start = None
        for t in sorted({x[2] for x in rows if x[1] == g and x[2] is not None}):
            if start is None or t - start > width:
                start = t
            want[g, t] = start
    got = sweep.marks(spark.createDataFrame(rows, "k int, g string, t int").repartition(5), "g", "t", width).collect()
    assert {(r["g"], r["t"]): r["anchor"] for r in got} == want and len(got) == len(want)
    assert sweep.marks(spark.createDataFrame([], "k int, g string, t int"), "g", "t", width).count() == 0


@pytest.mark.parametrize("cap,width", [(1, 5), (4, 1000), (200, 10)])
def test_nearest_in_time(spark, cap, width):
    """Ties, a hot group and time, nulls, more rows of one time than the cap."""
    rows = timed(cap, 250, most=30) + [(1000 + i, "hot", 7) for i in range(30)]
    want = {}
    for k, g, t in rows:
        if g is not None and t is not None:
            near = sorted((abs(t - u), j) for j, h, u in rows if h == g and u is not None and j != k and abs(t - u) <= width)[:cap]
            want |= {(k, j): (d, i + 1) for i, (d, j) in enumerate(near)}
    df = spark.createDataFrame([(*x, f"c{x[0]}") for x in rows], "k int, g string, t int, c string").repartition(4)
    got = sweep.nearest(df, "k", "g", "t", width, cap, ["c"]).collect()
    assert {(r["k"], r["near"]): (r["dt"], r["rank"]) for r in got} == want and len(got) == len(want)
    assert all(r["near_c"] == f"c{r['near']}" for r in got)


def test_anchored_pairs_of_one_hot_window(spark):
    r = np.random.default_rng(3)
    v = r.normal(size=(120, 6))
    at = [5] * 60 + list(range(60))
    df = spark.createDataFrame([(i, "s", at[i], v[i].tolist()) for i in range(120)] + [(999, "s", 3, None), (998, None, 3, [1.0] * 6)], "k int, s string, t int, v array<double>")
    anchor = [t // 11 * 11 for t in at]
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if anchor[i] == anchor[j] and unit[i] @ unit[j] >= 0.3}
    assert {(x["a"], x["b"]) for x in M.anchored_pairs(df, "k", "s", "t", "v", 10, 0.3).collect()} == want


def overlap(a, b):
    w = max(0.0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
    h = max(0.0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    union = a[2] * a[3] + b[2] * b[3] - w * h
    return w * h / union if union > 0 else 0.0


def boxes(seed, n):
    r = random.Random(seed)
    out = []
    for i in range(n):
        size = r.choice([0.5, 1.0, 2.0, 4.0, 64.0, r.random()])
        out.append((i, r.choice("ab"), r.uniform(-9, 9), r.uniform(-9, 9), size * r.uniform(0.5, 1.5), size, r.choice([None, r.random(), 0.5])))
    out += [(n, "a", 0.0, 0.0, 0.0, 1.0, 1.0), (n + 1, "a", None, 0.0, 1.0, 1.0, 1.0), (n + 2, "a", 1.0, 1.0, 2.0, 2.0, 1.0), (n + 3, "a", 1.0, 1.0, 2.0, 2.0, 0.9)]
    return out


BOX = "k int, g string, x double, y double, w double, h double, s double"


@pytest.mark.parametrize("least", [0.0, 0.05, 0.6])
def test_box_pairs_on_grids(spark, least):
    rows = boxes(int(100 * least), 160)
    full = [b for b in rows if b[2] is not None]
    want = {(a[0], b[0]) for a in full for b in full if a[1] == b[1] and a[0] < b[0] and overlap(a[2:6], b[2:6]) > least}
    got = M.box_pairs(spark.createDataFrame(rows, BOX), "k", "g", ("x", "y", "w", "h"), least).collect()
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want)
    assert M.box_pairs(spark.createDataFrame([], BOX), "k", "g", ("x", "y", "w", "h"), least).count() == 0
    with pytest.raises(ValueError):
        M.box_pairs(spark.createDataFrame([], BOX), "k", "g", ("x", "y", "w", "h"), -0.1)


def greedy_boxes(rows, most):
    kept = []
    for b in sorted(rows, key=lambda b: (b[6] is None, -(b[6] or 0), b[0])):
        if all(b[1] != c[1] or overlap(b[2:6], c[2:6]) <= most for c in kept):
            kept.append(b)
    return sorted(b[0] for b in kept)


@pytest.mark.parametrize("most,rounds", [(0.1, 16), (0.4, 16), (0.1, 1)])
def test_suppression_in_rounds(spark, monkeypatch, most, rounds):
    """Rounds over all tasks, one task per group, and a chain of overlapping boxes give the greedy order's boxes."""
    rows = [b for b in boxes(7, 120) if b[2] is not None] + [(500 + i, "chain", 0.6 * i, 0.0, 1.0, 1.0, -float(i)) for i in range(12)]
    want = greedy_boxes(rows, most)
    df = spark.createDataFrame(rows, BOX)
    ids = lambda: sorted(r["k"] for r in M.suppress(df, "k", "g", ("x", "y", "w", "h"), "s", most).collect())
    assert ids() == want
    monkeypatch.setattr(M, "TASK_BOXES", 20)
    monkeypatch.setattr(M, "SUPPRESS_ROUNDS", rounds)
    assert ids() == want


def stars(edges, cap):
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    taken, out = set(), set()
    for s in sorted(near, key=lambda x: (-len(near[x]), x)):
        free = sorted((m for m in near[s] if m not in taken), key=lambda x: (-len(near[x]), x))
        if s not in taken and free:
            members = [s, *free][:cap]
            taken.update(members)
            out |= {(s, m, len(near[m])) for m in members}
    return out


@pytest.mark.parametrize("cap,rounds", [(None, 16), (4, 3)])
def test_star_clusters_in_rounds(spark, monkeypatch, cap, rounds):
    """Random graphs, a hub and a long path, by rounds alone, by tasks alone and by both in turn."""
    r = random.Random(cap or 0)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(90)] + [(100, 101 + i) for i in range(50)] + [(200 + i, 201 + i) for i in range(12)] + [(3, 100)]
    df = spark.createDataFrame(edges, "a int, b int")
    want = stars(edges, cap)
    for most in (10**6, 0) if rounds == 16 else (9,):
        monkeypatch.setattr(G, "TASK_EDGES", most)
        monkeypatch.setattr(G, "ROUNDS", rounds)
        got = G.star_clusters(df, cap).collect()
        assert {(x["seed"], x["member"], x["degree"]) for x in got} == want and len(got) == len(want), most
    assert G.star_clusters(df.limit(0), cap).count() == 0


def test_similar_sets(spark):
    r = random.Random(11)
    rows = [(i, [f"t{int(r.paretovariate(0.6)) % 80}" for _ in range(r.randrange(14))]) for i in range(260)]
    rows += [(300 + i, ["x", "y", "z"]) for i in range(40)] + [(400, None), (401, []), (402, [None]), (403, ["x", None, "y", "z", "w"]), (404, ["only"])]
    sets = {k: frozenset(t for t in v or [] if t is not None) for k, v in rows}
    first = {}
    for k in sorted(sets):
        first.setdefault(sets[k], k)
    df = spark.createDataFrame(rows, "k int, s array<string>").repartition(6)
    for least in (0.3, 0.75):
        heads = sorted(v for s, v in first.items() if s)
        want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in heads for b in heads if a < b}
        want = {k: v for k, v in want.items() if v >= least} | {(first[s], k): 1.0 for k, s in sets.items() if s and first[s] != k}
        got = K.similar_sets(df, "k", "s", least).collect()
        assert {(x["a"], x["b"]): x["sim"] for x in got} == want and len(got) == len(want)
    links = {(x["first"], x["k"]) for x in K.sharing(df, "k", "s").collect()}
    want = {(min(j for j in sets if t in sets[j]), k) for k, s in sets.items() for t in s}
    assert links == {(a, b) for a, b in want if a < b}
    with pytest.raises(ValueError):
        K.similar_sets(df, "k", "s", 0)
    assert K.similar_sets(df.limit(0), "k", "s", 0.5).count() == 0


def clustered(n, dim=6, spread=0.05):
    r = np.random.default_rng(n)
    centres = r.normal(size=(12, dim))
    v = centres[np.arange(n) % 12] + spread * r.normal(size=(n, dim))
    v[5] = 0.0
    return v / np.maximum(np.linalg.norm(v, axis=1), 1e-9)[:, None]


@pytest.mark.parametrize("spread", [0.02, 2.0])
def test_pruned_products_are_whole(spark, monkeypatch, spread):
    """Blocks dealt by direction: with clusters most pairs of blocks are skipped, and no result changes."""
    monkeypatch.setattr(M, "BLOCK_ROWS", 20)
    n = 300
    v = clustered(n, spread=spread)
    df = spark.createDataFrame([(i, v[i].tolist(), int(i * 7 % 3)) for i in range(n)], "k int, v array<double>, c int")
    sims = np.round(v @ v.T, 12)
    found = M.similar_pairs(df, "k", "v", 0.9)
    assert {(r["a"], r["b"]) for r in found.collect()} == {(i, j) for i in range(n) for j in range(i + 1, n) if sims[i, j] >= 0.9}
    near = M.knn(df, df, "k", "v", "c", 4, skip_self=True)
    got = {(r["query"], r["rank"]): r["ref"] for r in near.collect()}
    for i in range(n):
        order = sorted((j for j in range(n) if j != i), key=lambda j: (-sims[i, j], j))[:4]
        assert [got[i, k + 1] for k in range(4)] == order
    by_class = M.class_similarity(df, "k", "v", "c")
    for r in by_class.collect():
        best = sorted((sims[r["query"], j] for j in range(n) if j != r["query"] and j * 7 % 3 == r["label"]), reverse=True)[:3]
        assert r["score"] == pytest.approx(sum(best) / 3, abs=1e-9)
    assert by_class.count() == 3 * n
    gated = M.knn(df.withColumn("d", F.col("k")), df.withColumn("d", F.col("k")), "k", "v", "c", 2, valid=("d", "d"), skip_self=True)
    for r in gated.filter("query % 40 = 3").collect():
        values = sorted(((sims[r["query"], j] if j <= r["query"] else -1.0, -j) for j in range(n) if j != r["query"]), reverse=True)
        assert (r["sim"], -r["ref"]) == values[r["rank"] - 1]
    # Other classes lie in other clusters here, so fewer blocks are out of their reach.
    for out, least in ((found, 0.5), (near, 0.5), (by_class, 0.1)):
        skipped, total = out.skipped
        assert 0 <= skipped < total and (spread > 1 or skipped > least * total), (skipped, total)


def test_vectors_of_other_lengths_are_named(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, [1.0, 0.0, 0.0])], "k int, v array<double>")
    with pytest.raises(Exception, match="different lengths: 2"):
        M.similar_pairs(df, "k", "v", 0.5).collect()


@pytest.mark.parametrize("side", [1, 3])
def test_blocks_are_sent_once_a_cell(spark, monkeypatch, side):
    """A block goes to each cell of pairs once, and a group has as many blocks as its own rows need."""
    n = 300
    v = clustered(n, spread=2.0)
    df = spark.createDataFrame([(i, v[i].tolist(), i % 30) for i in range(n)], "k int, v array<float>, c int")
    assert M._packed(df, "k", "v", 99, [], ["c"]).groupBy("c").count().agg(F.max("count")).first()[0] == 1
    blocks = M._packed(df, "k", "v", 7, [], [])
    pairs = M._all_pairs(blocks, blocks, [], True)

    def run(block, rows, others, cell):
        new = [o for o, _ in others if o not in cell]
        cell.update(dict.fromkeys(new))
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32()) for x in (block, len(others), len(new))], names=["block", "met", "new"])

    sent = M.meet(blocks, blocks, pairs, run, "block int, met int, new int", side=side).collect()
    cells = -(-7 // side)
    assert sum(x["met"] for x in sent) == 28 and len(sent) == sum(min(7, (j + 1) * side) for j in range(cells))
    monkeypatch.setattr(M, "BLOCK_ROWS", 13)
    monkeypatch.setattr(M, "_cell_side", lambda blocks, apart: side)
    sims = np.round(v.astype(np.float32).astype(float) @ v.astype(np.float32).astype(float).T, 12)
    found = M.similar_pairs(df, "k", "v", 0.5).collect()
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if sims[i, j] >= 0.5}
    assert {(x["a"], x["b"]) for x in found} == want and len(found) == len(want)


def test_interval_vectors_in_blocks(spark, monkeypatch):
    """Near vectors of one source within a width, one hot second among them, many blocks a bucket."""
    r = np.random.default_rng(5)
    v = r.normal(size=(160, 5))
    v[7] = 0.0
    at = [int(x) for x in r.integers(-40, 60, size=120)] + [5] * 40
    rows = [(f"k{i}", "ab"[i % 2], at[i], v[i].tolist()) for i in range(160)] + [("x", "a", None, [1.0] * 5), ("y", None, 5, [1.0] * 5), ("z", "a", 5, None)]
    df = spark.createDataFrame(rows, "k string, s string, t int, v array<double>")
    unit = v / np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]
    want = {tuple(sorted((f"k{i}", f"k{j}"))) for i in range(160) for j in range(i) if i % 2 == j % 2 and abs(at[i] - at[j]) <= 9 and unit[i] @ unit[j] >= 0.2}
    for size, side in ((4096, 8), (5, 2)):
        monkeypatch.setattr(M, "BLOCK_ROWS", size)
        monkeypatch.setattr(M, "_cell_side", lambda blocks, apart: side)  # noqa: B023
        got = M.interval_vectors(df, "k", "s", "t", "v", 9, 0.2).collect()
        assert {(x["a"], x["b"]) for x in got} == want and len(got) == len(want)


def test_strong_arms_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_ROWS", 7)
    r = np.random.default_rng(8)
    rows = [(f"i{i}", "ab"[i % 2], int(r.integers(0, 80)), int(r.integers(-(2**63), 2**63 - 1)) if i % 9 else None, r.normal(size=4).tolist()) for i in range(120)]
    kind = "s string, t int, c long, v array<double>"
    new, old = spark.createDataFrame(rows[:60], "asset_id string, " + kind), spark.createDataFrame(rows[60:], "group_id string, " + kind)
    got = {x["asset_id"]: x["group_id"] for x in M.first_match(new.select("asset_id"), M.strong_arms(new, old, "s", "t", ("c", 28, 20), ("v", 0.7, 11)), "asset_id", "group_id").collect()}
    want = {}
    for a, s, t, c, v in rows[:60]:
        for g, s2, t2, c2, w in rows[60:]:
            code = c is not None and c2 is not None and bin((c ^ c2) & (2**64 - 1)).count("1") <= 28 and abs(t - t2) <= 20
            near = np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.7 and abs(t - t2) <= 11
            if s == s2 and (code or near):
                want[a] = min(want.get(a, g), g)
    assert got == want and got
    # One row for each new row and cell of blocks leaves a task, not one for each pair.
    hot = spark.range(50).select(F.concat(F.lit("n"), "id").alias("asset_id"), F.lit("s").alias("s"), F.lit(5).alias("t"), F.lit(1).cast("long").alias("c"))
    monkeypatch.setattr(M, "BLOCK_ROWS", 4096)
    assert M.strong_arms(hot, hot.withColumnRenamed("asset_id", "group_id"), "s", "t", ("c", 0, 20))[0].count() == 50


@pytest.mark.parametrize("least", [0.0, 0.3])
def test_box_pairs_of_full_cells(spark, monkeypatch, least):
    rows = boxes(3, 150)
    full = [b for b in rows if b[2] is not None]
    df = spark.createDataFrame(rows, BOX)
    want = {(a[1], a[0], b[0]): overlap(a[2:6], b[2:6]) for a in full for b in full if a[1] == b[1] and a[0] < b[0] and overlap(a[2:6], b[2:6]) > least}
    for dense in (0, 4):
        monkeypatch.setattr(M, "DENSE", dense)
        got = M.box_pairs(df, "k", "g", ("x", "y", "w", "h"), least).collect()
        assert {(x["g"], x["a"], x["b"]): pytest.approx(x["iou"]) for x in got} == want and len(got) == len(want)


@pytest.mark.parametrize("front", [0, 1, 3])
def test_suppression_by_fronts(spark, monkeypatch, front):
    """Fronts take away most of a dense group, and sparse groups are left to conflicts."""
    r = random.Random(front)
    rows = [b for b in boxes(7, 90) if b[2] is not None]
    rows += [(700 + i, "dense", r.random(), r.random(), 6 + r.random(), 6 + r.random(), r.choice([None, r.random()])) for i in range(200)]
    rows += [(1000 + i, "chain", 0.6 * i, 0.0, 1.0, 1.0, -float(i)) for i in range(30)]
    monkeypatch.setattr(M, "TASK_BOXES", 10)
    monkeypatch.setattr(M, "FRONT", front)
    df = spark.createDataFrame(rows, BOX)
    left, found = M._fronts(df.select("g", "k", "x", "y", "w", "h", F.col("s").alias("__score")), "k", "g", ("x", "y", "w", "h"), 0.4)
    assert front == 0 or left.filter("g = 'dense'").isEmpty() and found.filter("g = 'dense'").count() < 20
    got = sorted(x["k"] for x in M.suppress(df, "k", "g", ("x", "y", "w", "h"), "s", 0.4).collect())
    assert got == greedy_boxes(rows, 0.4)


def test_star_clusters_by_fronts(spark, monkeypatch):
    """Graphs of many edges a node go by fronts of first free nodes, in the greedy order."""
    r = random.Random(4)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(700)] + [(100, 101 + i) for i in range(30)] + [(3, 100)]
    df = spark.createDataFrame(edges, "a int, b int")
    for name, value in (("TASK_EDGES", 9), ("DENSE", 0), ("FRONT", 12), ("LARGEST_FRONT", 12), ("NEAR", 6), ("ROUNDS", 4)):
        monkeypatch.setattr(G, name, value)
    want = stars(edges, 5)
    with monkeypatch.context() as m:
        m.setattr(G, "_star_rounds", None)
        got = G.star_clusters(df, 5).collect()
    assert {(x["seed"], x["member"], x["degree"]) for x in got} == want and len(got) == len(want)


@pytest.mark.parametrize("spread,cap,walk", [(0.6, 7, 24), (2.0, 4, 10**6)])
def test_star_clusters_of_vectors(spark, monkeypatch, spread, cap, walk):
    """Dense graphs of vectors give the greedy clusters of their pairs, and no table of pairs is written."""
    monkeypatch.setattr(M, "BLOCK_ROWS", 40)
    for name, value in (("FEW_PAIRS", 0), ("FEW_ROWS", 0), ("DENSE", 0), ("STRETCH", 8), ("AHEAD", 16), ("NEAR", 7), ("COUNTED", 16)):
        monkeypatch.setattr(S, name, value)
    real = S._walks
    monkeypatch.setattr(S, "_walks", lambda names, n, most, least, cap: real(names, n, walk, least, cap))
    far = []
    beyond = S._beyond
    monkeypatch.setattr(S, "_beyond", lambda *a: far.append(1) or beyond(*a))
    v = clustered(120, spread=spread)
    v[17] = v[16]
    df = spark.createDataFrame([(f"k{i:03d}", [float(x) for x in v[i]]) for i in range(120)] + [("none", None), (None, [1.0] * 6)], "k string, v array<double>").repartition(5)
    sims = np.round(v @ v.T, 12)
    edges = [(f"k{i:03d}", f"k{j:03d}") for i in range(120) for j in range(i) if sims[i, j] >= 0.5]
    written = []
    for module in (S, M, G):
        monkeypatch.setattr(module, "cut", lambda df, name, write=module.cut: (out := write(df, name), written.append(out.count()))[0])
    got = S.similar_stars(df, "k", "v", 0.5, cap).collect()
    assert {(x["seed"], x["member"], x["degree"]) for x in got} == (want := stars(edges, cap)) and len(got) == len(want)
    assert max(written) <= 360 < len(edges)
    assert bool(far) == (walk < 120)


def test_star_clusters_of_few_pairs(spark, monkeypatch):
    """Few pairs, repeated keys and no rows go by the pairs."""
    monkeypatch.setattr(S, "FEW_ROWS", 0)
    rows = [(i % 90, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(100)]
    df = spark.createDataFrame(rows, "k int, v array<double>")
    for some in (df, df.limit(0)):
        want = {tuple(x) for x in G.star_clusters(M.similar_pairs(some, "k", "v", 0.5).select("a", "b"), 7).collect()}
        assert {tuple(x) for x in S.similar_stars(some, "k", "v", 0.5, 7).collect()} == want


@pytest.mark.parametrize("least", [0.3, 0.6, 1.0])
def test_similar_sets_in_blocks(spark, monkeypatch, least):
    """Sets of many sizes that share hot tokens: only similar pairs leave a task, and many blocks change nothing."""
    r = random.Random(2)
    rows = [(i, [f"t{int(r.paretovariate(0.7)) % 60}" for _ in range(r.choice([2, 5, 9, 30, 60]))] + [f"own{i}"] * (i % 3 == 0) + ["hot"]) for i in range(200)]
    rows += [(200 + i, r.sample(rows[i][1], len(rows[i][1]))[: 1 + len(rows[i][1]) * 9 // 10]) for i in range(60)]
    sets = {k: frozenset(v) for k, v in rows}
    first = {}
    for k in sorted(sets):
        first.setdefault(sets[k], k)
    heads = sorted(first.values())
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in heads for b in heads if a < b}
    want = {k: v for k, v in want.items() if v >= least} | {(first[s], k): 1.0 for k, s in sets.items() if first[s] != k}
    df = spark.createDataFrame(rows, "k int, s array<string>").repartition(3)
    written = []
    write = K.cut

    def counted(df, name):
        out = write(df, name)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(K, "cut", counted)
    for size, tile in ((4096, 1 << 22), (7, 90)):
        monkeypatch.setattr(K, "BLOCK_SETS", size)
        monkeypatch.setattr(K, "TILE", tile)
        got = K.similar_sets(df, "k", "s", least).collect()
        assert {(x["a"], x["b"]): x["sim"] for x in got} == want and len(got) == len(want)
        assert max(n for name, n in written if name != "block-pairs") <= len(rows)


def test_set_blocks_hold_few_tokens(spark, monkeypatch):
    """Blocks of long sets hold fewer of them, and cells of unequal sides lose and repeat no pair."""
    monkeypatch.setattr(K, "BLOCK_TOKENS", 100, raising=False)
    monkeypatch.setattr(K, "HELD", 2, raising=False)
    monkeypatch.setattr(K, "SEEN", 3, raising=False)
    r = random.Random(5)
    rows = [(i, [f"t{x}" for x in r.sample(range(60), 30 + i % 9)]) for i in range(120)]
    sizes = []
    write = K.cut

    def seen(df, name):
        out = write(df, name)
        if name == "set-blocks":
            sizes.extend(len([t for x in b["rows"] for t in x["o"]]) for b in out.collect())
        return out

    monkeypatch.setattr(K, "cut", seen)
    got = K.similar_sets(spark.createDataFrame(rows, "k int, s array<string>"), "k", "s", 0.6).collect()
    sets = dict((k, set(s)) for k, s in rows)
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    assert {(x["a"], x["b"]) for x in got} == want and len(got) == len(want) > 0
    assert max(sizes) < 500 and sum(sizes) == sum(len(s) for s in sets.values())
