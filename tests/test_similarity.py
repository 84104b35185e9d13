import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import adapters as A
from tessella.functions import expr as X
from tessella.operators import graph as G
from tessella.operators import scoring as S
from tessella.operators import search as Q
from tessella.operators import similarity as M


def test_star_clusters(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("s", "x"), ("s", "y"), ("s", "z"), ("y", "s")]
    got = {}
    for r in G.star_clusters(spark.createDataFrame(edges, "a string, b string")).collect():
        got.setdefault(r["seed"], set()).add(r["member"])
    assert got == {"s": {"s", "x", "y", "z"}, "b": {"a", "b", "c"}}
    capped = G.star_clusters(spark.createDataFrame([("s", c) for c in "abcdef"], "a string, b string"), cap=3)
    assert capped.count() == 3


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(60) if i % 13] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(40)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in G.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: root(x) for x in parent}
    assert G.components(spark.createDataFrame([], "a int, b int")).count() == 0


@pytest.mark.parametrize("distance", [0, 3, 9])
def test_hamming(spark, distance):
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(12)]
    codes = [b ^ sum(1 << k for k in r.sample(range(64), r.randrange(0, 12))) for b in base for _ in range(6)]
    signed = [(i, c - (1 << 64) if c >> 63 else c) for i, c in enumerate(codes)]
    got = sorted((r["a"], r["b"], r["dist"]) for r in M.hamming_pairs(spark.createDataFrame(signed, "id int, code long"), "id", "code", distance).collect())
    want = [(i, j, bin(codes[i] ^ codes[j]).count("1")) for i in range(len(codes)) for j in range(i + 1, len(codes))]
    assert got == [x for x in want if x[2] <= distance]


def test_anchored_and_sliding(spark):
    df = spark.createDataFrame([(0, "s", 0, [1.0, 0.0]), (1, "s", 60, [1.0, 0.0]), (2, "s", 120, [1.0, 0.0])], "id int, src string, t int, v array<double>")
    assert [(r["a"], r["b"]) for r in M.anchored_pairs(df, "id", "src", "t", "v", 90, 0.96).collect()] == [(0, 1)]
    assert sorted((r["a"], r["b"]) for r in M.interval_pairs(df, "id", "src", "t", 90).collect()) == [(0, 1), (1, 2)]


def votes(spark, labels, **kw):
    rows = [("q", x, 0.9) for x in labels]
    return S.vote(spark.createDataFrame(rows, "query string, label string, sim double"), 10, **kw).first()["decision"]


def test_votes(spark):
    assert votes(spark, "aaaaabbbbc") == "abstain_margin"
    assert votes(spark, "aaaaaaabbb") == "assign"
    assert votes(spark, "aaaaaabbbb", ratio=S.child_ratio(F.lit(True))) == "abstain_ratio"
    assert votes(spark, "aaaaaaabbb", least=0.95) == "abstain_empty"


def brute_knn(rows, k, valid=False):
    """(query, ref, label, sim, rank) by comparing everything."""
    out = []
    for i, v, _ in rows:
        sims = [(-1.0 if valid and i < j else round(sum(x * y for x, y in zip(v, w)), 12), j, c) for j, w, c in rows if j != i]
        out += [(i, j, c, s, n + 1) for n, (s, j, c) in enumerate(sorted(sims, key=lambda x: (-x[0], x[1]))[:k])]
    return sorted(out)


def test_knn_and_classes_against_brute_force(spark, monkeypatch):
    r = random.Random(5)
    rows = [(i, [float(r.randrange(4)) for _ in range(4)], i % 3) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, v array<double>, c int")
    classes = {}
    for i, v, own in rows:
        for c in range(3):
            best = sorted((sum(x * y for x, y in zip(v, w)) for j, w, d in rows if d == c and j != i), reverse=True)[:3]
            classes[i, own, c] = round(sum(best) / 3, 9)
    for size in (4096, 13):  # one block, and many
        monkeypatch.setattr(M, "BLOCK_ROWS", size)
        for valid in (None, ("id", "id")):
            got = sorted(tuple(x) for x in M.knn(df, df, "id", "v", "c", 5, valid=valid, skip_self=True).collect())
            assert got == brute_knn(rows, 5, valid is not None)
        got = {(x["query"], x["own"], x["label"]): round(x["score"], 9) for x in M.class_similarity(df, "id", "v", "c").collect()}
        assert got == classes
        pairs = sorted((x["a"], x["b"]) for x in M.similar_pairs(df, "id", "v", 20.0).collect())
        assert pairs == [(i, j) for i, v, _ in rows for j, w, _ in rows if i < j and sum(x * y for x, y in zip(v, w)) >= 20]
        inside = sorted((x["a"], x["b"]) for x in M.similar_pairs(df, "id", "v", 20.0, within="c").collect())
        assert inside == [(a, b) for a, b in pairs if a % 3 == b % 3]
    empty = df.limit(0)
    assert M.knn(df, empty, "id", "v", "c", 5).count() == M.knn(empty, df, "id", "v", "c", 5).count() == M.similar_pairs(empty, "id", "v", 0.0).count() == 0


def test_knn_with_unknown_dates(spark):
    refs = spark.createDataFrame([(1, [1.0, 0.0], "a", "2019-01-01"), (2, [0.9, 0.0], "b", None), (3, None, "c", None)], "id int, v array<double>, c string, born string")
    queries = spark.createDataFrame([(10, [1.0, 0.0], "2010-05-05"), (11, [1.0, 0.0], None)], "id int, v array<double>, taken string")
    got = sorted((x["query"], x["ref"], x["sim"]) for x in M.knn(queries, refs, "id", "v", "c", 2, valid=("taken", "born")).collect())
    assert got == [(10, 1, -1.0), (10, 2, 0.9), (11, 1, 1.0), (11, 2, 0.9)]


def test_larger_tables_have_whole_results(spark):
    """30,000 references: each query has its nearest ten."""
    df = spark.range(30_000).select(F.col("id"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.sin(F.col("id") * (i + 1))).alias("v"), (F.col("id") % 5).alias("c"))
    near = M.knn(df.filter("id < 50"), df, "id", "v", "c", 10)
    assert near.count() == 500 and near.filter("rank = 1 and query != ref").filter("sim < 0").count() == 0


def test_order_statistics(spark):
    r = random.Random(4)
    values = [r.choice([1.5, 2.0, 7.25, r.random() * 10]) for _ in range(501)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    points = [0.0, 0.01, 0.33, 0.5, 0.999, 1.0]
    assert S.order_statistics(df, "v", points) == pytest.approx([float(x) for x in np.quantile(values, points)])
    assert S.order_statistics(df.limit(0), "v", points) is None
    assert S.best_f1(df.limit(0).withColumn("same", F.lit(True)), "v", "same").count() == 0


@pytest.mark.parametrize("gather", [50_000, 40])
def test_order_statistics_by_refinement(spark, monkeypatch, gather):
    """Ties, both signs, both zeros, tiny and infinite values; ranges are cut again and again until few values are left."""
    monkeypatch.setattr(S, "GATHER", gather)
    monkeypatch.setattr(S, "GUESS", 60)
    r = random.Random(5)
    values = [r.choice([0.0, -0.0, 3.0, r.gauss(0, 1), r.gauss(1e9, 5), -r.random() * 1e-300, 7.5 + r.random() * 1e-9]) for _ in range(4000)] + [float("inf")] * 3 + [float("-inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    order = sorted(values)
    points = [i / 400 for i in range(1, 400)]
    for p, got in zip(points, S.order_statistics(df, "v", points)):
        x = p * (len(order) - 1)
        lo, hi = order[int(x)], order[min(len(order) - 1, int(x) + 1)]
        assert got == (lo if x == int(x) else lo + (hi - lo) * (x - int(x)))
    with_nan = df.unionByName(spark.createDataFrame([(float("nan"),)] * 4000, "v double"))
    assert np.isnan(S.order_statistics(with_nan, "v", [0.9])[0]) and S.order_statistics(with_nan, "v", [0.0]) == [float("-inf")]


def test_assignment_rules(spark):
    """In order: not valid, too far, too small a lead, too small a share."""
    def decide(labels, sims=None, least=0.5, kids=("kid",)):
        sims = sims or [0.9 - i / 100 for i in range(len(labels))]
        rows = [("q", i, x, s, i + 1) for i, (x, s) in enumerate(zip(labels, sims))]
        near = spark.createDataFrame(rows, "query string, ref int, label string, sim double, rank int")
        return S.assign_people(near, spark.createDataFrame([(k,) for k in kids], "label string"), least).first()["decision"]

    assert decide(["a"] * 10, [-1.0] * 10) == "abstain_invalid" and decide(["a"] * 10, least=0.95) == "abstain_similarity"
    assert decide(["kid"] * 10, least=0.85) == "abstain_similarity" and decide(["a"] * 10, least=0.85) == "assign"
    assert decide(["a"] * 5 + ["b"] * 4 + ["c"]) == "abstain_margin" and decide(["a"] * 5 + ["b"] * 3 + ["c"] * 2) == "abstain_ratio"
    assert decide(["a"] * 6 + ["b"] * 4) == "assign" and decide(["kid"] * 6 + ["b"] * 4) == "abstain_ratio" and decide(["a"]) == "assign"
    assert S.least_similarity("SFace-2021dec") == 0.5437 and S.least_similarity("x") == 0.55 and S.least_similarity("x", "0.61") == 0.61 and S.least_similarity("x", "off") == 0.55


def test_suppression(spark):
    boxes = [(1, "i", 0.0, 0.0, 1.0, 1.0, 0.9), (2, "i", 0.05, 0.0, 1.0, 1.0, 0.8), (3, "i", 2.0, 2.0, 1.0, 1.0, 0.1)]
    df = spark.createDataFrame(boxes, "id int, img string, x double, y double, w double, h double, s double")
    assert sorted(r["id"] for r in M.suppress(df, "id", "img", ("x", "y", "w", "h"), "s", 0.5).collect()) == [1, 3]


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_mmr_similarity(spark):
    def sim(d1, d2, t1, t2):
        lit = lambda t: F.array(*map(F.lit, t)).cast("array<string>")
        return one(spark, X.mmr_similarity(F.lit(d1).cast("string"), F.lit(d2).cast("string"), lit(t1), lit(t2)))[0]

    assert sim("d", "d", [], []) == 0.5 and sim("d", "e", [], []) == 0.0 and sim("d", "d", ["a"], ["a"]) == 1.0
    assert sim("d", "e", ["a", "b"], ["b", "c"]) == pytest.approx(1 / 6) and sim("d", "d", ["a", "b"], ["b", "c"]) == pytest.approx(2 / 3)
    assert sim(None, None, [], []) == 0.5 and sim("d", "e", ["a"], []) == 0.0


def test_rerank(spark):
    same = [("q", f"x{i:02d}", 1.0, "d1", ["t"]) for i in range(10)]
    got = [r["id"] for r in Q.rerank(spark.createDataFrame(same, "query string, id string, score double, day string, tags array<string>"), 10).orderBy("rank").collect()]
    assert got == [r[1] for r in same]
    rows = [("q", f"a{i:02d}", 1.0, "d1", []) for i in range(12)] + [("q", f"b{i}", 1.0, "d2", []) for i in range(4)]
    df = spark.createDataFrame(rows, "query string, id string, score double, day string, tags array<string>")
    top = [r["id"][0] for r in Q.rerank(df, 5).filter("rank <= 5").collect()]
    assert set(top) == {"a", "b"}


def test_rerank_takes_all_rows(spark):
    """Against a plain greedy choice over whole queries; the row unlike all others is below place 300."""
    r = random.Random(7)
    rows = [("q", i, 1.0 + r.randrange(50) / 100, f"d{i % 3}", [r.choice("ab"), "t"]) for i in range(400)] + [("q", 400, 0.9, "d9", ["z"])]
    rows += [("p", i, float(i % 4), "d1", None) for i in range(30)] + [("s", i, float(i), "d1", ["t"]) for i in range(12)]
    df = spark.createDataFrame(rows, "query string, id int, score double, day string, tags array<string>")
    got, want = {tuple(x) for x in Q.rerank(df, 10).select("query", "id", "rank").collect()}, set()
    for q in "qps":
        left = sorted((x for x in rows if x[0] == q), key=lambda x: (-x[2], x[1]))
        low, high, chosen = min(x[2] for x in left), max(x[2] for x in left), []

        def gain(x):
            near = [0.5 * (x[3] == y[3]) + (0.5 * len(set(x[4]) & set(y[4])) / len(set(x[4]) | set(y[4])) if x[4] and y[4] else 0) for y in chosen]
            return 0.7 * (x[2] - low) / (high - low) - 0.3 * max(near, default=0)

        while len(left) + len(chosen) > 15 and len(chosen) < 10:
            chosen.append(max(left, key=gain))
            left.remove(chosen[-1])
        want |= {(q, x[1], i + 1) for i, x in enumerate(chosen + left)}
    assert got == want and len(got) == len(rows)


def test_search(spark):
    df = spark.createDataFrame([(1, "Hello World"), (2, "help"), (3, None), (4, "héllo")], "id int, text string")
    index = Q.trigram_index(df, "id", "text")
    assert [r["id"] for r in Q.contains(df, index, "id", "text", "LLO w").collect()] == [1]
    assert sorted(r["id"] for r in Q.contains(df, index, "id", "text", "he").collect()) == [1, 2]
    again = Q.refresh(index, df, "id", index)
    assert again.count() == index.count()
    assert Q.word_index(df, "id", "text").filter("word = 'world'").count() == 1


def test_intent(spark):
    got = one(spark, Q.intent(F.lit("2019年孩子的视频"), ["孩子", "妈妈"], ["海"]).alias("i"))["i"]
    assert (got["media_type"], got["year"], got["people"], got["scenes"]) == ("video", 2019, ["孩子"], [])
    assets = spark.createDataFrame([("a", "video", "2019-05-01", ["孩子"], []), ("b", "photo", "2019-05-01", ["孩子"], [])], "asset_id string, media_type string, day string, people array<string>, tags array<string>")
    assets = assets.withColumn("day", F.to_date("day"))
    rows, blocked = Q.by_intent(assets, got.asDict(), spark.createDataFrame([("孩子",)], "person string"))
    assert not blocked and [r["asset_id"] for r in rows.collect()] == ["a"]
    assert Q.by_intent(assets, got.asDict(), spark.createDataFrame([], "person string"))[1]


def test_privacy_rules(spark):
    rules = [S.TextRule("裸体", 10, "nude"), S.TextRule("泳衣|泳装", 5, "swim")]
    names = [S.TextRule("bath", 4, "name"), S.TextRule("nsfw", 6, "sensitive")]

    def score(text, name=None):
        s, why = S.rule_score(F.lit(text).cast("string"), rules, F.lit(name).cast("string"), names, "sensitive")
        return tuple(one(spark, s.alias("s"), why.alias("w")))

    assert score("裸体 裸体") == (10, "nude") and score("泳衣") == (5, "swim") and score(None, "bath.jpg") == (2, "name")
    assert score("", "nsfw.jpg") == (5, "sensitive") and score("裸体泳装", "x") == (15, "nude+swim")
    routes = [one(spark, S.cascade(F.lit(s), F.lit(d), F.lit(v)))[0] for s, d, v in ((10, True, False), (5, True, False), (0, False, True), (0, True, True), (4, False, False))]
    assert routes == ["auto", "review", "review", "below", "below"]


def test_junk_and_log_rules(spark):
    j = lambda n, p: one(spark, S.junk_reasons(F.lit(n), F.lit(p)))[0]
    assert j("Screenshot_1.png", "Pictures/Screenshots/Screenshot_1.png") == ["SCREENSHOT_FILENAME", "SCREENSHOT_PATH"]
    assert j("a.jpg", "x/Download/a.jpg") == ["DOWNLOAD_PATH"] and j("a.jpg", "download/x/a.jpg") == [] and j("录屏1.mp4", "x") == ["SCREEN_RECORDING_FILENAME"]
    p = lambda n: one(spark, S.log_profile(F.lit(n)).alias("p"))["p"]
    assert tuple(p("A_D.MP4")) == ("DJI", "dlog", 0.95, 1) and tuple(p("insta360_x.mp4")) == ("Insta360", "unknown", 0.30, None) and p("x.mp4") is None


def test_vision_gate(spark):
    v = spark.createDataFrame([("a", True, "document", 0.9), ("b", True, "document", 0.9), ("c", True, "odd", 0.9), ("d", True, "meme", 0.1)], "asset_id string, is_junk boolean, kind string, confidence double")
    f = spark.createDataFrame([("b",)], "asset_id string")
    assert [tuple(r) for r in S.vision_gate(v, f, {"document": "DOC", "meme": "MEME"}, 0.5).collect()] == [("a", "DOC")]


def test_expressions(spark):
    labels = [one(spark, X.age_bin(F.lit(a)))[0] for a in (5, 15, 40, 70)]
    assert labels == ["child", "teen", "adult", "elder"]
    c = one(spark, X.crop_window(F.lit(800), F.lit(400), F.lit(700), F.lit(50)).alias("c"))["c"]
    assert round(c["w"]) == 533 and c["h"] == 400 and 0 <= c["x"] <= 800 - c["w"] and c["y"] == 0
    assert one(spark, X.epoch_seconds(F.lit("2024-01-01T08:00:00")))[0] == one(spark, X.epoch_seconds(F.lit("2024-01-01T00:00:00Z")))[0] == 1704067200
    assert one(spark, X.epoch_seconds(F.lit("nonsense")))[0] is None
    assert one(spark, X.signed64(F.lit("18446744073709551615")))[0] == -1
    assert one(spark, X.json_payload(F.lit('```json\n{"a": [1, 2,],}\n```')))[0] == '{"a": [1, 2]}'
    assert one(spark, X.combined_quality(F.lit(-4.0), F.lit("blurry")))[0] == -2.0
    assert tuple(one(spark, X.age_parts(F.lit("2020-03-15").cast("date"), F.lit("2024-01-20").cast("date")).alias("a"))["a"]) == (3, 10)
    assert one(spark, X.rewrite_prefix(F.lit("/old/x"), "/old", "/new"))[0] == "/new/x"
    kinds = [one(spark, X.evidence_kind(F.lit(x)))[0] for x in ("A_FILENAME", "A_PATH", "vision_meme")]
    assert kinds == ["filename", "path", "path"]
    assert [one(spark, X.like(F.lit(x), "Ab%É"))[0] for x in ("aBcÉ", "abé", "xab")] == [True, False, False]


def test_blob_vectors(spark):
    good = np.array([0.5, -2.25, 3e-8], "<f4")
    rows = [(good.tobytes(),), (good.tobytes()[:-1],), (np.array([1, np.nan, 2], "<f4").tobytes(),), (None,), (b"",), (good.tobytes() * 2,)]
    got = [r[0] for r in spark.createDataFrame(rows, "b binary").select(X.floats("b", 3)).collect()]
    assert got == [good.tolist(), None, None, None, None, None]
    assert len(spark.createDataFrame(rows[-1:], "b binary").select(X.floats("b")).first()[0]) == 6


def test_landmarks(spark):
    def points(open_by):
        pts = [(0.0, 0.0)] * 106
        for k, i in enumerate(range(33, 43)):
            pts[i] = (10.0 + k * 2, 50.0 + (open_by if k % 2 else 0))
        for k, i in enumerate(range(88, 96)):
            pts[i] = (80.0 + k * 2, 50.0 + (open_by if k % 2 else 0))
        pts[52], pts[58] = (30.0, 90.0), (80.0, 90.0)
        return F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in pts])

    good = one(spark, X.point_metrics(points(6.0)).alias("m"))["m"]
    assert good["eyes_open"] and good["is_smiling"]
    assert one(spark, X.point_metrics(points(40.0)).alias("m"))["m"] is None
    # Eyes 18 and 14 wide; both sides of the thresholds of 0.28 and 0.72.
    assert not one(spark, X.point_metrics(points(4.0)).alias("m"))["m"]["eyes_open"] and one(spark, X.point_metrics(points(4.6)).alias("m"))["m"]["eyes_open"]
    assert good["smile_ratio"] > 0.72 and not one(spark, X.point_metrics(points(4.6), smile_at=0.8).alias("m"))["m"]["is_smiling"]


def test_adapters(spark):
    waits = []
    calls = iter([A.RateLimited("x"), A.RateLimited("y"), 7])

    def call():
        x = next(calls)
        if isinstance(x, Exception):
            raise x
        return x

    assert A.with_backoff(call, sleep=waits.append)() == {"result": 7, "error": None} and waits == [5, 10]
    assert A.with_backoff(lambda: 1 / 0)()["error"].startswith("ZeroDivisionError")
    df = spark.createDataFrame([("a", bytearray(b"xyz")), ("b", None)], "asset_id string, content binary")
    rows = {r["asset_id"]: r["vec"] for r in A.apply(df, "encoder", "stub", "content", "vec", "array<double>", dimension=8).collect()}
    assert len(rows["a"]) == 8 and rows["b"] is None
    with pytest.raises(KeyError):
        A.create("encoder", "none")
    f = A.frames(spark.createDataFrame([("p", "photo", None), ("v", "video", 10.0)], "asset_id string, media_type string, duration double"))
    assert sorted(r["at"] for r in f.collect()) == [0.0, 1.0, 5.0, 9.0]


def test_streaming(spark, tmp_path):
    from tessella.streaming import once

    src, ck = str(tmp_path / "in"), str(tmp_path / "ck")
    spark.range(5).write.parquet(src)
    seen = []
    stream = lambda: spark.readStream.schema("id long").parquet(src)
    once.process_available(stream(), lambda df, i: seen.append(df.count()), ck).awaitTermination(60)
    once.process_available(stream(), lambda df, i: seen.append(df.count()), ck).awaitTermination(60)
    assert sum(seen) == 5
    spark.range(5, 7).write.mode("append").parquet(src)
    once.process_available(stream(), lambda df, i: seen.append(df.count()), ck).awaitTermination(60)
    assert sum(seen) == 7


def test_unit_vectors_take_their_length_once(spark):
    """Inside the function of each element it would be taken as often as the vector is long."""
    assert str(X.normalised("v")).count("zip_with") == 1
    rows = [(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [1e-9, 0.0]), (5, [1.0, None]), (6, [0.1, 0.7]), (7, [])]
    got = {r["k"]: r["u"] for r in spark.createDataFrame(rows, "k int, v array<float>").select("k", X.normalised("v").alias("u")).collect()}
    assert got[1] == [0.6, 0.8] and [got[k] for k in (2, 3, 4, 5, 7)] == [None] * 5
    v = [float(np.float32(x)) for x in (0.1, 0.7)]
    n = math.sqrt(0.0 + v[0] * v[0] + v[1] * v[1])
    assert got[6] == [x / n for x in v]


def test_first_leaders_in_steps(spark, monkeypatch):
    """Rows that have found their leader leave; a few cells don't start a task for each of many partitions."""
    monkeypatch.setattr(M, "LEADERS", 3)
    r = np.random.default_rng(5)
    def photos(n, name):
        return [(f"{name}{i:03d}", str(r.integers(2)), int(r.integers(200)), [float(x) for x in r.normal(size=4)], int(r.integers(2**16)) << 40 | int(r.integers(8))) for i in range(n)]
    new, old = photos(120, "a"), photos(90, "g")
    frame = lambda rows, k: spark.createDataFrame(rows, f"{k} string, source string, at long, v array<double>, code long")
    code, vector = M.strong_arms(frame(new, "asset_id"), frame(old, "group_id"), "source", "at", code=("code", 5, 60), vector=("v", 0.7, 40))
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    near = {"code": lambda a, g: abs(a[2] - g[2]) <= 60 and bin(a[4] ^ g[4]).count("1") <= 5, "vector": lambda a, g: abs(a[2] - g[2]) <= 40 and unit(a[3]) @ unit(g[3]) >= 0.7}
    for arm, fits in ((code, near["code"]), (vector, near["vector"])):
        want = {a[0]: min(g[0] for g in old if a[1] == g[1] and fits(a, g)) for a in new if any(a[1] == g[1] and fits(a, g) for g in old)}
        got = M.first_match(frame(new, "asset_id").select("asset_id"), [arm], "asset_id", "group_id")
        assert len(want) > 20 and {x["asset_id"]: x["group_id"] for x in got.collect()} == want
    one = M.strong_arms(frame(new[:1], "asset_id"), frame([("g", *new[0][1:])], "group_id"), "source", "at", vector=("v", 0.7, 40))[0]
    assert one.rdd.getNumPartitions() <= 2 and one.count() == 1
