import numpy as np
from pyspark.sql import functions as F

from tessella.functions import adapters as A
from tessella.functions import expr as X
from tessella.functions import pixels
from tessella.operators import library as L
from tessella.operators import scoring as S


def test_extend_groups(spark):
    members = spark.createDataFrame([("sim_0000004", "a1"), ("sim_0000004", "a2"), ("sim_0000009", "a3")], "group_id string, asset_id string")
    new = spark.createDataFrame([("b1",), ("b2",), ("b3",), ("b4",), ("a1",)], "asset_id string")
    match = spark.createDataFrame([("b1", "sim_0000009"), ("b1", "sim_0000004"), ("a1", "sim_0000009")], "asset_id string, group_id string")
    links = spark.createDataFrame([("b1", "b2"), ("b2", "b3"), ("b3", "b4"), ("a2", "b4")], "a string, b string")
    got = {(r["group_id"], r["asset_id"], r["phase"]) for r in L.extend_groups(members, new, [match], links).collect()}
    assert got == {("sim_0000004", "b1", "append"), *(("sim_0000010", b, "new") for b in ("b2", "b3", "b4"))}
    again = members.union(spark.createDataFrame([(g, a) for g, a, _ in got], members.schema))
    assert L.extend_groups(again, new, [match], links).count() == 0


def test_quality_merge_counts_the_union(spark):
    blur = spark.createDataFrame([("a", "blurry"), ("b", None)], "asset_id string, label string")
    aes = spark.createDataFrame([("a", 4.0), ("c", 1.0)], "asset_id string, aesthetic double")
    rows, n = L.merge_quality(blur, aes)
    assert n == 3 and {r["asset_id"]: r["quality_score"] for r in rows.collect()} == {"a": 2.0, "b": None}


def test_paradox_prefers_gender(spark):
    flag = S.paradox(F.lit("f"), F.lit("m"), F.lit(30), F.lit(5))
    assert spark.range(1).select(flag).first()[0] == "gender"
    assert spark.range(1).select(S.paradox(F.lit("f"), F.lit("f"), F.lit(8), F.lit(5))).first()[0] is None


def test_sampled_pairs(spark):
    df = spark.createDataFrame([(i, i % 4) for i in range(200)] + [(900 + i, 9) for i in range(4)] + [(950 + i, 8) for i in range(6)], "k int, l int")
    rows = S.sample_pairs(df, "k", "l", cap=30).collect()
    label = lambda k: 8 if k >= 950 else 9 if k >= 900 else k % 4
    assert all(r["same"] == (label(r["a"]) == label(r["b"])) and r["a"] != r["b"] for r in rows)
    inside = [sum(r["same"] for r in rows if label(r["a"]) == c) for c in (0, 1, 2, 3, 8, 9)]
    assert inside == [30, 30, 30, 30, 15, 0]  # six rows have 15 pairs, four rows are too few
    assert len({(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in rows if r["same"]}) == sum(inside)
    apart = {(r["a"], r["b"]) for r in rows if not r["same"]}
    assert len(apart) == sum(not r["same"] for r in rows) == sum(inside) and all(a < b for a, b in apart)


def test_all_pairs_are_equally_likely(spark):
    """Over 300 classes of twelve rows each of the 66 pairs is drawn about as often, and so is each class of the others."""
    n, size, cap = 300, 12, 10
    df = spark.range(n * size).select(F.col("id").alias("k"), (F.col("id") / size).cast("int").alias("l"))
    rows = S.sample_pairs(df, "k", "l", cap=cap).collect()
    drawn = {}
    for r in rows:
        if r["same"]:
            drawn[r["a"] % size, r["b"] % size] = drawn.get((r["a"] % size, r["b"] % size), 0) + 1
    assert len(drawn) == 66 and sum(drawn.values()) == n * cap and 15 < min(drawn.values()) and max(drawn.values()) < 80
    other = [r["a"] // size for r in rows if not r["same"]] + [r["b"] // size for r in rows if not r["same"]]
    times = [other.count(c) for c in range(n)]
    assert len(other) == 2 * n * cap and 3 < min(times) and max(times) < 45


def test_extensions_on_event_time(spark, tmp_path):
    """Windows and sessions drop nothing that comes within the lateness."""
    from tessella.streaming import once

    rows = [(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 00:04:00", 2.0), (1, "2024-01-01 01:00:00", 4.0), (2, "2024-01-01 00:01:00", 8.0), (1, "2024-01-01 00:00:00", 1.0)]
    spark.createDataFrame(rows, "u int, t string, v double").withColumn("t", F.to_timestamp("t")).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema("u int, t timestamp, v double").parquet(str(tmp_path / "in"))

    def run(stream, name):
        q = stream.writeStream.format("memory").queryName(name).outputMode("append" if name == "first_" else "complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return spark.table(name)

    assert run(once.windowed(read(), "t", "1 hour", "10 minutes", None, ["u"], "v"), "windowed_").agg(F.sum("total")).first()[0] == 16.0
    assert run(once.sessions(read(), "t", "1 hour", "10 minutes", ["u"]), "sessions_").count() == 3
    assert run(once.first_seen(read(), "u", "t", "1 hour"), "first_").count() == 2


def pgm(g):
    return b"P5 %d %d 255\n" % (g.shape[1], g.shape[0]) + np.clip(np.round(g), 0, 255).astype(np.uint8).tobytes()


def smooth(g, sigma):
    k = np.exp(-0.5 * (np.arange(-3 * int(sigma + 1), 3 * int(sigma + 1) + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        g = np.apply_along_axis(lambda v: np.convolve(np.pad(v, len(k) // 2, mode="reflect"), k, "valid"), axis, g)
    return g


def test_pixel_measures(spark):
    """A sharp board, blurred by two amounts, a flat one; hashes of a scene, lighter and inverted."""
    r = np.random.default_rng(1)
    y, x = np.mgrid[0:240, 0:320]
    sharp = np.where((x // 12 + y // 12) % 2 == 0, 255, 30) + r.integers(-20, 20, x.shape)
    scene = np.clip(60 + x * 0.3 + 60 * ((x - 150) ** 2 + (y - 90) ** 2 < 2500), 0, 190)
    images = {"sharp": sharp, "soft": smooth(sharp, 2.2), "blurry": smooth(sharp, 9), "flat": np.full(x.shape, 128), "scene": scene, "again": scene, "light": scene + 60, "inverted": 255 - scene}
    rows = [(k, bytearray(pgm(g))) for k, g in images.items()] + [("cut", bytearray(pgm(sharp)[:500])), ("none", None), ("other", bytearray(b"GIF89a"))]
    df = spark.createDataFrame(rows, "k string, content binary")
    blur = {x["k"]: x["b"] for x in A.apply(df, "blur", "pixels", "content", "b", "struct<sharp_score:double,med_score:double,label:string>").collect()}
    assert blur["sharp"]["label"] == "sharp" and blur["blurry"]["label"] == "blurry" and blur["flat"]["sharp_score"] == 0
    assert blur["blurry"]["sharp_score"] < blur["soft"]["sharp_score"] < blur["sharp"]["sharp_score"] and blur["cut"] is blur["none"] is blur["other"] is None
    h = {x["k"]: x["h"] for x in A.apply(df, "hash", "pixels", "content", "h", "bigint").collect()}
    far = lambda a, b: bin((h[a] ^ h[b]) & (1 << 64) - 1).count("1")
    assert far("scene", "again") == 0 and far("scene", "light") <= 8 and far("scene", "inverted") > 16
    edges = A.apply(df.filter("k in ('flat', 'sharp')"), "edges", "pixels", "content", "e", "struct<height:int,width:int,edges:array<double>,top:double>").select("k", "e.*")
    got = edges.select("k", S.screenshot_suspect(F.lit(100), F.lit(220), F.col("edges"), F.col("top")), S.screenshot_suspect(F.lit(100), F.lit(150), F.col("edges"), F.col("top"))).collect()
    assert {tuple(r) for r in got} == {("flat", True, False), ("sharp", False, False)}
    red = np.zeros((20, 30, 3), np.uint8)
    red[:, :, 0] = 200
    t = pixels.tone_stats(pixels.read(b"P6\n# made here\n30 20\n255\n" + red.tobytes()))
    assert t["sat"] == 1.0 and abs(t["p99"] - 200 * 0.299 / 255) < 1e-9
    assert pixels.first_readable(None, b"", pgm(sharp)).shape == (240, 320) and pixels.shrunk(pixels.read(pgm(sharp)), 48).shape == (36, 48)


def test_services_and_things_found(spark):
    df = spark.createDataFrame([("a", bytearray(b"two words")), ("b", bytearray(b"")), ("c", None)], "k string, content binary")
    got = {(r["k"], r["t"]["text"]) for r in A.found(df, "text", "stub", "content", "t", "struct<text:string,confidence:double>").collect()}
    assert got == {("a", "two"), ("a", "words")}

    def make():
        def run(data):
            if not data:
                raise A.RateLimited("later")
            return len(data)

        return run

    A.register("counter", "here")(make)
    rows = {r["k"]: (r["result"], r["error"]) for r in A.call(df, "counter", "here", "content", "bigint", waits=(0, 0)).collect()}
    assert rows == {"a": (9, None), "b": (None, "rate limited: later"), "c": (None, None)}


def test_text_regions_and_heads(spark):
    rows = [([(" a ", 0.9), ("", 0.9), ("b", 0.2), ("d", 0.52), ("c" * 700, 0.6)],), ([],), (None,)]
    out = [r["x"] for r in spark.createDataFrame(rows, "r array<struct<text:string,confidence:double>>").select(X.text_regions("r").alias("x")).collect()]
    assert (out[0]["n_regions"], out[0]["mean_conf"], len(out[0]["text"])) == (2, 0.75, 600) and tuple(out[1]) == tuple(out[2]) == (0, 0.0, "")
    assert spark.range(1).select(X.linear_head(F.array(F.lit(1.0), F.lit(2.0)), [0.5, 0.25], 3.0)).first()[0] == 4.0


def looped_step(photos, groups, members, done, hidden, append, near, alike, cap=40):
    """The grouping step as plain loops over photos {id: (source, at, code, vector, digest, score)}."""
    import math

    def bits(a, b):
        return bin((a ^ b) & (2**64 - 1)).count("1")

    def strong(a, b, limit):
        x, y = photos[a], photos[b]
        if x[4] is not None and x[4] == y[4]:
            return True
        if x[0] != y[0] or x[1] is None or y[1] is None:
            return False
        gap = abs(x[1] - y[1])
        if x[2] is not None and y[2] is not None and gap <= limit[1] and bits(x[2], y[2]) <= limit[0]:
            return True
        dot = sum(p * q for p, q in zip(x[3], y[3])) / (math.hypot(*x[3]) * math.hypot(*y[3]))
        return gap <= alike[1] and dot >= alike[0]

    held = {a for _, a in members}
    todo = sorted(a for a in photos if a not in held and a not in done and a not in hidden)
    out, taken = set(), set()
    for g, best in sorted(groups):
        for a in todo:
            if best not in hidden and a not in taken and strong(a, best, append):
                taken.add(a)
                out.add((g, a, "append", False))
    rest = [a for a in todo if a not in taken]
    pairs = set()
    for a in rest:
        for b in photos:
            timed = photos[a][2] is not None and photos[b][2] is not None
            if b != a and b not in taken and (b in rest or b not in held):
                x, y = photos[a], photos[b]
                same = b in rest and x[4] is not None and x[4] == y[4]
                apart = x[0] != y[0] or x[1] is None or y[1] is None or not timed or abs(x[1] - y[1]) > near[1]
                if same or not apart and strong(a, b, near):
                    pairs.add((min(a, b), max(a, b)))
    near_of = {}
    for a, b in pairs:
        near_of.setdefault(a, set()).add(b)
        near_of.setdefault(b, set()).add(a)
    order = sorted(near_of, key=lambda x: (-len(near_of[x]), x))
    used, number = set(), max((int(g[4:]) for g, _ in members), default=-1) + 1
    for s in order:
        free = sorted((m for m in near_of[s] if m not in used), key=lambda x: (-len(near_of[x]), x))
        if s in used or not free:
            continue
        cluster = [s, *free][:cap]
        used.update(cluster)
        best = max(cluster, key=lambda a: (photos[a][5], a))
        out |= {(f"sim_{number:07d}", a, "new", a == best) for a in cluster}
        number += 1
    return out, set(todo)


def test_grouping_step(spark):
    """Both phases over photos with copies, near codes, alike vectors, without times, done, hidden and grouped; then a
    second run that finds nothing, and a third with late arrivals."""
    import random

    from tessella.operators import grouping as E

    r = random.Random(21)
    bounds = dict(append=(4, 300), near=(6, 900), alike=(0.96, 90))
    centres = [[r.gauss(0, 1) for _ in range(4)] for _ in range(6)]
    codes = [r.getrandbits(63) for _ in range(6)]

    def photo(i):
        k = r.randrange(6)
        code = codes[k] ^ sum(1 << b for b in r.sample(range(63), r.randrange(6)))
        vector = [x + r.gauss(0, 0.15) for x in centres[k]]
        digest = r.choice([None, None, None, f"d{r.randrange(25)}"])
        return (r.choice("xy"), None if r.random() < 0.05 else float(r.randrange(3000)), None if r.random() < 0.05 else code, vector, digest, r.random())

    photos = {f"a{i:03d}": photo(i) for i in range(150)}
    members = [(f"sim_{g:07d}", f"a{3 * g + j:03d}") for g in range(8) for j in range(2)]
    groups = [(f"sim_{g:07d}", f"a{3 * g:03d}") for g in range(8)]
    done, hidden = {f"a{i:03d}" for i in range(30, 60, 3)}, {"a000", "a100", "a101"}
    for again in range(3):
        if again == 2:
            photos |= {f"b{i:03d}": photo(i) for i in range(40)}
        ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "asset_id string")
        frame = spark.createDataFrame([(k, *v) for k, v in photos.items()], "asset_id string, source string, at double, code long, vector array<double>, digest string, score double")
        new, seen = E.similar_step(frame, spark.createDataFrame(groups, "group_id string, best string"), spark.createDataFrame(members, "group_id string, asset_id string"), ids(done), ids(hidden), **bounds)
        rows = {tuple(x) for x in new.select("group_id", "asset_id", "phase", "is_best").collect()}
        want, todo = looped_step(photos, groups, members, done, hidden, bounds["append"], bounds["near"], bounds["alike"])
        assert rows == want and {x[0] for x in seen.collect()} == todo
        assert (len(rows) > 10) == (again != 1)
        members += [(g, a) for g, a, _, _ in rows]
        groups += [(g, a) for g, a, _, best in rows if best]
        done |= todo


def test_components_by_batches(spark):
    """Any split of links into batches gives the components of all of them."""
    import random

    from tessella.operators import graph as G
    from tessella.operators import grouping as E

    r = random.Random(4)
    links = [(r.randrange(120), r.randrange(120)) for _ in range(80)] + [(None, 3), (5, 5)]
    whole = {(x["node"], x["component"]) for x in G.components(spark.createDataFrame([x for x in links if x[0] != x[1]], "a int, b int")).collect()} | {(5, min(5, *[5]))}
    labels = spark.createDataFrame([], "node int, component int")
    for k in range(3):
        out = E.extend_components(labels, spark.createDataFrame(links[k::3], "a int, b int"))
        labels = spark.createDataFrame([(x["node"], x["component"]) for x in out.collect()], labels.schema)
    got = {(x["node"], x["component"]) for x in labels.collect()}
    assert {x for x in got if x[0] != 5} == {x for x in whole if x[0] != 5} and len(got) == len({n for n, _ in got})
    same = E.extend_components(labels, spark.createDataFrame(links, "a int, b int"))
    assert same.filter("changed").count() == 0 and same.count() == len(got)


def test_people_and_crops(spark):
    import pytest

    from tessella.operators import people as P
    from tessella.operators.mutations import ConstraintError

    faces = spark.createDataFrame([(1, "a", 0, 7, False), (2, None, 0, 7, False), (3, None, 1, 7, False), (4, None, 0, 8, False)], "face_id long, person_id string, person_locked int, cluster_id long, ignored boolean")
    people = spark.createDataFrame([("a", "Ann", None), ("b", "Bo", None)], "person_id string, display_name string, avatar long")
    given = lambda *rows: spark.createDataFrame(list(rows), "face_id long, person_id string")
    rows = lambda df: {r["face_id"]: (r["person_id"], r["person_locked"], r["ignored"]) for r in df.collect()}
    assert rows(P.assign_faces(faces, given((1, None), (4, "a"), (4, "b")), people)) == {1: (None, 1, False), 2: (None, 0, False), 3: (None, 1, False), 4: ("b", 1, False)}
    with pytest.raises(ConstraintError):
        P.assign_faces(faces, given((1, "nobody")), people)
    clusters = spark.createDataFrame([(7, "b", None), (8, None, True)], "cluster_id long, person_id string, ignored boolean")
    assert rows(P.assign_clusters(faces, clusters)) == {1: ("a", 0, False), 2: ("b", 0, False), 3: (None, 1, False), 4: (None, 0, True)}
    named = spark.createDataFrame([("a", "Anna"), ("c", "Cy")], "person_id string, display_name string")
    avatars = spark.createDataFrame([("a", 1), ("b", 1)], "person_id string, face_id long")
    p, f = P.edit_people(people, faces, named, avatars, people.filter("person_id = 'b'"))
    assert {tuple(x) for x in p.collect()} == {("a", "Anna", 1), ("c", "Cy", None)} and rows(f)[1][0] == "a"
    assert rows(P.edit_people(people, faces, gone=people.filter("person_id = 'a'"))[1])[1][0] is None
    crops = spark.createDataFrame([("x", 0.0, 0.0, 0.5, 0.5)], "asset_id string, x double, y double, w double, h double")
    new = spark.createDataFrame([("y", 0.5, 0.5, 0.5, 0.5), ("x", 0.1, 0.1, 0.2, 0.2)], crops.schema)
    out = P.edit_crops(crops, new, crops.select("asset_id"))
    assert [r["asset_id"] for r in out.collect()] == ["y"]
    with pytest.raises(ConstraintError):
        P.edit_crops(crops, spark.createDataFrame([("y", 0.6, 0.5, 0.5, 0.5)], crops.schema), crops)


def test_answers_as_json(spark):
    A.register("asker", "here2")(lambda: lambda x: {1: 'say {"kind": "doc", "n": 2}', 2: "no", 3: '```json\n{"kind": "x"}\n```'}[len(x)])
    df = spark.createDataFrame([("a", "1"), ("b", "22"), ("c", "333"), ("d", None)], "k string, content string")
    out = {r["k"]: (r["answer"] and tuple(r["answer"]), r["error"]) for r in A.ask_json(df, "asker", "here2", "content", "kind string, n int").collect()}
    assert out["a"] == (("doc", 2), None) and out["c"] == (("x", None), None) and out["d"] == (None, None)
    assert out["b"][0] is None and out["b"][1].startswith("no such JSON")
