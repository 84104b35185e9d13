import pytest
from pyspark.sql import functions as F

from tessella.operators import incremental as I
from tessella.operators import mutations as C


@pytest.fixture
def tags(spark):
    rows = [("a1", "儿童", "vlm", 0.8), ("a2", "儿童", "vlm", 0.9), ("a3", "乐器", "vlm", 0.7), ("a1", "户外", "vlm", 0.6)]
    return spark.createDataFrame(rows, "asset_id string, tag string, source string, confidence double")


def test_move_tag(tags):
    out, n = C.move_tag(tags, ["a1", "a2"], "儿童", "乐器")
    assert n == {"removed": 2, "added": 2}
    assert {(r["tag"], r["source"], r["confidence"]) for r in out.filter("asset_id = 'a1'").collect()} == {("乐器", "manual", 1.0), ("户外", "vlm", 0.6)}
    again, m = C.move_tag(out, ["a1", "a2"], "儿童", "乐器")
    assert m == {"removed": 0, "added": 0} and again.count() == out.count()
    only, k = C.move_tag(tags, ["a3"], None, "儿童")
    assert k == {"removed": 0, "added": 1} and only.filter("asset_id = 'a3'").count() == 2
    for bad in ((["a1"], "x", ""), ([], "x", "y"), (["a1"], "x", "x")):
        with pytest.raises(C.ConstraintError):
            C.move_tag(tags, *bad)


def test_replace_tags(spark, tags):
    fresh = spark.createDataFrame([("a1", "海", "VLM", 0.75)], tags.schema)
    got = {(r["asset_id"], r["tag"]) for r in C.replace_tags(tags, fresh, "vlm").collect()}
    assert got == {("a1", "海"), ("a2", "儿童"), ("a3", "乐器")}


@pytest.fixture
def faces(spark):
    rows = [("f1", "asset_1", "p_a", "auto", 0), ("f2", "asset_1", "p_a", "auto", 0), ("f3", "asset_1", "p_c", "auto", 0)]
    return spark.createDataFrame(rows, "face_instance_id string, asset_id string, person_id string, sample_role string, person_locked int")


def test_reassign(spark, faces):
    people = spark.createDataFrame([("p_a",), ("p_b",)], "person_id string")
    out, n = C.reassign_person(faces, people, "asset_1", "p_a", "p_b")
    got = {r["face_instance_id"]: (r["person_id"], r["person_locked"]) for r in out.collect()}
    assert n == 2 and got == {"f1": ("p_b", 1), "f2": ("p_b", 1), "f3": ("p_c", 0)}
    blank, _ = C.reassign_person(faces, people, "asset_1", "p_a", "  ")
    assert blank.filter("person_id is null and person_locked = 1").count() == 2
    for bad in (("asset_1", "p_a", "p_a"), ("", "p_a", "p_b"), ("asset_1", "p_a", "nobody"), ("asset_9", "p_a", "p_b")):
        with pytest.raises(C.ConstraintError):
            C.reassign_person(faces, people, *bad)


def test_protected_faces_survive(spark, faces):
    people = spark.createDataFrame([("p_a",), ("p_b",)], "person_id string")
    out, _ = C.reassign_person(faces, people, "asset_1", "p_a", "p_b")
    out = out.union(spark.createDataFrame([("f4", "asset_1", "p_c", "manual", 0)], out.schema))
    assert sorted(r["face_instance_id"] for r in C.clear_detected(out, "asset_1").collect()) == ["f1", "f2", "f4"]


def test_layout(spark):
    empty = spark.createDataFrame([], "kind string, target string, parent string, sort_order int, show_on_home int")
    out = C.sort_layout(empty, "category", ["x", "y"], "person")
    assert [(r["target"], r["sort_order"], r["parent"], r["show_on_home"]) for r in out.orderBy("target").collect()] == [("x", 0, "person", 1), ("y", 1, "person", 1)]
    out = C.sort_layout(out, "category", ["y", "x"], "person")
    assert [(r["target"], r["sort_order"]) for r in out.orderBy("target").collect()] == [("x", 1), ("y", 0)]
    assert C.sort_layout(empty, "k", ["a"]).first()["parent"] == ""
    with pytest.raises(C.ConstraintError):
        C.sort_layout(empty, "k", [])


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, s string, n int")
    new = spark.createDataFrame([(2, None, 20), (3, "c", 30)], "k int, s string, n int")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(C.replace(old, new, ["k"])) == [(1, "a", 1), (2, None, 20), (3, "c", 30)]
    assert rows(C.ignore(old, new, ["k"])) == [(1, "a", 1), (2, "b", 2), (3, "c", 30)]
    assert rows(C.upsert(old, new, ["k"], {"s": "coalesce", "n": "new"})) == [(1, "a", 1), (2, "b", 20), (3, "c", 30)]
    empty = old.limit(0)
    assert rows(C.upsert(old, empty, ["k"])) == rows(old)
    once = C.upsert(old, new, ["k"])
    assert rows(C.upsert(once, new, ["k"])) == rows(once)
    with pytest.raises(C.ConstraintError):
        C.enforce(old, checks={"positive": F.col("n") > 1})
    assert C.enforce(old, key=["k"], parent=(new.union(old), "k", "k")) is old
    assert {r["constraint"] for r in C.violations(new, parent=(old, "k", "k")).collect()} == {"parent"}


def test_marks_and_steps(spark):
    assets = spark.createDataFrame([(f"a{i}",) for i in range(4)], "asset_id string")
    state = spark.createDataFrame([], "asset_id string, step string, version string")
    misses = spark.createDataFrame([], "asset_id string, step string")

    def half(todo):
        return todo.withColumn("missed", F.col("asset_id") >= "a2")

    def broken(todo):
        raise RuntimeError("no model")

    steps = [I.Step("half", half), I.Step("broken", broken), I.Step("all", lambda t: t)]
    state, misses, out, report = I.run_steps(assets, state, misses, steps)
    assert report.done == {"half": 2, "all": 4} and "no model" in report.errors["broken"]
    state2, misses2, _, report2 = I.run_steps(assets, state, misses, steps)
    assert report2.done == {"half": 0, "all": 0} and state2.count() == state.count() and misses2.count() == 2
    assert I.backlog(assets, state, "half", misses=I.retry(misses, "half")).count() == 2
    assert I.backlog(assets, state, "all", version="2").count() == 4


def test_repeated_keys_of_a_delta(spark):
    """The last row of a key counts, for ignore the first; an order may say which that is."""
    old = spark.createDataFrame([(1, "a", 1)], "k int, s string, n int")
    new = spark.createDataFrame([(1, "x", 5), (1, "y", 4), (2, "p", 1), (2, "q", 0)], "k int, s string, n int")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(C.replace(old, new, ["k"])) == rows(C.upsert(old, new, ["k"])) == [(1, "y", 4), (2, "q", 0)]
    assert rows(C.replace(old, new, ["k"], [F.col("n")])) == rows(C.upsert(old, new, ["k"], order=[F.col("n")])) == [(1, "x", 5), (2, "p", 1)]
    assert rows(C.ignore(old, new, ["k"])) == [(1, "a", 1), (2, "p", 1)] and rows(C.ignore(old, new, ["k"], [F.col("n")])) == [(1, "a", 1), (2, "q", 0)]
    assert C.last_of(new.select("k"), ["k"]).count() == 2


def test_a_step_runs_once(spark):
    """A step that misses half of its assets, and gives another half each time it is run: it runs once for each
    asset, and every asset is either marked or missed."""
    runs = spark.sparkContext.accumulator(0)

    def work(todo):
        def each(parts):
            import random

            for p in parts:
                runs.add(len(p))
                yield p.assign(missed=[random.random() < 0.5 for _ in range(len(p))])

        return todo.mapInPandas(each, "asset_id string, missed boolean")

    assets = spark.createDataFrame([(f"a{i:02d}",) for i in range(40)], "asset_id string")
    state = spark.createDataFrame([], "asset_id string, step string, version string")
    misses = spark.createDataFrame([], "asset_id string, step string")
    state, misses, out, report = I.run_steps(assets, state, misses, [I.Step("work", work)], limit=30)
    ids = lambda df: sorted(r["asset_id"] for r in df.collect())
    assert runs.value == 30 and report.done["work"] == out["work"].count() == state.count()
    assert ids(state) == ids(out["work"]) and sorted(ids(state) + ids(misses)) == [f"a{i:02d}" for i in range(30)]


def test_update_from_takes_one_change_a_key(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (None, "c", 0)], "k int, s string, n int")
    changes = spark.createDataFrame([(1, "x", 5), (1, "y", 4), (3, "z", 1), (None, "w", 1)], "k int, s string, n int")
    rows = lambda df: sorted(map(repr, map(tuple, df.collect())))
    assert rows(C.update_from(old, changes, ["k"], ["s"])) == rows(spark.createDataFrame([(1, "y", 0), (2, "b", 0), (None, "c", 0)], old.schema))
    assert rows(C.update_from(old, changes, ["k"], ["s"], [F.col("n")]))[0] == repr((1, "x", 0))


def test_decision_log_keeps_assets_away(spark):
    assets = spark.createDataFrame([("a",), ("b",)], "asset_id string")
    state = spark.createDataFrame([], "asset_id string, step string, version string")
    removed = spark.createDataFrame([("b",)], "asset_id string")
    assert [r[0] for r in I.backlog(assets, state, "privacy", gone=removed).collect()] == ["a"]
