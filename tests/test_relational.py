import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessella.operators import relational as R
from tessella.sources import tables as T
from tessella.sources.schema import Registry, SchemaError


@pytest.fixture(scope="module")
def catalogue(spark):
    assets = spark.createDataFrame([(f"a{i:03d}", dt.datetime(2026, 1, i, 10)) for i in range(1, 26)], "asset_id string, capture_time timestamp")
    filtered = spark.createDataFrame([("a001",)], "asset_id string")
    recycled = spark.createDataFrame([("a002",)], "asset_id string")
    return assets, filtered, recycled


def shown(catalogue, offset=0, limit=0):
    assets, filtered, recycled = catalogue
    rows = R.without(R.without(assets, filtered, "asset_id"), recycled, "asset_id")
    return R.page(rows, [F.col("capture_time").desc(), F.col("asset_id")], offset, limit).collect()


def test_pages(catalogue):
    one = shown(catalogue, 0, 10)
    assert len(one) == 10 and one[0]["total"] == 23 and one[0]["has_more"]
    pages = one + shown(catalogue, 10, 10) + shown(catalogue, 20, 10)
    assert [r["asset_id"] for r in pages] == [r["asset_id"] for r in shown(catalogue)]
    assert len(pages) == 23 and not pages[-1]["has_more"]
    assert len(shown(catalogue, 0, 99999)) == 23
    assert shown(catalogue, 100, 10) == []


def test_unpaged_listing_flags_hidden(catalogue):
    rows = {r["asset_id"]: r["hidden"] for r in R.flagged(*catalogue, "asset_id").collect()}
    assert len(rows) == 24 and rows["a001"] and "a002" not in rows and not rows["a003"]


def test_largest_file(spark):
    files = spark.createDataFrame([("a", "/x/small", 100), ("a", "/x/big", 9000), ("b", "/y", None)], "asset_id string, path string, byte_size long")
    got = {r["asset_id"]: r["path"] for r in R.largest(files, "asset_id", "byte_size", ["path"]).collect()}
    assert got == {"a": "/x/big", "b": "/y"}
    for odd in ("zzz", "' OR 1=1 --", "a'; DROP TABLE x"):
        assert spark.sql("SELECT * FROM {f} WHERE asset_id = :id", args={"id": odd}, f=files).count() == 0


def test_null_keys_exclude_nothing(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    gone = spark.createDataFrame([(1,), (None,)], "k int")
    assert sorted(r["k"] or 0 for r in R.without(df, gone, "k").collect()) == [0, 2]


def test_positions_and_serials(spark):
    df = spark.range(1000).withColumn("v", (F.col("id") * 7919) % 1000)
    got = R.positions(df, [F.col("v")], "at").collect()
    assert sorted(r["at"] for r in got) == list(range(1000)) and all(r["at"] == r["v"] for r in got)
    old = spark.createDataFrame([("sim_0000041",), ("manual",)], "group_id string")
    ids = [r["group_id"] for r in R.numbered(spark.range(3), [F.col("id")], old, "group_id", "sim_").orderBy("id").collect()]
    assert ids == ["sim_0000042", "sim_0000043", "sim_0000044"]


def test_positions_of_many_rows_with_further_columns(spark):
    """Two million rows with ties and carried columns: no row is lost or numbered twice."""
    n = 2_000_000
    df = spark.range(n).select((F.col("id") * 7919 % 1000).alias("v"), "id", F.concat(F.lit("x"), F.col("id")).alias("s"), F.array("id").alias("a"))
    out = R.positions(df, [F.col("v").desc()], "at")
    got = out.agg(F.count("*"), F.countDistinct("at"), F.min("at"), F.max("at"), F.countDistinct("id")).first()
    assert tuple(got) == (n, n, 0, n - 1, n)
    assert out.filter(F.col("v") != 999 - F.floor(F.col("at") / (n // 1000))).count() == 0


def test_pages_from_an_offset_on(spark):
    df = spark.range(50)
    rows = R.page(df, [F.col("id").desc()], offset=45).collect()
    assert sorted(r["id"] for r in rows) == [0, 1, 2, 3, 4] and {r["total"] for r in rows} == {50} and not any(r["has_more"] for r in rows)
    assert R.page(df, [F.col("id")], offset=100, limit=5).count() == 0


def test_optional_filters(spark):
    rules = {"least": lambda v: F.col("id") >= v, "only": lambda v: F.col("id").isin(v), "even": lambda v: F.col("id") % 2 == 0}
    assert R.optional_filters(spark.range(10), {"least": 6, "only": [], "even": False}, rules).count() == 4
    assert R.optional_filters(spark.range(10), {"least": None, "only": [1, 2], "even": True}, rules).count() == 1
    with pytest.raises(KeyError):
        R.optional_filters(spark.range(1), {"other": 1}, rules)


def test_even_picks(spark):
    df = spark.createDataFrame([("d", i) for i in range(10)] + [("e", 1), ("e", 2)], "day string, n int")
    got = sorted((r["day"], r["n"]) for r in R.even_picks(df, "day", [F.col("n")]).collect())
    assert got == [("d", 0), ("d", 3), ("d", 6), ("e", 1), ("e", 2)]


def test_sources(spark, tmp_path):
    p = str(tmp_path / "out")
    assert T.json_lines(spark, p, "asset_id string, n long").count() == 0
    df = spark.createDataFrame([("a", 1)], "asset_id string, n long")
    T.write_json_lines(df, p)
    T.write_json_lines(df, p, resume=True)
    assert T.json_lines(spark, p, "asset_id string, n long").count() == 2
    (tmp_path / "ids.txt").write_text("a\n\nb \nb\n")
    assert sorted(r[0] for r in T.id_list(spark, str(tmp_path / "ids.txt")).collect()) == ["a", "b"]
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin" / "f").write_bytes(b"abc")
    import hashlib

    assert T.file_digests(T.binary_files(spark, str(tmp_path / "bin"))).first()["sha256"] == hashlib.sha256(b"abc").hexdigest()
    thumbs = [spark.createDataFrame([("a", "one")], "asset_id string, path string"), spark.createDataFrame([("a", "two"), ("b", "three")], "asset_id string, path string")]
    want = spark.createDataFrame([("a",), ("b",), ("c",)], "asset_id string")
    assert {r["asset_id"]: r["path"] for r in T.first_existing(want, *thumbs).collect()} == {"a": "one", "b": "three", "c": None}
    assert T.markdown(df).splitlines()[-1] == "| a | 1 |"
    assert T.constants(spark, {"x": ("p", 1.0)}, "city", "province string, lat double").first()["province"] == "p"


def test_registry(spark, tmp_path):
    reg = Registry({f"t{i}": "id string, n long" for i in range(3)}, [("002", "t0", "extra string"), ("001", "t1", "n long, more int")])
    folder = str(tmp_path)
    assert reg.missing(spark, folder) == ["t0", "t1", "t2"]
    assert reg.ensure(spark, folder) == {"created": ["t0", "t1", "t2"], "applied": ["001", "002"]}
    assert reg.ensure(spark, folder) == {"created": [], "applied": []}
    assert reg.read(spark, folder, "t0").columns == ["id", "n", "extra"]
    assert reg.columns(spark).count() == 8
    spark.createDataFrame([("x",)], "id string").write.mode("overwrite").parquet(f"{folder}/t2.parquet")
    with pytest.raises(SchemaError):
        reg.ensure(spark, folder)


def test_migrations_are_applied_once(spark, tmp_path):
    folder = str(tmp_path)
    Registry({"t": "id string, n long"}).ensure(spark, folder)
    spark.createDataFrame([("a", 1)], "id string, n long").write.mode("append").parquet(f"{folder}/t.parquet")
    reg = Registry({"t": "id string, n long"}, [("002", "t", "late array<int>"), ("001", "t", "n long, more int")])
    assert reg.ensure(spark, folder) == {"created": [], "applied": ["001", "002"]}
    stored = spark.read.parquet(f"{folder}/t.parquet")
    assert stored.columns == ["id", "n", "more", "late"] and tuple(stored.first()) == ("a", 1, None, None)
    assert reg.ensure(spark, folder) == {"created": [], "applied": []}
    assert reg.extra(spark, ["t", "stranger"]) == ["stranger"]


def test_a_version_of_two_tables_goes_on_after_a_crash(spark, tmp_path):
    folder = str(tmp_path)
    tables, both = {"t": "id string", "u": "id string"}, [("001", "t", "n int"), ("001", "u", "n int")]
    Registry(tables).ensure(spark, folder)
    assert Registry(tables, both[:1]).ensure(spark, folder)["applied"] == ["001"]  # what a run had done when it ended
    reg = Registry(tables, both)
    assert reg.ensure(spark, folder)["applied"] == ["001"] and spark.read.parquet(f"{folder}/u.parquet").columns == ["id", "n"]
    assert reg.ensure(spark, folder)["applied"] == []


def test_undo(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, None, 2.0), (3, "c", 3.0)], "k int, s string, x double")
    new = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (4, "d", 4.0)], "k int, s string, x double")
    log = T.undo_log(old, new, ["k"], ["s", "x"])
    assert sorted(tuple(r) for r in log.collect()) == [(2, None, 2.0), (3, "c", 3.0)]
    assert sorted(tuple(r) for r in T.undo(new, log, ["k"], ["s", "x"]).collect()) == [(1, "a", 1.0), (2, None, 2.0), (4, "d", 4.0)]


def test_json_document(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"tables": [\n {"name": "a"}, {"name": "b"}\n]}')
    d = T.json_document(spark, str(tmp_path / "d.json"))
    assert [r["name"] for r in d.selectExpr("inline(tables)").collect()] == ["a", "b"]


def test_stored_tables_and_sweep(spark, tmp_path):
    import os

    for n in ("a", "b"):
        spark.range(1).write.parquet(f"{tmp_path}/{n}.parquet")
    assert T.stored(spark, str(tmp_path)) == ["a", "b"] and T.stored(spark, f"{tmp_path}/none") == []
    os.utime(f"{tmp_path}/a.parquet", (1, 1))
    assert T.sweep(spark, str(tmp_path)) == ["a.parquet"] and T.stored(spark, str(tmp_path)) == ["b"]
    x = T.cut(spark.range(3), "x")
    assert x.count() == 3 and T.exists(spark, x.written_to)
    T.discard(x)
    assert not T.exists(spark, x.written_to)
