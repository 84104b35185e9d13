"""Timers of misses, joins of streams, a sink that publishes once, digests of large files."""

import datetime as dt
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tessella.sources import tables as T
from tessella.streaming import once, retries

START = dt.datetime(2026, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def run(df, checkpoint, path):
    df.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start().awaitTermination(120)


def test_misses_with_timers(spark, tmp_path):
    """Fail, wait, retry, give up; the query is restarted from its checkpoint before each batch."""
    spark.conf.set(*retries.STORE)
    src, ck, out = (str(tmp_path / x) for x in ("in", "ck", "out"))
    schema = "asset_id string, step string, at timestamp, ok boolean"

    def arrive(*rows):
        spark.createDataFrame([(a, "vision", at(s), ok) for a, s, ok in rows], schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        run(retries.retried(stream, "0 seconds", wait=60, most=3), ck, out)
        return sorted((r["asset_id"], r["what"], r["attempts"]) for r in spark.read.parquet(out).collect())

    try:
        assert arrive(("a", 0, False), ("b", 0, False), ("c", 0, True)) == [("a", "missed", 1), ("b", "missed", 1), ("c", "done", 1)]
        seen = arrive(("z", 30, True))
        assert ("a", "due", 1) not in seen
        seen = arrive(("z", 61, True))
        assert [x for x in seen if x[1] == "due"] == [("a", "due", 1), ("b", "due", 1)]
        seen = arrive(("a", 70, False), ("b", 70, True))
        assert ("a", "missed", 2) in seen and ("b", "done", 2) in seen
        seen = arrive(("z", 180, True))
        assert ("a", "due", 2) not in seen  # the second wait is twice as long: 70 + 120
        seen = arrive(("z", 195, True))
        assert ("a", "due", 2) in seen and ("b", "due", 2) not in seen
        seen = arrive(("a", 200, False), ("z", 200, True))
        assert ("a", "gave up", 3) in seen
        before = len(seen)
        seen = arrive(("a", 300, False), ("z", 900, True))
        assert len(seen) == before + 1 and not [x for x in seen if x[0] == "a" and x[2] > 3]
    finally:
        spark.conf.unset(retries.STORE[0])


def test_interval_join_of_streams(spark, tmp_path):
    """The pairs of rows that aren't late are those of the whole tables; late rows are left out."""
    schema = "id long, src string, at timestamp"
    rows = [[(100 * s + i, "xy"[i % 2], at(37 * i % 400 + 400 * k)) for i in range(12)] for k, s in ((0, 1), (1, 2), (2, 3))]
    late = [(999, "x", at(5))]
    paths = [str(tmp_path / x) for x in ("left", "right")]
    for k, part in enumerate([*rows, late]):
        for side, p in enumerate(paths):
            data = [(i + 10_000 * side, s, t + dt.timedelta(seconds=11 * side)) for i, s, t in part]
            spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(p)
        streams = [spark.readStream.schema(schema).parquet(p) for p in paths]
        run(once.interval_pairs(*streams, "src", "at", "id", 90, "60 seconds"), str(tmp_path / "ck"), str(tmp_path / "out"))
    got = sorted((r["a"], r["b"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    flat = [x for part in rows for x in part]
    want = sorted((i, j + 10_000) for i, s, t in flat for j, u, v in flat if s == u and abs((t - v).total_seconds() - 11) <= 90)
    assert got == want and len(want) > 20


def test_publish_once(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    assert T.published(spark, folder, "id long").count() == 0 and T.result_lines(spark, folder) == []
    df = spark.range(5)
    assert T.publish(df, folder, 0) and not T.publish(df, folder, 0) and not T.publish(spark.range(50), folder, 0)
    bad = spark.range(4).select((1 / (F.col("id") - 3)).alias("id"), F.raise_error(F.lit("no")).alias("x")).repartition(3)
    with pytest.raises(Exception, match="no|DIVIDE"):
        T.publish(bad, folder, 1)
    assert sorted(os.listdir(f"{tmp_path}/out")) in (["_staging", "batch=0"], [".batch=0.crc", "_staging", "batch=0"]) and os.listdir(f"{tmp_path}/out/_staging") == []
    assert T.publish(spark.range(5, 7), folder, 1)
    rows = T.published(spark, folder, "id long")
    assert sorted((r["batch"], r["id"]) for r in rows.collect()) == [*(("0", i) for i in range(5)), ("1", 5), ("1", 6)]
    assert [(r["batch"], r["rows"]) for r in T.result_lines(spark, folder)] == [("0", 5), ("1", 2)]


def test_publish_a_stream(spark, tmp_path):
    """A batch that a restarted stream handles again is published once."""
    src, folder = str(tmp_path / "in"), f"file://{tmp_path}/out"
    spark.range(6).write.parquet(src)
    stream = lambda: spark.readStream.schema("id long").parquet(src)
    for _ in range(2):  # the second run has lost its checkpoint, so it gives batch 0 again
        once.process_available(stream(), lambda df, i: T.publish(df, folder, i), str(tmp_path / f"ck{_}")).awaitTermination(60)
    assert T.published(spark, folder, "id long").count() == 6


def test_digests_of_large_files(spark, tmp_path):
    big, small = tmp_path / "big.mp4", tmp_path / "small"
    with open(big, "wb") as f:
        f.truncate((2 << 30) + 12_345)  # sparse
    small.write_bytes(b"abc")
    state = hashlib.sha256()
    for _ in range(2 << 10):
        state.update(bytes(1 << 20))
    state.update(bytes(12_345))
    paths = spark.createDataFrame([(f"file://{big}",), (str(small),), (f"file://{tmp_path}/none",)], "path string")
    got = {os.path.basename(r["path"]): r for r in T.large_file_digests(paths).collect()}
    assert (got["big.mp4"]["sha256"], got["big.mp4"]["byte_size"]) == (state.hexdigest(), (2 << 30) + 12_345)
    assert got["small"]["sha256"] == hashlib.sha256(b"abc").hexdigest() and got["none"]["sha256"] is None and got["none"]["error"]
    same = T.file_digests(T.binary_files(spark, str(tmp_path), "small")).first()
    assert same["sha256"] == got["small"]["sha256"]


def test_first_existing_takes_the_least_value(spark):
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "asset_id string")
    one = spark.createDataFrame([("a", "z"), ("a", "y")], "asset_id string, path string")
    two = spark.createDataFrame([("a", "b"), ("b", "q")], "asset_id string, path string")
    assert sorted((r["asset_id"], r["path"]) for r in T.first_existing(wanted, one, two).collect()) == [("a", "y"), ("b", "q"), ("c", None)]
