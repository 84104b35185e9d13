"""Operators whose tasks stay small: same results in parts as at once."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import relational as R
from tessella.operators import search as Q


@pytest.mark.parametrize("most", [512, 10])
def test_alike_within(spark, monkeypatch, most):
    """Missing tags and days, repeated ids and tags, by products and by joins."""
    monkeypatch.setattr(Q, "TASK_CANDIDATES", most)
    r = random.Random(1)
    rows = [(i % 7 or None, f"k{r.randrange(40)}", r.choice(["x", "y", None]), r.choice([None, [], [None, "a"], r.choices("abcdef", k=4)])) for i in range(120)]
    want = []
    for q, a, d, s in rows:
        for p, b, e, t in rows:
            if q is not None and q == p and a < b:
                both = len(set(s) & set(t)) / len(set(s) | set(t)) if s and t else 0.0
                want.append((q, a, b, 0.5 * (d == e) + 0.5 * both))
    got = Q.alike_within(spark.createDataFrame(rows, "q int, k string, d string, t array<string>").withColumn("t", F.array_distinct("t")), "q", "k", "d", "t")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert most < 20 or "SortMergeJoin" not in got._jdf.queryExecution().optimizedPlan().toString() and "Join Inner" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_left_distinct_is_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(R, "TASK_ROWS", 20)
    left = spark.createDataFrame([(i,) for i in range(60)] + [(3,), (None,)], "k int")
    right = spark.createDataFrame([(i % 40, i % 3 or None) for i in range(400)], "k int, v int")
    got = R.left_distinct(left, right, "k", "v", "n")
    want = {i: len({j % 3 for j in range(400) if j % 40 == i and j % 3}) for i in range(60)} | {None: 0}
    assert {x["k"]: x["n"] for x in got.collect()} == want and got.count() == 61
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert R.left_distinct(left, right, "k", "v", "n").rdd.getNumPartitions() == 24
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_gram_index_is_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(Q, "TASK_GRAMS", 500)
    df = spark.range(400).select("id", F.concat(F.lit("same "), F.col("id").cast("string")).alias("t"))
    dealt = Q.dealt_by_gram(Q.trigram_index(df, "id", "t"), df, "id", "t")
    want = sorted(map(tuple, Q.trigram_index(df, "id", "t").collect()))
    assert sorted(map(tuple, dealt.collect())) == want
    hot = dealt.withColumn("p", F.spark_partition_id()).filter("gram = 'sam'").groupBy("p").count()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert hot.count() > 1 and max(x["count"] for x in hot.collect()) < 400
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
