"""Catalogue compositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import adapters as A
from ..functions import expr as X
from ..operators import library as L
from ..operators import scoring as S
from ..operators import similarity as M
from ..sources.tables import table
from .catalog import query


@query()
def incremental_grouping(spark, sf_dir):
    """Documents of even id are grouped by their text already; the odd ones come anew."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("d"), F.concat(F.lit("a"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("asset_id"))
    old, new = d.filter("doc_id % 2 = 0"), d.filter("doc_id % 2 = 1")
    firsts = old.groupBy("d").agg(F.min("doc_id").alias("g"), F.count("*").alias("n")).filter("n > 1").select("d", X.serial_id("sim_", "g").alias("group_id"))
    members = old.join(firsts, "d").select("group_id", "asset_id")
    links = M.digest_links(new, "asset_id", "d").select(F.col("first").alias("a"), F.col("asset_id").alias("b"))
    return L.extend_groups(members, new, [new.join(firsts, "d").select("asset_id", "group_id")], links)


@query("SELECT event_id AS asset_id, t AS trip_id FROM events JOIN (VALUES ('t1', DATE '2024-01-03', DATE '2024-01-07'), ('t2', DATE '2024-01-06', DATE '2024-01-09')) v(t, a, b) ON CAST(ts AS DATE) BETWEEN a AND b")
def trip_assignment(spark, sf_dir):
    trips = spark.createDataFrame([("t1", "2024-01-03", "2024-01-07"), ("t2", "2024-01-06", "2024-01-09")], "trip_id string, first_day string, last_day string")
    trips = trips.withColumns({c: F.to_date(c) for c in ("first_day", "last_day")})
    return L.assign_trips(table(spark, sf_dir, "events").select(F.col("event_id").alias("asset_id"), F.to_date("ts").alias("day")), trips)


@query(
    """
SELECT o_orderkey AS asset_id, coalesce(array_to_string(t, ','), '') AS tags, coalesce(array_to_string(p, ','), '') AS people FROM orders
LEFT JOIN (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS t, list_sort(list(DISTINCT CAST(l_suppkey AS VARCHAR))) AS p FROM lineitem WHERE l_quantity > 10 GROUP BY 1) ON l_orderkey = o_orderkey"""
)
def asset_cards(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity > 10").select(F.col("l_orderkey").alias("asset_id"), F.col("l_returnflag").alias("tag"), F.col("l_suppkey").cast("string").alias("person_id"))
    c = L.cards(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("asset_id")), lines, lines)
    return c.select("asset_id", F.array_join("tags", ",").alias("tags"), F.array_join("people", ",").alias("people"))


@query(
    """
SELECT s_suppkey AS person_id, coalesce(f, 0) AS faces, coalesce(a, 0) AS assets FROM supplier
LEFT JOIN (SELECT l_suppkey, count(*) AS f, count(DISTINCT l_orderkey) AS a FROM lineitem WHERE l_tax > 0.07 GROUP BY 1) ON l_suppkey = s_suppkey"""
)
def people_list(spark, sf_dir):
    faces = table(spark, sf_dir, "lineitem").filter("l_tax > 0.07").select(F.col("l_suppkey").alias("person_id"), F.col("l_orderkey").alias("asset_id"))
    return L.people_counts(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("person_id")), faces)


@query(
    """
SELECT p_partkey AS asset_id, round_even(a * CASE WHEN label = 'blurry' THEN 0.5 WHEN label = 'soft' THEN 0.85 ELSE 1.0 END, 3) AS quality_score
FROM (SELECT p_partkey, CASE WHEN p_size < 15 THEN 'blurry' WHEN p_size < 30 THEN 'soft' ELSE 'sharp' END AS label, CASE WHEN p_partkey % 3 > 0 THEN p_retailprice / 100 - 10.3 END AS a FROM part WHERE p_partkey % 2 = 0)"""
)
def quality_merge(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "asset_id")
    blur = p.filter("asset_id % 2 = 0").select("asset_id", F.when(F.col("p_size") < 15, "blurry").when(F.col("p_size") < 30, "soft").otherwise("sharp").alias("label"))
    aes = p.filter("asset_id % 3 > 0").select("asset_id", (F.col("p_retailprice") / 100 - 10.3).alias("aesthetic"))
    return L.merge_quality(blur, aes)[0].select("asset_id", "quality_score")


@query(
    """
SELECT CASE WHEN c_custkey % 10 = 0 THEN 'manual' ELSE n_name END AS region, count(*) AS n, sum(CASE WHEN c_custkey % 4 > 0 THEN 1 ELSE 0 END) AS gps_n
FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1"""
)
def region_counts(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.select(F.col("c_custkey").alias("asset_id"), F.col("n_name").alias("region"), F.when(F.col("c_custkey") % 4 > 0, 1.0).alias("lat"))
    return L.regions(c.select("asset_id"), c, c.filter("asset_id % 10 = 0").select("asset_id", F.lit("manual").alias("region")))


@query(
    """
SELECT p_partkey, CASE WHEN p_size % 2 <> p_partkey % 2 THEN 'gender' WHEN abs(p_size - 25.0) > 3 THEN 'age' END AS flag FROM part"""
)
def paradox_flags(spark, sf_dir):
    flag = S.paradox(F.col("p_size") % 2, F.col("p_partkey") % 2, F.col("p_size"), F.lit(25.0))
    return table(spark, sf_dir, "part").select("p_partkey", flag.alias("flag"))


@query(
    """
WITH m AS (SELECT l_orderkey, count(*) AS n, list_sort(list(l_discount))[count(*) // 2 + 1] AS p1, list_sort(list(l_quantity))[count(*) // 2 + 1] AS p99, list_sort(list(l_tax))[count(*) // 2 + 1] AS sat FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN p1 >= 0.04 AND sat <= 0.04 AND p99 <= 30 THEN 1 ELSE 0 END AS is_log, CASE WHEN p1 >= 0.04 AND sat <= 0.04 AND p99 <= 30 THEN 0.75 ELSE 0.8 END AS confidence FROM m WHERE n >= 2"""
)
def log_visual_check(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_discount").alias("p1"), F.col("l_quantity").alias("p99"), F.col("l_tax").alias("sat"))
    return S.log_confirmed(f, "l_orderkey", 0.04, 0.04, 30.0).withColumn("confidence", F.col("confidence").cast("double"))


@query(
    """
SELECT page_id AS asset_id, CASE WHEN page_id % 2 = 0 THEN 0.0 ELSE round(page_id * p, 6) END AS seek FROM pages, (VALUES (0.1), (0.5), (0.9)) v(p) WHERE page_id % 2 = 1 OR p = 0.1"""
)
def frame_times(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("asset_id"), F.when(F.col("page_id") % 2 == 0, "photo").otherwise("video").alias("media_type"), F.col("page_id").cast("double").alias("duration"))
    return A.frames(p).select("asset_id", F.round("at", 6).alias("seek"))


@query(
    """
SELECT doc_id, 'DOC' AS filter_reason FROM documents WHERE doc_id % 3 = 0 AND doc_id % 10 >= 5 AND doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'MEME' FROM documents WHERE doc_id % 3 = 1 AND doc_id % 10 >= 5"""
)
def vision_filter(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("asset_id"), F.lit(True).alias("is_junk"), ((F.col("doc_id") % 10) / 10).alias("confidence"),
        F.element_at(F.array(F.lit("document"), F.lit("meme"), F.lit("odd")), (F.col("doc_id") % 3 + 1).cast("int")).alias("kind"),
    )
    faces = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("asset_id"))
    return S.vision_gate(d, faces, {"document": "DOC", "meme": "MEME"}, 0.5).withColumnRenamed("asset_id", "doc_id")


@query("SELECT vec_id, abs(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) - 1) <= 0.001 AND len(embedding) = 64 AS ok FROM embeddings")
def vector_contract(spark, sf_dir):
    """Whether each vector has 64 finite elements and the length 1."""
    e = table(spark, sf_dir, "embeddings")
    ok = (F.abs(X.norm("embedding") - 1) <= 1e-3) & (F.size("embedding") == 64) & ~F.exists("embedding", lambda x: F.isnan(x))
    return e.select("vec_id", ok.alias("ok"))
