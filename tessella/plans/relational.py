"""Relational queries: scans, filters, joins, windows, pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import relational as R
from ..sources.tables import table
from .catalog import query


@query(
    """
WITH best AS (
  SELECT l_orderkey, l_extendedprice FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem)
  WHERE rn = 1)
SELECT CAST(o_orderdate AS DATE) AS day, o_orderpriority, count(*) AS n_orders, round(sum(l_extendedprice), 2) AS largest_total, max(l_extendedprice) AS largest_one
FROM orders JOIN best ON o_orderkey = l_orderkey GROUP BY 1, 2"""
)
def flagship_largest_rollup(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    best = R.largest(lines, "l_orderkey", "l_extendedprice", ["l_linenumber", "l_partkey", "l_suppkey"])
    j = table(spark, sf_dir, "orders").join(best, F.col("o_orderkey") == F.col("l_orderkey"))
    return (
        j.groupBy(F.to_date("o_orderdate").alias("day"), "o_orderpriority")
        .agg(F.count("*").alias("n_orders"), F.round(F.sum("l_extendedprice"), 2).alias("largest_total"), F.max("l_extendedprice").alias("largest_one"))
        .orderBy("day", "o_orderpriority")
    )


@query("SELECT e.event_id, e.user_id, e.value FROM events e WHERE event_type = 'click' AND value IS NOT NULL AND props <> '' AND (value < 1 OR user_id IS NULL OR value > 50)")
def scan_filter_null(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    keep = (F.col("event_type") == "click") & F.col("value").isNotNull() & (F.col("props") != "")
    return e.filter(keep & ((F.col("value") < 1) | F.col("user_id").isNull() | (F.col("value") > 50))).select("event_id", "user_id", "value")


@query(
    """
SELECT doc_id, source, n_chars FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels f WHERE f.doc_id = d.doc_id AND f.toxic = 1 AND NOT EXISTS (SELECT 1 FROM labels a WHERE a.doc_id = f.doc_id AND a.quality = 1))"""
)
def hidden_minus_allowed(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return R.visible(docs, labels.filter("toxic = 1"), labels.filter("quality = 1"), "doc_id")


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_backlog(spark, sf_dir):
    return R.without(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars IN (SELECT n_chars FROM documents GROUP BY n_chars HAVING count(*) > 1)")
def semi_collision_bucket(spark, sf_dir):
    return R.colliding(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars")


@query("SELECT o_orderkey, o_totalprice FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 45)")
def not_exists_corr(spark, sf_dir):
    big = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.without(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), big, "o_orderkey")


@query("SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R') AND o_orderstatus IN ('F', 'O')")
def exists_semi(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.within(table(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("F", "O")).select("o_orderkey"), lines, "o_orderkey")


@query("SELECT o.o_orderkey, n FROM orders o JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE n > 5")
def corr_count_filter(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n")).filter("n > 5")
    return table(spark, sf_dir, "orders").select("o_orderkey").join(n, "o_orderkey")


_FOLD = "translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(f"SELECT page_id, url FROM pages WHERE {_FOLD} LIKE 'https://m.%' AND {_FOLD} NOT LIKE '%#%'")
def like_prefix(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url").filter(X.like("url", "HTTPS://M.%") & ~X.like("url", "%#%"))


@query("SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-01-01') / 365.25 AS age FROM orders WHERE date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-01-01') / 365.25 < 3")
def age_predicate(spark, sf_dir):
    age = X.age_years(F.to_date("o_orderdate"), F.lit("2001-01-01").cast("date"))
    return table(spark, sf_dir, "orders").select("o_orderkey", age.alias("age")).filter("age < 3")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS place FROM events) WHERE place % 7 = 3")
def shard_stride(spark, sf_dir):
    return R.stride(table(spark, sf_dir, "events").select("event_id"), [F.col("event_id")], 7, 3)


@query("SELECT n_name, r_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def inner_3way(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    j = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return j.groupBy("n_name", "r_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT o_orderkey, l_linenumber, l_partkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 40 WHERE o_orderpriority = '1-URGENT'")
def left_join_extra_on(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity > 40").select("l_orderkey", "l_linenumber", "l_partkey")
    o = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select("o_orderkey")
    return o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")


@query("SELECT o_orderkey, count(DISTINCT l_partkey) AS n_parts FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def left_count_distinct(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    return R.left_distinct(table(spark, sf_dir, "orders").select("o_orderkey"), lines, "o_orderkey", "l_partkey", "n_parts")


@query("SELECT o_orderkey, (SELECT max(l_extendedprice) FROM lineitem WHERE l_orderkey = o_orderkey) AS largest FROM orders")
def scalar_sub_largest(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_extendedprice").alias("largest"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(m, "o_orderkey", "left")


@query("SELECT o_orderkey, l_suppkey AS any_supplier FROM (SELECT o_orderkey, l_suppkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM orders JOIN lineitem ON l_orderkey = o_orderkey) WHERE rn = 1")
def scalar_any_source(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("m"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey").select("o_orderkey", F.col("m.l_suppkey").alias("any_supplier"))


@query("SELECT s_suppkey, coalesce(n, 0) AS n_lines FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_quantity > 48 GROUP BY 1) ON l_suppkey = s_suppkey")
def scalar_count(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").filter("l_quantity > 48").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n_lines"))
    return table(spark, sf_dir, "supplier").select("s_suppkey").join(n, "s_suppkey", "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0)))


@query("SELECT p_partkey, coalesce(o.p_brand, p.p_brand) AS p_brand FROM part p LEFT JOIN (SELECT p_partkey AS k, 'Brand#X' AS p_brand FROM part WHERE p_size > 40) o ON o.k = p.p_partkey")
def override_join(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    over = p.filter("p_size > 40").select("p_partkey", F.lit("Brand#X").alias("p_brand"))
    return R.override(p, over, "p_partkey", ["p_brand"]).select("p_partkey", "p_brand")


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.n_chars, b.quality FROM (SELECT doc_id, n_chars FROM documents WHERE lang = 'en') a FULL JOIN (SELECT doc_id, quality FROM labels) b ON a.doc_id = b.doc_id")
def full_key_merge(spark, sf_dir):
    a = table(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id", "n_chars")
    return a.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "full")


@query("SELECT event_type, coalesce(factor, 1.0) AS factor, count(*) AS n FROM events LEFT JOIN (VALUES ('click', 0.5), ('error', 0.85)) AS s(k, factor) ON k = event_type GROUP BY 1, 2")
def settings_lookup(spark, sf_dir):
    s = spark.createDataFrame([("click", 0.5), ("error", 0.85)], "event_type string, factor double")
    return table(spark, sf_dir, "events").join(F.broadcast(s), "event_type", "left").groupBy("event_type", F.coalesce("factor", F.lit(1.0)).alias("factor")).agg(F.count("*").alias("n"))


# Windows, order and pages -------------------------------------------------------------------------------
@query(
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1"""
)
def top1_file(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return R.largest(lines, "l_orderkey", "l_extendedprice", ["l_linenumber", "l_partkey", "l_suppkey"]).drop("l_suppkey")


@query("SELECT event_id, user_id, rn FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn > 1")
def non_canonical(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.col("value").desc(), "event_id")
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.row_number().over(w).alias("rn")).filter("rn > 1")


@query("SELECT day, event_id, value, rn FROM (SELECT CAST(ts AS DATE) AS day, event_id, value, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 5")
def top5_per_day(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_id", "value")
    return R.top(e, "day", [F.col("value").desc(), F.col("event_id")], 5, "rn")


@query("SELECT printf('sim_%07d', 12 + row_number() OVER (ORDER BY vec_id)) AS group_id, vec_id FROM embeddings WHERE label = 3")
def seq_ids(spark, sf_dir):
    existing = spark.createDataFrame([("sim_0000012",), ("sim_0000003",), ("other",)], "group_id string")
    new = table(spark, sf_dir, "embeddings").filter("label = 3").select("vec_id")
    return R.numbered(new, [F.col("vec_id")], existing, "group_id", "sim_")


@query(
    """
SELECT day, event_id FROM (
  SELECT CAST(ts AS DATE) AS day, event_id, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS rn, count(*) OVER (PARTITION BY CAST(ts AS DATE)) AS n FROM events)
WHERE n <= 3 OR rn IN (0, n // 3, 2 * n // 3)"""
)
def even_three(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_id", "ts")
    return R.even_picks(e, "day", [F.col("ts"), F.col("event_id")]).drop("ts")


@query("SELECT d.doc_id, quality, row_number() OVER (ORDER BY quality NULLS LAST, d.doc_id) AS place FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def nulls_last_sort(spark, sf_dir):
    j = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return R.positions(j, [F.col("quality").asc_nulls_last(), F.col("doc_id")], "p").select("doc_id", "quality", (F.col("p") + 1).alias("place"))


@query(
    """
WITH v AS (SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1))
SELECT doc_id, lang, (SELECT count(*) FROM v) AS total, (SELECT count(*) FROM v) > 30 AS has_more FROM v ORDER BY doc_id LIMIT 10 OFFSET 20"""
)
def paged_visible(spark, sf_dir):
    docs = R.without(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id")
    return R.page(docs, [F.col("doc_id")], offset=20, limit=10)


@query("SELECT d.doc_id, coalesce(f.hidden, false) AS hidden FROM documents d LEFT JOIN (SELECT DISTINCT doc_id, true AS hidden FROM labels WHERE toxic = 1) f ON f.doc_id = d.doc_id WHERE d.lang <> 'de'")
def legacy_flagged(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    out = R.flagged(docs, table(spark, sf_dir, "labels").filter("toxic = 1"), docs.filter("lang = 'de'"), "doc_id")
    return out.select("doc_id", "hidden")


@query(
    """
SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents GROUP BY 2
UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2
UNION ALL SELECT 'size', CASE WHEN n_chars < 1000 THEN 'short' ELSE 'long' END, count(*) FROM documents GROUP BY 2"""
)
def facet_counts(spark, sf_dir):
    size = F.when(F.col("n_chars") < 1000, "short").otherwise("long")
    return R.facets(table(spark, sf_dir, "documents").select("lang", "source", "n_chars"), {"lang": "lang", "source": "source", "size": size})


@query("SELECT p_partkey, p_size * p_retailprice AS area FROM part ORDER BY area DESC, p_partkey LIMIT 4")
def expression_top4(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * F.col("p_retailprice")).alias("area")).orderBy(F.col("area").desc(), "p_partkey").limit(4)


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 7")
def top_groups(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "user_id").limit(7)


@query("SELECT doc_id, rank FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('5' || chr(31) || doc_id), doc_id) AS rank FROM documents) WHERE rank <= 8")
def stratified_sample(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return R.top(d, "lang", [R.hash_order(5, "doc_id"), F.col("doc_id")], 8, "rank").select("doc_id", "rank")


@query("SELECT doc_id FROM documents ORDER BY sha256('42' || chr(31) || doc_id), doc_id LIMIT 50")
def seeded_sample(spark, sf_dir):
    return R.sample(table(spark, sf_dir, "documents").select("doc_id"), 50, "doc_id")


@query("SELECT vec_id FROM embeddings ORDER BY vec_id OFFSET 100")
def resume_offset(spark, sf_dir):
    return R.resume(table(spark, sf_dir, "embeddings").select("vec_id"), [F.col("vec_id")], 100)


@query("SELECT doc_id FROM documents WHERE lang = 'fr' UNION SELECT doc_id FROM labels WHERE quality = 1 EXCEPT SELECT doc_id FROM labels WHERE toxic = 1")
def set_operations(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    a = table(spark, sf_dir, "documents").filter("lang = 'fr'").select("doc_id")
    return a.union(labels.filter("quality = 1").select("doc_id")).distinct().subtract(labels.filter("toxic = 1").select("doc_id"))


@query("SELECT DISTINCT coalesce(o_orderpriority, 'none') AS priority, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS place FROM orders")
def case_order_key(spark, sf_dir):
    place = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return table(spark, sf_dir, "orders").select(F.coalesce("o_orderpriority", F.lit("none")).alias("priority"), place.alias("place")).distinct().orderBy("place", "priority")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 42 OR o_orderpriority = '''; DROP TABLE orders; --'")
def bound_parameters(spark, sf_dir):
    return spark.sql(
        "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderkey = :id OR o_orderpriority = :text",
        args={"id": 42, "text": "'; DROP TABLE orders; --"}, orders=table(spark, sf_dir, "orders"),
    )
