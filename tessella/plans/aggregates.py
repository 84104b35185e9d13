"""Aggregations, rollups, scalar functions and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import rollup as D
from ..operators import scoring as S
from ..sources.tables import table
from .catalog import query




@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS clicks, sum(CASE WHEN value > 10 THEN 1 ELSE 0 END) AS large FROM events GROUP BY 1")
def day_rollup(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("ts", "event_type", "value")
    return D.day_counts(e, F.to_date("ts"), {"clicks": F.col("event_type") == "click", "large": F.col("value") > 10})


@query("SELECT CAST(ts AS DATE) AS day, event_type AS value, count(DISTINCT user_id) AS n FROM events GROUP BY 1, 2")
def day_dim_distinct(spark, sf_dir):
    return D.day_values(table(spark, sf_dir, "events"), F.to_date("ts"), "event_type", "user_id")


@query("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY 1 HAVING count(*) > 12")
def having_dups(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("spent")).filter("n > 12")


@query("SELECT count(*) AS groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS redundant FROM (SELECT sha256(text) AS d, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1)")
def dup_groups_excess(spark, sf_dir):
    g = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("d")).agg(F.count("*").alias("n")).filter("n > 1")
    return g.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("redundant"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(sqrt(greatest(avg(value * value) - avg(value) * avg(value), 0)), 6) AS spread FROM events GROUP BY 1")
def moment_stats(spark, sf_dir):
    v = F.col("value")
    spread = F.sqrt(F.greatest(F.avg(v * v) - F.avg(v) * F.avg(v), F.lit(0.0)))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(spread, 6).alias("spread"))


@query(
    """
SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice AS byte_size FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM lineitem) WHERE rn = 1"""
)
def bare_argmax(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(F.struct("l_extendedprice", "l_partkey", "l_suppkey")).alias("m"))
    return m.select("l_orderkey", "m.l_partkey", "m.l_suppkey", F.col("m.l_extendedprice").alias("byte_size"))


@query(
    """
SELECT day, string_agg(v, '、' ORDER BY rn) AS top_values FROM (
  SELECT day, v, row_number() OVER (PARTITION BY day ORDER BY n DESC, v DESC) AS rn FROM (
    SELECT CAST(ts AS DATE) AS day, CAST(user_id AS VARCHAR) AS v, count(DISTINCT event_id) AS n FROM events GROUP BY 1, 2) WHERE n >= 2)
WHERE rn <= 8 GROUP BY 1"""
)
def majority_per_day(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("ts", "event_id", F.col("user_id").cast("string").alias("user"))
    best = D.top_values(D.day_values(e, F.to_date("ts"), "user", "event_id"), 8, least=2)
    return best.select("day", F.array_join("values", "、").alias("top_values"))


@query(
    """
SELECT round(quantile_cont(value, 0.01), 6) AS p1, round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50,
  round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events"""
)
def percentiles(spark, sf_dir):
    q = S.quantiles(table(spark, sf_dir, "events"), "value")
    return q.select(*[F.round(c, 6).alias(c) for c in q.columns])


@query("SELECT user_id, round(median(value), 6) AS med, round(list_avg(list_slice(list_sort(list(value), 'DESC'), 1, greatest(1, len(list(value)) // 4))), 6) AS top_quarter FROM events GROUP BY 1")
def median_top_quarter(spark, sf_dir):
    e = S.median_and_top(table(spark, sf_dir, "events"), "user_id", "value")
    return e.select("user_id", F.round("med", 6).alias("med"), F.round("top_quarter", 6).alias("top_quarter"))


@query("SELECT l_returnflag AS label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM lineitem GROUP BY 1")
def label_histogram(spark, sf_dir):
    h = S.histogram(table(spark, sf_dir, "lineitem"), "l_returnflag")
    return h.select(F.col("l_returnflag").alias("label"), "n", F.round("share", 6).alias("share"))


@query(
    """
WITH p AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings),
t AS (SELECT label, i, sum(CAST(x AS DOUBLE)) AS s FROM p GROUP BY 1, 2),
r AS (SELECT vec_id, p.label, CAST(x AS DOUBLE) AS x, s - CAST(x AS DOUBLE) AS y FROM p JOIN t ON t.label = p.label AND t.i = p.i)
SELECT vec_id, label, round(sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))), 4) AS sim FROM r GROUP BY 1, 2"""
)
def loo_centroid(spark, sf_dir):
    sims = S.centroid_similarity(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", 64)
    return sims.select("vec_id", "label", F.round("sim", 4).alias("sim"))


def _pair_scores(spark, sf_dir):
    """Scores of the same and of different kinds for calibration: line prices, large ones being the same."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / 100000).alias("score"), (F.col("l_quantity") > 30).alias("same"))


@query(
    """
WITH s AS (SELECT l_extendedprice / 100000 AS score, l_quantity > 30 AS same FROM lineitem),
q AS (SELECT DISTINCT unnest(quantile_cont(score, [0.01 + 0.98 * i / 399.0 for i in range(400)])) AS threshold FROM s),
m AS (SELECT threshold, count(*) FILTER (same) / (SELECT count(*) FROM s WHERE same) AS tp, count(*) FILTER (NOT same) / (SELECT count(*) FROM s WHERE NOT same) AS fp FROM q JOIN s ON score >= threshold GROUP BY 1),
f AS (SELECT threshold, 2 * (tp / (tp + fp)) * tp / (tp / (tp + fp) + tp) AS f1 FROM m WHERE tp > 0)
SELECT round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM f ORDER BY f.f1 DESC, f.threshold LIMIT 1"""
)
def best_f1(spark, sf_dir):
    return S.best_f1(_pair_scores(spark, sf_dir), "score", "same").select(F.round("threshold", 6).alias("threshold"), F.round("f1", 6).alias("f1"))


@query(
    """
WITH s AS (SELECT l_extendedprice / 100000 AS score, l_quantity > 30 AS same FROM lineitem),
t AS (SELECT 0.01 AS fpr, quantile_cont(score, 0.99) AS threshold FROM s WHERE NOT same UNION ALL SELECT 0.05, quantile_cont(score, 0.95) FROM s WHERE NOT same)
SELECT CAST(fpr AS DOUBLE) AS fpr, round(threshold, 6) AS threshold, round(avg(CASE WHEN score >= threshold THEN 1.0 ELSE 0.0 END), 6) AS tpr FROM t, s WHERE same GROUP BY fpr, threshold"""
)
def tpr_at_fpr(spark, sf_dir):
    t = S.tpr_at_fpr(_pair_scores(spark, sf_dir), "score", "same", [0.01, 0.05])
    return t.select("fpr", F.round("threshold", 6).alias("threshold"), F.round("tpr", 6).alias("tpr"))


@query(
    """
WITH s AS (SELECT l_extendedprice / 100000 AS score, l_quantity > 30 AS same FROM lineitem),
t AS (SELECT 0.95 AS tpr, quantile_cont(score, 0.05) AS threshold FROM s WHERE same UNION ALL SELECT 0.99, quantile_cont(score, 0.01) FROM s WHERE same)
SELECT CAST(tpr AS DOUBLE) AS tpr, round(threshold, 6) AS threshold, round(avg(CASE WHEN score >= threshold THEN 1.0 ELSE 0.0 END), 6) AS fpr FROM t, s WHERE NOT same GROUP BY tpr, threshold"""
)
def fpr_at_tpr(spark, sf_dir):
    t = S.fpr_at_tpr(_pair_scores(spark, sf_dir), "score", "same", [0.95, 0.99])
    return t.select("tpr", F.round("threshold", 6).alias("threshold"), F.round("fpr", 6).alias("fpr"))


@query(
    """
SELECT user_id AS query, count(*) FILTER (event_type = 'purchase') AS n, round(avg(value) FILTER (event_type = 'purchase') - avg(value) FILTER (event_type <> 'purchase'), 6) AS margin
FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'purchase') >= 3"""
)
def retrieval_margin(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("query"), F.col("value").alias("sim"), (F.col("event_type") == "purchase").alias("relevant"))
    return S.retrieval_margin(e).select("query", "n", F.round("margin", 6).alias("margin"))


@query(
    """
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events),
t AS (SELECT user_id, event_id FROM events WHERE event_type = 'purchase'),
n AS (SELECT user_id, count(*) AS n FROM t GROUP BY 1),
h AS (SELECT r.user_id, count(*) AS hits FROM r JOIN t ON t.user_id = r.user_id AND t.event_id = r.event_id WHERE rank <= 10 GROUP BY 1)
SELECT n.user_id AS query, round(coalesce(hits, 0) / least(n, 10), 6) AS recall FROM n LEFT JOIN h ON h.user_id = n.user_id"""
)
def recall_at_10(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("query"), F.col("event_id").alias("item"), "event_type", "value")
    w = Window.partitionBy("query").orderBy(F.col("value").desc(), "item")
    got = S.recall_at(e.withColumn("rank", F.row_number().over(w)), e.filter("event_type = 'purchase'").select("query", "item"), 10)
    return got.select("query", F.round("recall", 6).alias("recall"))


@query(
    """
WITH e AS (SELECT p_partkey % 60 AS predicted, p_size AS actual, abs(p_partkey % 60 - p_size) AS err FROM part),
b AS (SELECT *, CASE WHEN predicted < 12 THEN 0 WHEN predicted < 18 THEN 1 WHEN predicted < 60 THEN 2 ELSE 3 END = CASE WHEN actual < 12 THEN 0 WHEN actual < 18 THEN 1 WHEN actual < 60 THEN 2 ELSE 3 END AS hit FROM e)
SELECT count(*) AS n, CAST(median(err) AS DOUBLE) AS median_error, round(quantile_cont(err, 0.9), 6) AS p90_error, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS bin_hit,
  round(avg(CASE WHEN predicted < 16 THEN 1.0 ELSE 0.0 END) FILTER (actual < 16), 6) AS child_hit FROM b"""
)
def prediction_errors(spark, sf_dir):
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % 60).cast("double").alias("predicted"), F.col("p_size").cast("double").alias("actual"))
    e = S.prediction_errors(p, "predicted", "actual")
    return e.select("n", *[F.round(c, 6).alias(c) for c in ("median_error", "p90_error", "bin_hit", "child_hit")])


@query("SELECT 'duplicate_key' AS constraint_name, count(*) AS n FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'vector_length', count(*) FROM embeddings WHERE len(embedding) <> 64")
def integrity_counts(spark, sf_dir):
    dup = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").count().filter("count > 1").agg(F.count("*").alias("n"))
    bad = table(spark, sf_dir, "embeddings").filter(F.size("embedding") != 64).agg(F.count("*").alias("n"))
    return dup.select(F.lit("duplicate_key").alias("constraint_name"), "n").union(bad.select(F.lit("vector_length"), "n"))


@query(
    """
SELECT 'assets' AS metric, count(*) AS n FROM documents UNION ALL SELECT 'languages', count(DISTINCT lang) FROM documents
UNION ALL SELECT 'labelled', count(*) FROM labels UNION ALL SELECT 'filtered', sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) FROM labels"""
)
def status_dashboard(spark, sf_dir):
    d = table(spark, sf_dir, "documents").agg(F.count("*").alias("assets"), F.countDistinct("lang").alias("languages"))
    lab = table(spark, sf_dir, "labels").agg(F.count("*").alias("labelled"), F.count_if(F.col("toxic") == 1).alias("filtered"))
    return d.crossJoin(lab).selectExpr("stack(4, 'assets', assets, 'languages', languages, 'labelled', labelled, 'filtered', filtered) as (metric, n)")


# Scalar functions ---------------------------------------------------------------------------------------
@query("SELECT page_id, CASE WHEN starts_with(url, 'http://') THEN 'https://' || substr(url, 8) ELSE url END AS url FROM pages")
def prefix_rewrite(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.rewrite_prefix("url", "http://", "https://").alias("url"))


@query("SELECT page_id, list_filter(string_split(regexp_replace(split_part(url, '?', 1), '^[a-z]+://', ''), '/')[1:-2], lambda x: x <> '')[-1] AS folder FROM pages")
def last_folder(spark, sf_dir):
    path = F.regexp_replace(F.substring_index("url", "?", 1), "^[a-z]+://", "")
    return table(spark, sf_dir, "pages").select("page_id", X.last_folder(path).alias("folder"))


@query("SELECT doc_id, 'face_' || substr(sha256(source || ':' || doc_id), 1, 24) AS stable_id, printf('g%07d', doc_id) AS serial FROM documents")
def stable_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.stable_id("face_", F.concat("source", F.lit(":"), F.col("doc_id").cast("string"))).alias("stable_id"), X.serial_id("g", "doc_id").alias("serial"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_field(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query(
    """
SELECT event_id, isodow(ts) - 1 AS weekday, hour(ts) < 8 OR hour(ts) >= 23 AS night, CAST(ts AS DATE) AS day FROM events"""
)
def date_parts(spark, sf_dir):
    ts = F.col("ts")
    night = ~((F.hour(ts) >= 8) & (F.hour(ts) < 23))
    return table(spark, sf_dir, "events").select("event_id", F.weekday(ts).alias("weekday"), night.alias("night"), F.to_date(ts).alias("day"))


@query(
    """
SELECT p_partkey, CASE WHEN p_retailprice < 300 THEN 'blurry' WHEN p_retailprice < 1200 THEN 'soft' ELSE 'sharp' END AS blur,
  CASE WHEN p_size < 12 THEN 'child' WHEN p_size < 18 THEN 'teen' WHEN p_size < 60 THEN 'adult' ELSE 'elder' END AS age,
  CASE WHEN least(p_size * 3, 100) < 40 THEN 'small' WHEN p_retailprice < 950 THEN 'blurry' WHEN p_size > 38 THEN 'nonfrontal_candidate' ELSE 'usable' END AS quality FROM part"""
)
def conditional_labels(spark, sf_dir):
    quality = X.face_quality(F.col("p_size") * 3, F.lit(100), F.when(F.col("p_retailprice") < 950, 0).otherwise(100), F.col("p_size") / 100.0)
    return table(spark, sf_dir, "part").select("p_partkey", X.blur_label("p_retailprice").alias("blur"), X.age_bin("p_size").alias("age"), quality.alias("quality"))


@query(
    """
SELECT p_partkey, round(w, 4) AS w, round(h, 4) AS h, round(least(greatest(cx - w / 2, 0), W0 - w), 4) AS x, round(least(greatest(cy - h / 2, 0), H0 - h), 4) AS y FROM (
  SELECT *, w * 3 / 4 AS h FROM (SELECT p_partkey, 400.0 + p_size AS W0, 300.0 + p_retailprice AS H0, p_size * 9.0 AS cx, p_size * 5.0 AS cy, least(400.0 + p_size, (300.0 + p_retailprice) * 4 / 3) AS w FROM part))"""
)
def crop_windows(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", X.crop_window(400.0 + F.col("p_size"), 300.0 + F.col("p_retailprice"), F.col("p_size") * 9.0, F.col("p_size") * 5.0).alias("c"))
    return p.select("p_partkey", *[F.round(F.col("c")[k], 4).alias(k) for k in "whxy"])


@query("SELECT n_nationkey, round(ln(tan(0.7853981633974483 + radians(n_nationkey * 2.0 - 20) / 2)), 6) AS y FROM nation")
def mercator(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.round(X.mercator_y(F.col("n_nationkey") * 2.0 - 20), 6).alias("y"))


@query(
    """
SELECT day, CAST(month(day) AS VARCHAR) || '月' || CAST(day(day) AS VARCHAR) || '日（' || ['周一','周二','周三','周四','周五','周六','周日'][isodow(day)] || '），拍摄了 ' || c || ' 张照片、' || (n - c) || ' 段视频。' AS caption
FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS c FROM events GROUP BY 1) WHERE c > 0 AND n > c"""
)
def day_captions(spark, sf_dir):
    d = D.day_counts(table(spark, sf_dir, "events"), F.to_date("ts"), {"photos": F.col("event_type") == "click"}).filter("photos > 0 and n > photos")
    none = F.lit(None).cast("array<string>")
    text = D.caption(F.col("day").cast("string"), X.weekday_name("day"), F.lit(None).cast("string"), F.col("photos"), F.col("n") - F.col("photos"), none, none, F.lit(None).cast("string"))
    return d.select("day", text.alias("caption"))
