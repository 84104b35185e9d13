"""Backlogs, assignment, crops, captions, audits and edits of a media catalogue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import graph as G
from ..operators import incremental as I
from ..operators import library as L
from ..operators import mutations as C
from ..operators import relational as R
from ..operators import rollup as D
from ..operators import scoring as S
from ..operators import similarity as M
from ..sources import tables as T
from ..sources.tables import table
from .catalog import query

_DOT = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


# Incremental --------------------------------------------------------------------------------------------
@query(
    """
WITH p AS (SELECT doc_id AS asset_id, CASE WHEN lang = 'de' THEN 'video' ELSE 'photo' END AS media_type, CASE WHEN n_chars % 2 = 0 THEN sha256(text) END AS sha256, n_chars AS byte_size, lang FROM documents),
l AS (SELECT doc_id AS asset_id, quality, toxic FROM labels),
allowed AS (SELECT asset_id FROM l WHERE quality = 1), hidden AS (SELECT asset_id FROM l WHERE toxic = 1 AND asset_id NOT IN (SELECT asset_id FROM allowed)),
miss AS (SELECT asset_id FROM p WHERE lang = 'es'), grouped AS (SELECT asset_id FROM p WHERE byte_size IN (SELECT byte_size FROM p GROUP BY 1 HAVING count(*) > 2)), ph AS (SELECT * FROM p WHERE media_type = 'photo')
SELECT 'similar' AS step, count(*) AS n FROM ph WHERE asset_id NOT IN (SELECT asset_id FROM l WHERE quality = 0) AND asset_id NOT IN (SELECT asset_id FROM grouped) AND asset_id NOT IN (SELECT asset_id FROM miss) AND asset_id NOT IN (SELECT asset_id FROM hidden)
UNION ALL SELECT 'junk', count(*) FROM p WHERE asset_id NOT IN (SELECT asset_id FROM l WHERE toxic = 1) AND asset_id NOT IN (SELECT asset_id FROM allowed)
UNION ALL SELECT 'blur', count(*) FROM ph WHERE asset_id NOT IN (SELECT asset_id FROM l)
UNION ALL SELECT 'sha256', count(*) FROM ph WHERE sha256 IS NULL AND byte_size IN (SELECT byte_size FROM ph GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'vision', count(*) FROM ph WHERE asset_id NOT IN (SELECT asset_id FROM l WHERE toxic = 0) AND asset_id NOT IN (SELECT asset_id FROM allowed) AND asset_id NOT IN (SELECT asset_id FROM hidden)
UNION ALL SELECT 'logcolor', 0"""
)
def backlog_six(spark, sf_dir):
    """All six kinds of pending work, log colour being switched off."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "asset_id")
    p = d.select(F.col("doc_id").alias("asset_id"), F.when(F.col("lang") == "de", "video").otherwise("photo").alias("media_type"), F.when(F.col("n_chars") % 2 == 0, F.sha2("text", 256)).alias("sha256"), F.col("n_chars").alias("byte_size"), "lang")
    of = lambda c: lab.filter(c).select("asset_id")
    grouped = R.within(p, p.groupBy("byte_size").count().filter("count > 2"), "byte_size").select("asset_id")
    marks = {"similar": of("quality = 0"), "junk": of("toxic = 1"), "blur": lab.select("asset_id"), "vision": of("toxic = 0"), "logcolor": p.limit(0).select("asset_id")}
    misses = p.filter("lang = 'es'").select("asset_id", F.lit("similar").alias("step"))
    hidden = R.hidden(of("toxic = 1"), of("quality = 1"), "asset_id")
    return I.catalogue_backlog(p.select("asset_id", "media_type"), p.select("asset_id", "sha256", "byte_size"), marks, hidden, of("quality = 1"), misses, grouped, logcolor=False)


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def derived_cache(spark, sf_dir):
    """A cache of digests: those of English documents are there already, the others are derived."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    derive = lambda x: x.select("doc_id", F.sha2("text", 256).alias("digest"))
    return I.cached(derive(d.filter("lang = 'en'")), d, "doc_id", derive)


@query("SELECT doc_id, lang FROM documents WHERE lang = 'fr' AND n_chars >= 500")
def optional_filters(spark, sf_dir):
    rules = {"lang": lambda v: F.col("lang") == v, "least": lambda v: F.col("n_chars") >= v, "sources": lambda v: F.col("source").isin(v), "labelled": lambda v: F.col("doc_id") < 0}
    d = table(spark, sf_dir, "documents")
    return R.optional_filters(d, {"lang": "fr", "least": 500, "sources": [], "labelled": False}, rules).select("doc_id", "lang")


@query("SELECT n.key AS key, coalesce(s.value, n.value) AS value FROM (VALUES ('algo_face_knn_min_sim', '0.55'), ('algo_face_child_strict', '1'), ('algo_logcolor_enabled', '1')) n(key, value) LEFT JOIN (SELECT 'algo_face_knn_min_sim' AS key, CAST(round(max(s_acctbal) / 20000, 2) AS VARCHAR) AS value FROM supplier) s ON s.key = n.key")
def config_settings(spark, sf_dir):
    """Default settings with the stored ones over them."""
    base = spark.createDataFrame([("algo_face_knn_min_sim", "0.55"), ("algo_face_child_strict", "1"), ("algo_logcolor_enabled", "1")], "key string, value string")
    stored = table(spark, sf_dir, "supplier").agg(F.round(F.max("s_acctbal") / 20000, 2).cast("string").alias("value")).select(F.lit("algo_face_knn_min_sim").alias("key"), "value")
    return R.override(base, stored, "key", ["value"])


# Assignment and audits ----------------------------------------------------------------------------------
@query(
    f"""
WITH f AS (SELECT vec_id, label, embedding, CASE WHEN vec_id % 4 = 0 THEN NULL ELSE label END AS person, CASE WHEN vec_id % 3 = 0 THEN 'auto' ELSE 'manual' END AS role, CASE WHEN vec_id % 5 = 0 THEN 'blurry' ELSE 'usable' END AS quality FROM embeddings),
q AS (SELECT * FROM f WHERE person IS NULL), r AS (SELECT * FROM f WHERE person IS NOT NULL AND role = 'manual' AND quality = 'usable'),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, ref) AS rank FROM (
  SELECT a.vec_id AS query, b.vec_id AS ref, b.person AS label, CASE WHEN a.vec_id < b.vec_id // 2 THEN -1.0 ELSE round({_DOT}, 12) END AS sim FROM q a, r b)) WHERE rank <= 10),
t AS (SELECT query, sim AS top_sim, label IN (1, 4) AS top_child FROM n WHERE rank = 1),
v AS (SELECT query, label, count(*) AS votes, min(rank) AS nearest FROM n GROUP BY 1, 2),
w AS (SELECT *, row_number() OVER o AS rn, coalesce(lead(votes) OVER o, -2) AS second, sum(votes) OVER (PARTITION BY query) AS n FROM v WINDOW o AS (PARTITION BY query ORDER BY votes DESC, nearest))
SELECT w.query, label, votes, CASE WHEN top_sim < 0 THEN 'abstain_invalid' WHEN top_sim < 0.2 + CASE WHEN top_child THEN 0.07 ELSE 0 END THEN 'abstain_similarity' WHEN votes - second < 2 THEN 'abstain_margin'
  WHEN votes / least(10, n) < least(0.85, 0.4 + CASE WHEN label IN (1, 4) THEN 0.1 ELSE 0 END) THEN 'abstain_ratio' ELSE 'assign' END AS decision FROM w JOIN t ON t.query = w.query WHERE rn = 1"""
)
def knn_assign(spark, sf_dir):
    """Every rule of the assignment: confirmed usable references only, none born after the picture, stricter
    for two labels that stand for children."""
    e = table(spark, sf_dir, "embeddings")
    f = e.withColumns(
        {
            "person": F.when(F.col("vec_id") % 4 != 0, F.col("label")), "sample_role": F.when(F.col("vec_id") % 3 == 0, "auto").otherwise("manual"),
            "quality_class": F.when(F.col("vec_id") % 5 == 0, "blurry").otherwise("usable"), "born": F.floor(F.col("vec_id") / 2),
        }
    )
    refs = S.usable_references(f.filter("person is not null")).select("vec_id", "embedding", "person", "born")
    near = M.knn(f.filter("person is null").select("vec_id", "embedding"), refs, "vec_id", "embedding", "person", 10, valid=("vec_id", "born"))
    kids = spark.createDataFrame([(1,), (4,)], "label int")
    return S.assign_people(near.withColumnRenamed("person", "label"), kids, S.least_similarity("other", "0.2"), ratio=0.4)


@query(
    f"""
WITH c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM (SELECT label, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings) GROUP BY 1, 2),
t AS (SELECT label AS vec_id, list(x ORDER BY i) AS embedding FROM c GROUP BY 1)
SELECT query, ref, round(sim, 4) AS sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, ref) AS rank FROM (SELECT a.vec_id AS query, b.vec_id AS ref, round({_DOT}, 12) AS sim FROM t a, embeddings b)) WHERE rank <= 10"""
)
def text_image_topk(spark, sf_dir):
    """Class means stand for texts: the ten nearest vectors of each."""
    e = table(spark, sf_dir, "embeddings")
    parts = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    texts = parts.groupBy(F.col("label").alias("vec_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("embedding"))
    near = M.knn(texts.withColumn("vec_id", F.col("vec_id").cast("bigint")), e, "vec_id", "embedding", "label", 10)
    return near.select(F.col("query").cast("int").alias("query"), "ref", F.round("sim", 4).alias("sim"), "rank")


@query(
    """
WITH a AS (SELECT doc_id AS face_id, 'p' || quality AS person_id FROM labels WHERE quality = 0), f AS (SELECT doc_id AS face_id, 'p' || quality AS person_id FROM labels WHERE toxic = 1 OR quality = 0)
SELECT face_id, person_id, 'old' AS reason, TIMESTAMP '2025-01-01 00:00:00' AS created_at FROM a
UNION ALL SELECT face_id, person_id, 'conflict:' || person_id, TIMESTAMP '2026-01-01 00:00:00' FROM f WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.face_id = f.face_id AND a.person_id = f.person_id)"""
)
def audit_insert(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("face_id"), F.concat(F.lit("p"), F.col("quality").cast("string")).alias("person_id"), "quality", "toxic")
    old = lab.filter("quality = 0").select("face_id", "person_id", F.lit("old").alias("reason"), F.lit("2025-01-01").cast("timestamp_ntz").alias("created_at"))
    return C.audit_rows(lab.filter("toxic = 1 or quality = 0"), old, F.concat(F.lit("conflict:"), "person_id"), "2026-01-01")


_ANSWERS = "(SELECT doc_id AS item, CASE WHEN toxic = 1 THEN 'b' ELSE 'a' END AS side, 'good' AS choice, 1 AS moment FROM labels UNION ALL SELECT doc_id, 'a', 'bad', 2 FROM labels WHERE quality = 0)"


@query(f"SELECT item, side, arg_max(choice, moment) AS choice, max(moment) AS moment FROM {_ANSWERS} GROUP BY 1, 2")
def label_review(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "item")
    first = lab.select("item", F.when(F.col("toxic") == 1, "b").otherwise("a").alias("side"), F.lit("good").alias("choice"), F.lit(1).alias("moment"))
    return C.review_labels(first, lab.filter("quality = 0").select("item", F.lit("a").alias("side"), F.lit("bad").alias("choice"), F.lit(2).alias("moment")), [F.col("moment")])


@query(f"SELECT side, (SELECT count(*) FROM documents) AS total, count(DISTINCT item) AS done, (SELECT count(*) FROM documents) - count(DISTINCT item) AS left FROM {_ANSWERS} GROUP BY 1")
def review_progress(spark, sf_dir):
    return C.review_progress(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item")), label_review(spark, sf_dir))


@query("SELECT c_custkey, c_acctbal AS old_c_acctbal, c_mktsegment AS old_c_mktsegment FROM customer WHERE c_acctbal < 0 OR c_mktsegment = 'BUILDING'")
def undo_log(spark, sf_dir):
    """What a change of balances below zero and the removal of a segment would have to give back."""
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    new = old.filter("c_mktsegment <> 'BUILDING'").withColumn("c_acctbal", F.greatest("c_acctbal", F.lit(0.0)))
    return T.undo_log(old, new, ["c_custkey"], ["c_acctbal", "c_mktsegment"])


# Rules and functions ------------------------------------------------------------------------------------
@query(
    """
WITH r AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'SCREENSHOT_FILENAME' WHEN 1 THEN 'DOWNLOAD_PATH' WHEN 2 THEN 'vision_document' END AS reason FROM documents)
SELECT doc_id, reason, CASE WHEN ends_with(coalesce(reason, ''), '_FILENAME') THEN 'filename' ELSE 'path' END AS kind FROM r"""
)
def evidence_kinds(spark, sf_dir):
    m = F.col("doc_id") % 4
    reason = F.when(m == 0, "SCREENSHOT_FILENAME").when(m == 1, "DOWNLOAD_PATH").when(m == 2, "vision_document")
    return table(spark, sf_dir, "documents").select("doc_id", reason.alias("reason")).withColumn("kind", X.evidence_kind("reason"))


@query(
    """
SELECT conv_id, turn, substr(trim(text, ' '), 1, 30) AS head, regexp_matches(text, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') AS dated, coalesce(TRY_CAST(string_split(text, ' ')[1] AS INTEGER), -1) AS number,
  array_to_string(list_slice(list_filter(['user', 'assistant', 'tool'], lambda x: x = role), 1, 1), ',') AS known FROM conversations"""
)
def text_cleanup(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    known = X.known_first(F.array("role", "role", F.lit("other")), ["user", "assistant", "tool"], 1)
    return c.select(
        "conv_id", "turn", X.shortened("text", 30).alias("head"), X.is_date("text").alias("dated"), X.number_or(F.element_at(F.split("text", " "), 1), "int", -1).alias("number"), F.array_join(known, ",").alias("known")
    )


@query("SELECT event_id, CAST(ts + INTERVAL 8 HOUR AS DATE) AS local_day, hour(ts + INTERVAL 8 HOUR) < 8 OR hour(ts + INTERVAL 8 HOUR) >= 23 AS night, CAST(floor(epoch(ts)) AS BIGINT) AS at_second, substr(CAST(ts AS VARCHAR), 1, 10) AS day FROM events")
def local_times(spark, sf_dir):
    """The same moments as texts, with an offset or without, which means +08:00."""
    e = table(spark, sf_dir, "events").withColumn("moment", F.col("ts").cast("timestamp"))
    local = F.from_utc_timestamp("moment", "+08:00")
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.date_format("moment", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))).otherwise(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"))
    return e.select("event_id", F.to_date(local).alias("local_day"), X.is_night("moment").alias("night"), X.epoch_seconds(text).alias("at_second"), X.day_text(F.col("ts").cast("string")).alias("day"))


@query(
    """
WITH p AS (SELECT p_partkey, 400.0 + p_size AS w, 300.0 + p_retailprice AS h, p_partkey % 4 AS m, p_size * 5.0 AS s FROM part),
f AS (SELECT *, s AS x1, s / 2 AS y1, least(w, s + 90.0) AS x2, least(h, s / 2 + CASE WHEN p_partkey % 8 = 0 THEN 600.0 ELSE 80.0 END) AS y2, least(w, h * 4 / 3) AS fw FROM p),
g AS (SELECT *, y2 - y1 AS tall, y1 - (y2 - y1) * 0.2 AS top, fw * 3 / 4 AS fh, least(h, w * 4 / 3) AS uh FROM f),
c AS (SELECT *, uh * 3 / 4 AS uw, tall * 4 / 3 > w AS upright, greatest(0, least((y1 + y2) / 2 - tall * 0.12 - fh / 2, h - fh)) AS placed,
  CASE m WHEN 1 THEN s * 2 WHEN 2 THEN w / 2 ELSE w / 2 END AS cx, CASE m WHEN 1 THEN s WHEN 2 THEN CASE WHEN s / h < 0.5 THEN least(s + (h - s) * 0.5, h - h * 3 / 8) ELSE greatest(s - h * 3 / 16, h * 3 / 8) END ELSE h / 2 END AS cy FROM g),
r AS (SELECT *, CASE WHEN m = 0 THEN CASE WHEN upright THEN uw ELSE fw END ELSE fw END AS rw, CASE WHEN m = 0 AND upright THEN uh ELSE fh END AS rh,
  CASE WHEN m = 0 THEN (x1 + x2) / 2 - CASE WHEN upright THEN uw ELSE fw END / 2 ELSE cx - fw / 2 END AS rx,
  CASE WHEN m = 0 THEN CASE WHEN upright THEN CASE WHEN uh >= tall THEN top ELSE (y1 + y2) / 2 - uh / 2 END WHEN placed > top THEN top ELSE placed END ELSE cy - fh / 2 END AS ry FROM c)
SELECT p_partkey, ['face', 'saliency', 'horizon', 'center'][m + 1] AS method, round_even(greatest(0, least(rx, w - rw)) / w, 4) AS x, round_even(greatest(0, least(ry, h - rh)) / h, 4) AS y, round_even(rw / w, 4) AS w, round_even(rh / h, 4) AS h FROM r"""
)
def smart_crops(spark, sf_dir):
    """Parts stand for images: faces, a subject or a horizon by key, some faces taller than the picture is wide."""
    m, s = F.col("p_partkey") % 4, F.col("p_size") * 5.0
    tall = F.when(F.col("p_partkey") % 8 == 0, 600.0).otherwise(80.0)
    box = lambda w: F.struct(s.alias("x"), (s / 2).alias("y"), F.lit(w).alias("w"), tall.alias("h"))
    crop = X.smart_crop(
        400.0 + F.col("p_size"), 300.0 + F.col("p_retailprice"), F.when(m == 0, F.array(box(40.0), box(90.0))), F.when(m == 1, F.struct((s * 2).alias("cx"), s.alias("cy"))), F.when(m == 2, s)
    )
    return table(spark, sf_dir, "part").select("p_partkey", crop.alias("c")).select("p_partkey", "c.*")


@query(
    """
SELECT p_partkey, CASE WHEN greatest(p_size, 10) / least(p_size, 10) >= 1.9 AND p_partkey % 20 <= 12 AND p_retailprice - 900 < 18 THEN true ELSE false END AS suspect FROM part"""
)
def screenshot_suspects(spark, sf_dir):
    spreads = F.array(F.lit(1.0), (F.col("p_partkey") % 20).cast("double"), F.lit(0.5), F.lit(2.0))
    return table(spark, sf_dir, "part").select("p_partkey", S.screenshot_suspect(F.col("p_size"), F.lit(10), spreads, F.col("p_retailprice") - 900).alias("suspect"))


# Groups, order and days ---------------------------------------------------------------------------------
@query(
    """
WITH d AS (SELECT doc_id, n_chars, min(doc_id) OVER (PARTITION BY sha256(lower(text))) AS seed, count(*) OVER (PARTITION BY sha256(lower(text))) AS n FROM documents),
m AS (SELECT seed, doc_id, coalesce(n_chars, 0) AS size FROM d WHERE n > 1)
SELECT seed, (list(doc_id ORDER BY size DESC, doc_id))[1] AS keep, count(*) AS members, sum(size) AS total FROM m GROUP BY 1"""
)
def keep_largest(spark, sf_dir):
    """Of equal texts, whatever their case, the longest stays."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("member"), F.sha2(F.lower("text"), 256).alias("d"), F.col("n_chars").alias("size"))
    links = M.digest_links(d, "member", "d").select(F.col("first").alias("seed"), "member")
    members = links.union(links.select("seed", F.col("seed").alias("member"))).distinct()
    kept = G.keep_largest(members, d.select("member", "size"))
    return kept.select("seed", "keep", F.size("members").cast("bigint").alias("members"), F.aggregate("members", F.lit(0).cast("bigint"), lambda s, x: s + x["size"]).alias("total"))


_SCORED = "m AS (SELECT l_orderkey, l_partkey * 10 + l_linenumber AS member, CASE WHEN l_tax > 0.01 THEN floor(l_quantity / 10) END AS score FROM lineitem)"


def _scored_members(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("member"), F.when(F.col("l_tax") > 0.01, F.floor(F.col("l_quantity") / 10)).alias("score"))


@query(
    f"""
WITH {_SCORED} SELECT l_orderkey, member, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC NULLS LAST, member DESC) = 1 AS is_best,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC NULLS LAST, member) = 1 AS again FROM m"""
)
def best_picks(spark, sf_dir):
    """Many ties: the first pick and a later one break them differently."""
    first = L.pick_best(_scored_members(spark, sf_dir), "l_orderkey", "score", "member")
    return L.pick_best(first.withColumnRenamed("is_best", "first"), "l_orderkey", "score", "member", again=True).select("l_orderkey", "member", F.col("first").alias("is_best"), F.col("is_best").alias("again"))


@query(
    f"""
WITH {_SCORED}, b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC NULLS LAST, member DESC) = 1 AS is_best FROM m),
c AS (SELECT l_orderkey, min(member) AS chosen FROM m WHERE score = 0 GROUP BY 1)
SELECT b.l_orderkey, member, CASE WHEN chosen IS NULL THEN is_best ELSE member = chosen END AS is_best FROM b LEFT JOIN c ON c.l_orderkey = b.l_orderkey"""
)
def chosen_best(spark, sf_dir):
    """Groups with a member of score 0 get the first of those as their best; strangers are ignored."""
    m = L.pick_best(_scored_members(spark, sf_dir), "l_orderkey", "score", "member")
    chosen = m.filter("score = 0").select("l_orderkey", "member").union(m.select("l_orderkey", F.lit(-1).cast("bigint")))
    return L.set_best(m, chosen, "l_orderkey", "member").select("l_orderkey", "member", "is_best")


@query("SELECT o_orderkey, o_orderstatus = 'F' AS first FROM orders ORDER BY first DESC, coalesce(nullif(o_orderpriority, '5-LOW'), '999'), o_orderkey LIMIT 25")
def flagged_first(spark, sf_dir):
    """A boolean as the first order key, a default for missing ones as the second."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("first"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p"))
    return o.orderBy(F.col("first").desc(), F.coalesce("p", F.lit("999")), "o_orderkey").limit(25).select("o_orderkey", "first")


@query("SELECT conv_id, array_to_string(list_distinct_ordered, ',') AS roles FROM (SELECT conv_id, list(role ORDER BY first_turn) AS list_distinct_ordered FROM (SELECT conv_id, role, min(turn) AS first_turn FROM conversations GROUP BY 1, 2) GROUP BY 1)")
def ordered_distinct(spark, sf_dir):
    """Each value once, in the order in which it came first."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    return c.select("conv_id", F.array_join(F.array_distinct(F.transform("x", lambda p: p["role"])), ",").alias("roles"))


@query(
    """
WITH e AS (SELECT CAST(ts AS DATE) AS day, event_id, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY value DESC, event_id) AS rn, count(*) OVER (PARTITION BY CAST(ts AS DATE)) AS n FROM events),
l AS (SELECT DISTINCT day FROM e WHERE n >= 5 ORDER BY day DESC LIMIT 4)
SELECT day, event_id, rn FROM e JOIN l USING (day) WHERE rn <= 5"""
)
def top5_full_days(spark, sf_dir):
    """The best five of the last four days that have five."""
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_id", "value")
    days = e.groupBy("day").count().filter("count >= 5").orderBy(F.col("day").desc()).limit(4)
    return R.top(R.within(e, days, "day"), "day", [F.col("value").desc(), F.col("event_id")], 5, "rn").drop("value")


@query(
    """
WITH e AS (SELECT CAST(ts AS DATE) AS day, event_id, value, event_type = 'click' AS photo, count(*) FILTER (event_type = 'click') OVER (PARTITION BY CAST(ts AS DATE)) AS photos FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY value > 10 DESC, event_id) - 1 AS rn, count(*) OVER (PARTITION BY day) AS n FROM e WHERE photos < 3 OR photo)
SELECT day, event_id FROM r WHERE n <= 3 OR rn IN (0, n // 3, 2 * n // 3)"""
)
def day_representatives(spark, sf_dir):
    """Three evenly spaced rows a day, large ones first, clicks alone where a day has three."""
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_id", "value", "event_type")
    return D.representatives(e, "day", [(F.col("value") > 10).desc(), F.col("event_id")], F.col("event_type") == "click").select("day", "event_id")


@query(
    """
WITH e AS (SELECT CAST(ts AS DATE) AS day, CAST(user_id AS VARCHAR) AS who, event_type AS kind, event_id FROM events),
p AS (SELECT day, string_agg(who, '、' ORDER BY n DESC, who DESC) AS people FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, who DESC) AS rn FROM (SELECT day, who, count(DISTINCT event_id) AS n FROM e GROUP BY 1, 2) WHERE n >= 2) WHERE rn <= 8 GROUP BY 1),
k AS (SELECT day, kind, count(DISTINCT event_id) AS n FROM e GROUP BY 1, 2),
s AS (SELECT day, string_agg(kind, '、' ORDER BY o, n DESC, kind DESC) AS scenes FROM (SELECT *, row_number() OVER (PARTITION BY day, o ORDER BY n DESC, kind DESC) AS rn FROM (SELECT *, CASE WHEN kind = 'error' THEN 1 ELSE 0 END AS o FROM k)) WHERE rn <= CASE WHEN o = 1 THEN 2 ELSE 4 END GROUP BY 1),
d AS (SELECT day, count(*) FILTER (kind = 'click') AS photos, count(*) FILTER (kind <> 'click') AS videos FROM e GROUP BY 1)
SELECT d.day, month(d.day) || '月' || day(d.day) || '日（' || ['周一','周二','周三','周四','周五','周六','周日'][isodow(d.day)] || '）' || CASE WHEN photos + videos > 0 THEN '，在' || (['click','view'][1]) || '，拍摄了 ' || concat_ws('、', CASE WHEN photos > 0 THEN photos || ' 张照片' END, CASE WHEN videos > 0 THEN videos || ' 段视频' END) ELSE '' END || '。'
  || coalesce('画面中出现' || people || '。', '') || coalesce('场景包含' || scenes || '。', '') || CASE WHEN photos > videos THEN '相机：cam。' ELSE '' END AS caption
FROM d LEFT JOIN p ON p.day = d.day LEFT JOIN s ON s.day = d.day"""
)
def full_captions(spark, sf_dir):
    """Captions with all parts: up to eight people seen twice, four scenes and then two objects, a place and
    a camera."""
    e = table(spark, sf_dir, "events").select("ts", "event_id", F.col("user_id").cast("string").alias("who"), F.col("event_type").alias("kind"))
    day = F.to_date("ts")
    d = D.day_counts(e, day, {"photos": F.col("kind") == "click", "videos": F.col("kind") != "click"})
    people = D.top_values(D.day_values(e, day, "who", "event_id"), 8, least=2).withColumnRenamed("values", "people")
    kinds = D.day_values(e, day, "kind", "event_id")
    scenes = D.top_values(kinds.filter("value <> 'error'"), 4).withColumnRenamed("values", "scenes")
    things = D.top_values(kinds.filter("value = 'error'"), 2).withColumnRenamed("values", "things")
    none = F.expr("cast(array() as array<string>)")
    j = d.join(people, "day", "left").join(scenes, "day", "left").join(things, "day", "left")
    tags = F.concat(F.coalesce("scenes", none), F.coalesce("things", none))
    text = D.caption(F.col("day").cast("string"), X.weekday_name("day"), F.lit("click"), F.col("photos"), F.col("videos"), F.col("people"), tags, F.when(F.col("photos") > F.col("videos"), "cam"))
    return j.select("day", text.alias("caption"))


@query("SELECT user_id, first, n FROM (SELECT user_id, min(ts) AS first, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s)")
def event_bursts(spark, sf_dir):
    """Runs of a user's events without a gap of more than six hours."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    fresh = F.when(F.col("ts") <= F.lag("ts").over(w) + F.expr("INTERVAL 6 HOURS"), 0).otherwise(1)
    runs = e.withColumn("fresh", fresh).withColumn("s", F.sum("fresh").over(w))
    return runs.groupBy("user_id", "s").agg(F.min("ts").alias("first"), F.count("*").alias("n")).drop("s")
