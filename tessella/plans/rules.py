"""Rules, full text, re-ranking, mutations and incremental queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import incremental as I
from ..operators import mutations as C
from ..operators import scoring as S
from ..operators import search as Q
from ..sources.tables import table
from .catalog import query


@query(
    """
WITH p AS (SELECT page_id, lower(regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '^[a-z]+://', '')) AS path FROM pages),
q AS (SELECT page_id, path, string_split(path, '/')[-1] AS name, list_filter(string_split(path, '/')[1:-2], lambda x: x <> '')[-1] AS folder FROM p)
SELECT page_id, array_to_string(list_filter([
  CASE WHEN starts_with(name, 'screenshot') OR starts_with(name, 'screen_') OR contains(name, '截图') OR contains(name, 'screencapture') THEN 'SCREENSHOT_FILENAME' END,
  CASE WHEN starts_with(path, 'screenshots/') OR contains(path, '截图') OR contains(path, '截屏') OR contains(path, 'screenshot') THEN 'SCREENSHOT_PATH' END,
  CASE WHEN folder IN ('download', 'downloads', '下载', 'baidunetdisk') THEN 'DOWNLOAD_PATH' END,
  CASE WHEN contains(name, 'screenrecording') OR contains(name, '录屏') OR contains(name, 'screen record') THEN 'SCREEN_RECORDING_FILENAME' END], lambda x: x IS NOT NULL), ',') AS reasons, folder FROM q"""
)
def junk_rules(spark, sf_dir):
    """The last folder stands beside the reasons, as few test paths are junk."""
    path = F.lower(F.regexp_replace(F.substring_index(F.substring_index("url", "?", 1), "#", 1), "^[a-z]+://", ""))
    p = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return p.select("page_id", F.array_join(S.junk_reasons(F.substring_index("path", "/", -1), F.col("path")), ",").alias("reasons"), X.last_folder("path").alias("folder"))


#: Strong and middle rules over the test corpus's own signals: secrets, mail, licences, long numbers.
RULES = [
    S.TextRule(r"AKIA[0-9A-Z]{8,}|sk-[A-Za-z0-9]{8,}|BEGIN [A-Z ]*PRIVATE KEY", 10, "secret"),
    S.TextRule(r"[A-Za-z0-9._]+@[A-Za-z0-9.]+", 6, "mail"),
    S.TextRule(r"[Ll]icen[sc]e", 3, "licence"),
    S.TextRule(r"[0-9]{3}-[0-9]{4}", 5, "number"),
]
NAME_RULES = [S.TextRule(r"src1", 4, "name"), S.TextRule(r"src7", 6, "sensitive")]

_SCORE = """
WITH s AS (SELECT doc_id, lang,
  CASE WHEN regexp_matches(text, 'AKIA[0-9A-Z]{8,}|sk-[A-Za-z0-9]{8,}|BEGIN [A-Z ]*PRIVATE KEY') THEN 10 ELSE 0 END AS a,
  CASE WHEN regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+') THEN 6 ELSE 0 END AS b,
  CASE WHEN regexp_matches(text, '[Ll]icen[sc]e') THEN 3 ELSE 0 END AS c,
  CASE WHEN regexp_matches(text, '[0-9]{3}-[0-9]{4}') THEN 5 ELSE 0 END AS d,
  CASE WHEN contains(source, 'src1') THEN 2 ELSE 0 END AS e, CASE WHEN contains(source, 'src7') THEN 5 ELSE 0 END AS f FROM documents)
"""


def _scored(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text", "source")
    score, why = S.rule_score(F.col("text"), RULES, F.col("source"), NAME_RULES, "sensitive")
    return d.select("doc_id", "lang", score.alias("score"), why.alias("reasons"))


@query(
    _SCORE
    + """SELECT doc_id, CAST(a + b + c + d + e + f AS INTEGER) AS score, concat_ws('+', CASE WHEN a > 0 THEN 'secret' END, CASE WHEN b > 0 THEN 'mail' END, CASE WHEN c > 0 THEN 'licence' END,
  CASE WHEN d > 0 THEN 'number' END, CASE WHEN e > 0 THEN 'name' END, CASE WHEN f > 0 THEN 'sensitive' END) AS reasons FROM s WHERE a + b + c + d + e + f > 0"""
)
def privacy_score(spark, sf_dir):
    return _scored(spark, sf_dir).filter("score > 0").select("doc_id", "score", "reasons")


@query(_SCORE + "SELECT doc_id, CASE WHEN a + b + c + d + e + f >= 10 THEN 'auto' WHEN a + b + c + d + e + f >= 5 OR lang = 'de' THEN 'review' ELSE 'below' END AS route FROM s")
def cascade_route(spark, sf_dir):
    """German documents stand for videos without a description."""
    return _scored(spark, sf_dir).select("doc_id", S.cascade(F.col("score"), F.col("lang") != "de", F.col("lang") == "de").alias("route"))


@query(
    """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents),
k AS (SELECT doc_id, line_no, 'licence' AS kind FROM l WHERE regexp_matches(line, '[Ll]icen[sc]e') AND NOT regexp_matches(line, 'example') UNION ALL
  SELECT doc_id, line_no, 'mail' FROM l WHERE regexp_matches(line, '[A-Za-z0-9._]+@[A-Za-z0-9.]+') AND NOT regexp_matches(line, 'example'))
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, kind FROM k"""
)
def secret_line_scan(spark, sf_dir):
    return S.secret_lines(table(spark, sf_dir, "documents"), "doc_id", "text", {"licence": r"[Ll]icen[sc]e", "mail": r"[A-Za-z0-9._]+@[A-Za-z0-9.]+"}, safe="example")


@query(
    """
WITH f AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'a_d.mp4' WHEN 1 THEN 'b.insv' WHEN 2 THEN 'dji_1.mp4' WHEN 3 THEN 'vid_2_00_1.mp4' WHEN 4 THEN 'gx01.mp4' WHEN 5 THEN 'insta360.mp4' ELSE lower(url) END AS n FROM pages)
SELECT page_id, CASE WHEN regexp_matches(n, '_d[.](mp4|jpg|mov)$') THEN 'DJI' WHEN regexp_matches(n, '[.](insp|insv)$') THEN 'Insta360' WHEN contains(n, 'dji') THEN 'DJI' WHEN contains(n, 'insta360') THEN 'Insta360'
  WHEN (starts_with(n, 'vid_') AND contains(n, '_00_')) OR starts_with(n, 'gx') THEN 'Insta360' END AS camera,
  CASE WHEN regexp_matches(n, '_d[.](mp4|jpg|mov)$') THEN 'dlog' WHEN regexp_matches(n, '[.](insp|insv)$') THEN 'flat' WHEN contains(n, 'dji') OR contains(n, 'insta360') OR (starts_with(n, 'vid_') AND contains(n, '_00_')) OR starts_with(n, 'gx') THEN 'unknown' END AS profile,
  CASE WHEN regexp_matches(n, '_d[.](mp4|jpg|mov)$') THEN 0.95 WHEN regexp_matches(n, '[.](insp|insv)$') THEN 0.9 WHEN contains(n, 'dji') OR contains(n, 'insta360') OR (starts_with(n, 'vid_') AND contains(n, '_00_')) OR starts_with(n, 'gx') THEN 0.3 END AS confidence,
  CASE WHEN regexp_matches(n, '_d[.](mp4|jpg|mov)$|[.](insp|insv)$') THEN 1 END AS is_log FROM f"""
)
def log_profiles(spark, sf_dir):
    """File names of each kind by the page's id; every seventh is the page's own address."""
    m = F.col("page_id") % 7
    name = F.when(m == 0, "A_D.MP4").when(m == 1, "b.insv").when(m == 2, "DJI_1.mp4").when(m == 3, "vid_2_00_1.mp4").when(m == 4, "GX01.mp4").when(m == 5, "insta360.mp4").otherwise(F.col("url"))
    got = S.log_profile(name)
    return table(spark, sf_dir, "pages").select("page_id", *[got[c].alias(c) for c in ("camera", "profile", "confidence", "is_log")])


@query(
    """
WITH c AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'WXP://f2f0' || page_id WHEN 1 THEN ' https://qr.alipay.com/' || page_id ELSE url END AS code FROM pages)
SELECT page_id, CASE WHEN starts_with(lower(trim(code)), 'wxp://') OR contains(lower(code), 'wx.tenpay.com') THEN 'payment_qrcode_wechat' WHEN contains(lower(code), 'alipay') THEN 'payment_qrcode_alipay' WHEN code IS NOT NULL THEN 'qrcode' ELSE 'qrcode' END AS kind FROM c"""
)
def qr_classes(spark, sf_dir):
    m, n = F.col("page_id") % 3, F.col("page_id").cast("string")
    code = F.when(m == 0, F.concat(F.lit("WXP://f2f0"), n)).when(m == 1, F.concat(F.lit(" https://qr.alipay.com/"), n)).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", S.qr_class(code).alias("kind"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'tion')")
def trigram_search(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return Q.contains(d, None, "doc_id", "text", "Tion").select("doc_id")


@query("SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'tion')")
def trigram_lookup(spark, sf_dir):
    """The same through an index that is written by gram, of which a lookup reads the asked grams."""
    from ..sources.tables import shared_folder

    c = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("key"), "conv_id", "turn", "text")
    path = f"{shared_folder(spark)}/grams-{uuid.uuid4().hex}"
    Q.dealt_by_gram(Q.trigram_index(c, "key", "text"), c, "key", "text").sortWithinPartitions("gram").write.parquet(path)
    return Q.contains(c, spark.read.parquet(path), "key", "text", "Tion").select("conv_id", "turn")


@query("SELECT gram, count(*) AS n FROM (SELECT DISTINCT conv_id, turn, substr(t, i, 3) AS gram FROM (SELECT conv_id, turn, lower(text) AS t, unnest(range(1, length(text) - 1)) AS i FROM conversations)) GROUP BY 1")
def trigram_counts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("key"), "text")
    return Q.trigram_index(c, "key", "text").groupBy("gram").agg(F.count("*").alias("n"))


@query(
    """
WITH t AS (SELECT conv_id, turn, role AS day, list_distinct(string_split(lower(regexp_replace(text, '[^A-Za-z ]', '', 'g')), ' ')) AS tags FROM conversations),
p AS (SELECT a.conv_id, a.turn AS a, b.turn AS b, a.day IS NOT DISTINCT FROM b.day AS same, len(list_intersect(a.tags, b.tags)) AS i, len(list_distinct(list_concat(a.tags, b.tags))) AS u FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn < b.turn)
SELECT conv_id, a, b, CASE WHEN same THEN 0.5 ELSE 0 END + coalesce(0.5 * i / nullif(u, 0), 0) AS sim FROM p"""
)
def mmr_sim(spark, sf_dir):
    """All turns with all their words: a conversation stands for a query's candidates, a role for a day."""
    tags = F.array_distinct(F.split(F.lower(F.regexp_replace("text", "[^A-Za-z ]", "")), " "))
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", tags.alias("tags"))
    return Q.alike_within(t, "conv_id", "turn", "role", "tags")


@query(
    """
WITH t AS (SELECT doc_id, doc_id // 64 AS query, CAST(doc_id % 5 AS VARCHAR) AS day, list_distinct(string_split(lower(regexp_replace(text, '[^A-Za-z ]', '', 'g')), ' ')) AS tags FROM documents),
p AS (SELECT a.query, a.doc_id AS a, b.doc_id AS b, a.day = b.day AS same, len(list_intersect(a.tags, b.tags)) AS i, len(list_distinct(list_concat(a.tags, b.tags))) AS u FROM t a JOIN t b ON a.query = b.query AND a.doc_id < b.doc_id)
SELECT query, a, b, CASE WHEN same THEN 0.5 ELSE 0 END + 0.5 * i / u AS sim FROM p"""
)
def mmr_sim_all(spark, sf_dir):
    """All documents with all their words: each run of 64 ids stands for a query's candidates."""
    tags = F.array_distinct(F.split(F.lower(F.regexp_replace("text", "[^A-Za-z ]", "")), " "))
    t = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 64).alias("query"), (F.col("doc_id") % 5).cast("string").alias("day"), tags.alias("tags"))
    return Q.alike_within(t, "query", "doc_id", "day", "tags")


@query()
def mmr_topk(spark, sf_dir):
    """Greedy re-ranking per user; tests check the visible contract."""
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("query"), F.col("event_id").alias("id"), F.col("value").alias("score"), F.to_date("ts").cast("string").alias("day"), F.array("event_type").alias("tags")
    )
    return Q.rerank(e, 10)


@query(
    """
WITH t AS (SELECT conv_id, turn, text || CASE turn % 3 WHEN 0 THEN ' Video 2019' WHEN 1 THEN ' photo' ELSE '' END AS text FROM conversations)
SELECT conv_id, turn, CASE WHEN contains(lower(text), '视频') OR contains(lower(text), '录像') OR contains(lower(text), 'video') THEN 'video' WHEN contains(lower(text), '照片') OR contains(lower(text), '相片') OR contains(lower(text), 'photo') THEN 'photo' END AS media_type,
  TRY_CAST(nullif(regexp_extract(text, '((?:19|20)[0-9]{2})', 1), '') AS INTEGER) AS year FROM t"""
)
def request_intents(spark, sf_dir):
    """Turns as requests; most name no kind of media by themselves, so some get a word or two."""
    c, m = table(spark, sf_dir, "conversations"), F.col("turn") % 3
    got = Q.intent(F.concat("text", F.when(m == 0, " Video 2019").when(m == 1, " photo").otherwise("")), ["孩子"], [])
    return c.select("conv_id", "turn", got["media_type"].alias("media_type"), got["year"].alias("year"))


# Mutations ----------------------------------------------------------------------------------------------
def _accounts(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment").filter("c_acctbal < 6000")
    new = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"), F.when(F.col("c_custkey") % 2 == 0, "NEW").alias("c_mktsegment"), F.col("c_acctbal").alias("b")).filter("b >= 3000").drop("b")
    return old, new


_ACC = "WITH o AS (SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal < 6000), n AS (SELECT c_custkey, c_acctbal + 1 AS c_acctbal, CASE WHEN c_custkey % 2 = 0 THEN 'NEW' END AS c_mktsegment FROM customer WHERE customer.c_acctbal >= 3000) "


@query(_ACC + "SELECT * FROM n UNION ALL SELECT * FROM o WHERE c_custkey NOT IN (SELECT c_custkey FROM n)")
def upsert_replace(spark, sf_dir):
    return C.replace(*_accounts(spark, sf_dir), ["c_custkey"])


@query(_ACC + "SELECT * FROM o UNION ALL SELECT * FROM n WHERE c_custkey NOT IN (SELECT c_custkey FROM o)")
def upsert_ignore(spark, sf_dir):
    return C.ignore(*_accounts(spark, sf_dir), ["c_custkey"])


@query(
    _ACC
    + """SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN o.c_custkey IS NOT NULL AND n.c_custkey IS NOT NULL THEN n.c_acctbal ELSE coalesce(o.c_acctbal, n.c_acctbal) END AS c_acctbal,
  CASE WHEN o.c_custkey IS NOT NULL AND n.c_custkey IS NOT NULL THEN coalesce(n.c_mktsegment, o.c_mktsegment) ELSE coalesce(o.c_mktsegment, n.c_mktsegment) END AS c_mktsegment FROM o FULL JOIN n ON o.c_custkey = n.c_custkey"""
)
def upsert_update(spark, sf_dir):
    return C.upsert(*_accounts(spark, sf_dir), ["c_custkey"], {"c_acctbal": "new", "c_mktsegment": "coalesce"})


@query(_ACC + "SELECT * FROM o WHERE c_custkey NOT IN (SELECT c_custkey FROM n WHERE c_acctbal > 5000)")
def delete_in(spark, sf_dir):
    old, new = _accounts(spark, sf_dir)
    return C.delete(old, new.filter("c_acctbal > 5000"), ["c_custkey"])


@query(_ACC + "SELECT o.c_custkey, CASE WHEN n.c_custkey IS NULL THEN o.c_acctbal ELSE n.c_acctbal END AS c_acctbal, o.c_mktsegment FROM o LEFT JOIN n ON n.c_custkey = o.c_custkey")
def keyed_update(spark, sf_dir):
    old, new = _accounts(spark, sf_dir)
    return C.update_from(old, new, ["c_custkey"], ["c_acctbal"])


def _all_accounts(spark, sf_dir):
    """Old and new accounts by attributes, so that both and what they share grow with the table."""
    c = table(spark, sf_dir, "customer")
    old = c.filter("c_mktsegment <> 'BUILDING'").select("c_custkey", "c_acctbal", "c_mktsegment")
    new = c.filter("c_nationkey % 3 <> 0").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"), F.when(F.col("c_custkey") % 2 == 0, "NEW").alias("c_mktsegment"))
    return old, new


_ALL = _ACC.replace("WHERE c_acctbal < 6000", "WHERE c_mktsegment <> 'BUILDING'").replace("WHERE customer.c_acctbal >= 3000", "WHERE c_nationkey % 3 <> 0")


@query(_ALL + "SELECT * FROM n UNION ALL SELECT * FROM o WHERE c_custkey NOT IN (SELECT c_custkey FROM n)")
def upsert_replace_all(spark, sf_dir):
    return C.replace(*_all_accounts(spark, sf_dir), ["c_custkey"])


@query(_ALL + "SELECT * FROM o UNION ALL SELECT * FROM n WHERE c_custkey NOT IN (SELECT c_custkey FROM o)")
def upsert_ignore_all(spark, sf_dir):
    return C.ignore(*_all_accounts(spark, sf_dir), ["c_custkey"])


@query(
    _ALL
    + """SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal, coalesce(n.c_mktsegment, o.c_mktsegment) AS c_mktsegment
  FROM o FULL JOIN n ON o.c_custkey = n.c_custkey"""
)
def upsert_update_all(spark, sf_dir):
    return C.upsert(*_all_accounts(spark, sf_dir), ["c_custkey"], {"c_acctbal": "new", "c_mktsegment": "coalesce"})


@query(_ALL + "SELECT * FROM o WHERE c_custkey NOT IN (SELECT c_custkey FROM n WHERE c_acctbal > 5000)")
def delete_in_all(spark, sf_dir):
    old, new = _all_accounts(spark, sf_dir)
    return C.delete(old, new.filter("c_acctbal > 5000"), ["c_custkey"])


@query(_ALL + "SELECT o.c_custkey, CASE WHEN n.c_custkey IS NULL THEN o.c_acctbal ELSE n.c_acctbal END AS c_acctbal, o.c_mktsegment FROM o LEFT JOIN n ON n.c_custkey = o.c_custkey")
def keyed_update_all(spark, sf_dir):
    old, new = _all_accounts(spark, sf_dir)
    return C.update_from(old, new, ["c_custkey"], ["c_acctbal"])


@query("SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey DESC) = 1 AS is_best FROM supplier")
def exclusive_flag(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return C.exclusive(s, "s_nationkey", [F.col("s_acctbal").desc(), F.col("s_suppkey").desc()], "is_best").select("s_suppkey", "s_nationkey", "is_best")


@query("SELECT n_nationkey, CAST(coalesce(n, 0) AS BIGINT) AS member_count FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey")
def recount_members(spark, sf_dir):
    return C.recount(table(spark, sf_dir, "nation").select("n_nationkey"), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey")), "n_nationkey", "member_count")


@query(
    """
WITH t AS (SELECT DISTINCT 'a' || user_id AS asset_id, event_type AS tag FROM events)
SELECT asset_id, tag, 'auto' AS source, 0.5 AS confidence FROM t WHERE NOT (asset_id IN ('a1', 'a2', 'a3') AND tag = 'click')
UNION ALL SELECT x, 'merged', 'manual', 1.0 FROM (VALUES ('a1'), ('a2'), ('a3')) v(x)"""
)
def retag(spark, sf_dir):
    t = table(spark, sf_dir, "events").select(F.concat(F.lit("a"), F.col("user_id").cast("string")).alias("asset_id"), F.col("event_type").alias("tag"), F.lit("auto").alias("source"), F.lit(0.5).alias("confidence")).distinct()
    return C.move_tag(t, ["a1", "a2", "a3"], "click", "merged")[0]


@query(
    """
SELECT l_orderkey AS asset_id, l_linenumber, CASE WHEN l_orderkey = 7 AND l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS person_id, CASE WHEN l_orderkey = 7 AND l_returnflag = 'N' THEN 1 ELSE 0 END AS person_locked FROM lineitem"""
)
def reassign(spark, sf_dir):
    """A blank target: nobody, and locked."""
    f = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("asset_id"), "l_linenumber", F.col("l_returnflag").alias("person_id"), F.lit(0).alias("person_locked"))
    people = spark.createDataFrame([("A",), ("N",), ("R",)], "person_id string")
    n = f.filter("asset_id = 7 and person_id = 'N'").count()
    return C.reassign_person(f, people, "7", "N", " ")[0] if n else f


@query(
    """
SELECT l_orderkey AS asset_id, l_linenumber, CASE WHEN l_orderkey = 7 AND l_returnflag = 'N' THEN 'R' ELSE l_returnflag END AS person_id, CASE WHEN l_orderkey = 7 AND l_returnflag = 'N' THEN 1 ELSE 0 END AS person_locked FROM lineitem"""
)
def reassign_all(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("asset_id"), "l_linenumber", F.col("l_returnflag").alias("person_id"), F.lit(0).alias("person_locked"))
    people = spark.createDataFrame([("A",), ("N",), ("R",)], "person_id string")
    n = f.filter("asset_id = 7 and person_id = 'N'").count()
    return C.reassign_person(f, people, "7", "N", "R")[0] if n else f


@query(
    """
WITH l AS (SELECT r_name AS kind, n_name AS target, '' AS parent, CAST(n_nationkey AS INTEGER) AS sort_order, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END AS show_on_home FROM nation JOIN region ON r_regionkey = n_regionkey),
m AS (SELECT min(kind) AS kind FROM l), p AS (SELECT target, CAST(row_number() OVER (ORDER BY target DESC) - 1 AS INTEGER) AS place FROM l WHERE kind = (SELECT kind FROM m))
SELECT kind, l.target, parent, CASE WHEN kind = (SELECT kind FROM m) THEN place ELSE sort_order END AS sort_order, show_on_home FROM l LEFT JOIN p ON p.target = l.target AND kind = (SELECT kind FROM m)
UNION ALL SELECT kind, 'somewhere', '', (SELECT CAST(count(*) AS INTEGER) FROM p), 1 FROM m"""
)
def layout_sort(spark, sf_dir):
    """Nations are laid out by region; those of the first region are put in falling order, a new one behind them."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    old = n.select(F.col("r_name").alias("kind"), F.col("n_name").alias("target"), F.lit("").alias("parent"), F.col("n_nationkey").cast("int").alias("sort_order"), F.when(F.col("n_nationkey") % 2 == 0, 1).otherwise(0).alias("show_on_home"))
    kind = old.agg(F.min("kind")).first()[0]
    asked = [r[0] for r in old.filter(F.col("kind") == kind).orderBy(F.col("target").desc()).select("target").collect()]  # a user's list of a page
    return C.sort_layout(old, kind, [*asked, "somewhere"])


@query("SELECT 'unique' AS constraint_name, count(*) AS n FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'quantity', count(*) FROM lineitem WHERE l_quantity > 49")
def constraint_report(spark, sf_dir):
    bad = C.violations(table(spark, sf_dir, "lineitem"), key=["l_orderkey", "l_linenumber"], checks={"quantity": F.col("l_quantity") <= 49, "price": F.col("l_extendedprice") > 0})
    return bad.withColumnRenamed("constraint", "constraint_name")


# Incremental --------------------------------------------------------------------------------------------
@query("SELECT doc_id, 'blur' AS step, '2' AS version FROM documents WHERE lang <> 'en' UNION ALL SELECT doc_id, 'blur', '1' FROM documents WHERE lang = 'en'")
def marks_idempotent(spark, sf_dir):
    """The same delta twice leaves one mark per row and step; a newer version replaces the older."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    state = I.marks(d, "blur", "doc_id")
    new = I.marks(d.filter("lang <> 'en'"), "blur", "doc_id", "2")
    return I.record(I.record(state, new, "doc_id"), new, "doc_id")


@query(
    """
SELECT 'label' AS step, count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
UNION ALL SELECT 'hash', count(*) FROM documents WHERE n_chars IN (SELECT n_chars FROM documents GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'vision', count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)"""
)
def pending_counts(spark, sf_dir):
    from ..operators import relational as R

    d, lab = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels")
    state = lab.select("doc_id", F.lit("label").alias("step"), F.lit("1").alias("version"))
    return I.pending({"label": I.backlog(d, state, "label", "doc_id"), "hash": R.colliding(d, "n_chars"), "vision": R.without(d, lab.filter("toxic = 1"), "doc_id")})


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars IN (SELECT n_chars FROM documents WHERE doc_id % 10 = 0)")
def late_arrivals(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return I.touched_groups(d.filter("doc_id % 10 <> 0"), d.filter("doc_id % 10 = 0"), "n_chars")
