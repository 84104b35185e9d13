"""Similarity joins, clusters, votes and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import graph as G
from ..operators import grouping as E
from ..operators import scoring as S
from ..operators import sets as K
from ..operators import similarity as M
from ..operators import sweep
from ..operators.relational import top
from ..operators.stars import similar_stars
from ..sources.tables import table
from .catalog import query

_DOT = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query("SELECT a.doc_id AS a, b.doc_id AS b FROM documents a JOIN documents b ON sha256(a.text) = sha256(b.text) AND a.doc_id < b.doc_id")
def hash_pairs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("d"))
    return M.digest_pairs(d, "doc_id", "d")


@query("SELECT doc_id, first FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first FROM documents) WHERE doc_id <> first")
def hash_links(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("d"))
    return M.digest_links(d, "doc_id", "d").select("doc_id", "first")


@query(
    """
WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings)
SELECT a, b, dist FROM (
  SELECT a.vec_id AS a, b.vec_id AS b, CAST(list_sum(list_transform(list_zip(a.bits, b.bits), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS INTEGER) AS dist
  FROM s a JOIN s b ON a.vec_id < b.vec_id) WHERE dist <= 18"""
)
def hamming_pairs(spark, sf_dir):
    codes = table(spark, sf_dir, "embeddings").select("vec_id", X.sign_bits("embedding", 64).alias("code"))
    return M.hamming_pairs(codes, "vec_id", "code", 18)


def _timed(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), (F.col("event_id") * 2654435761 % 65536).cast("bigint").alias("code"))


@query(
    """
WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS us, event_id * 2654435761 % 65536 AS code FROM events)
SELECT a.event_id AS a, b.event_id AS b, CAST(bit_count(xor(a.code, b.code)) AS INTEGER) AS dist FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id < b.event_id
AND abs(a.us - b.us) <= 172800000000 AND bit_count(xor(a.code, b.code)) <= 3"""
)
def interval_hamming(spark, sf_dir):
    near = X.hamming("a_code", "b_code")
    return M.interval_pairs(_timed(spark, sf_dir), "event_id", "user_id", "us", 172800000000, near <= 3, ["code"]).select("a", "b", near.alias("dist"))


@query("SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 5400000000")
def interval_join(spark, sf_dir):
    return M.interval_pairs(_timed(spark, sf_dir), "event_id", "user_id", "us", 5400000000).select("a", "b")


@query(
    """
SELECT a, dt, b FROM (SELECT a, b, dt, row_number() OVER (PARTITION BY a ORDER BY dt, b) AS rn FROM (
  SELECT a.event_id AS a, b.event_id AS b, abs(epoch_us(a.ts) - epoch_us(b.ts)) AS dt FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id WHERE abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 172800000000))
WHERE rn <= 2"""
)
def capped_candidates(spark, sf_dir):
    pairs = M.interval_pairs(_timed(spark, sf_dir), "event_id", "user_id", "us", 172800000000)
    return M.nearest_in_time(pairs, "a", 2).select("a", "dt", "b")


@query(
    """
SELECT event_id, near, dt, CAST(rank AS INTEGER) AS rank FROM (SELECT a.event_id, b.event_id AS near, abs(epoch_us(a.ts) - epoch_us(b.ts)) AS dt, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(epoch_us(a.ts) - epoch_us(b.ts)), b.event_id) AS rank
  FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 172800000000) WHERE rank <= 4"""
)
def nearest_candidates(spark, sf_dir):
    """The four events of the same user nearest in time, before or after, within 48 hours."""
    return sweep.nearest(_timed(spark, sf_dir), "event_id", "user_id", "us", 172800000000, 4)


@query(
    """
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events), f AS (SELECT user_id, min(us) AS us FROM e GROUP BY 1),
n(user_id, us) AS (SELECT * FROM f UNION ALL SELECT n.user_id, min(e.us) FROM n JOIN e ON e.user_id = n.user_id AND e.us > n.us + 86400000000 GROUP BY n.user_id)
SELECT e.event_id, max(n.us) AS anchor FROM e JOIN n ON n.user_id = e.user_id AND n.us <= e.us GROUP BY 1"""
)
def anchor_marks(spark, sf_dir):
    """Windows of a day that start at a user's first event after the end of the last window."""
    e = _timed(spark, sf_dir)
    return e.join(sweep.marks(e, "user_id", "us", 86400000000), ["user_id", "us"]).select("event_id", "anchor")


@query(
    r"""
WITH t AS (SELECT doc_id, list_sort(list_distinct(list_filter(string_split_regex(lower(regexp_replace(text, '[^A-Za-z ]', '', 'g')), ' +'), lambda x: len(x) > 3))) AS s FROM documents),
c AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY s) AS first FROM t WHERE len(s) > 0),
u AS (SELECT doc_id, unnest(s) AS w FROM c WHERE doc_id = first), n AS (SELECT doc_id, len(s) AS n FROM c WHERE doc_id = first),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM u a JOIN u b ON a.w = b.w AND a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT a, b, i / (x.n + y.n - i) AS sim FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE i / (x.n + y.n - i) >= 0.6
UNION ALL SELECT first, doc_id, 1.0 FROM c WHERE first <> doc_id"""
)
def similar_token_sets(spark, sf_dir):
    """Documents whose sets of longer words are alike to six tenths; copies are linked with their first."""
    words = F.filter(F.split(F.lower(F.regexp_replace("text", "[^A-Za-z ]", "")), " +"), lambda x: F.length(x) > 3)
    return K.similar_sets(table(spark, sf_dir, "documents").select("doc_id", words.alias("s")), "doc_id", "s", 0.6)


@query(
    """
WITH u AS (SELECT DISTINCT doc_id, sha256(line) AS d FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) >= 30),
f AS (SELECT d, min(doc_id) AS first FROM u GROUP BY 1)
SELECT DISTINCT first, doc_id FROM u JOIN f USING (d) WHERE first < doc_id"""
)
def shared_digests(spark, sf_dir):
    """Documents that have the digest of any longer line in common, linked with the first that has it."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(x) >= 30)
    return K.sharing(table(spark, sf_dir, "documents").select("doc_id", F.transform(lines, lambda x: F.sha2(x, 256)).alias("d")), "doc_id", "d")


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({_DOT}, 4) AS sim FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id AND {_DOT} >= 0.3")
def label_cosine(spark, sf_dir):
    return M.similar_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.3, within="label")


_MOMENTS = "m AS (SELECT vec_id, label, vec_id * 37 % 1000 AS sec, embedding FROM embeddings)"
_COSINE = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


def _moments(spark, sf_dir):
    """Vectors of sources (labels) at seconds made from their ids."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", (F.col("vec_id") * 37 % 1000).alias("at"), "embedding")


@query(f"WITH {_MOMENTS} SELECT a.vec_id AS a, b.vec_id AS b, round({_COSINE}, 4) AS sim FROM m a JOIN m b ON a.label = b.label AND a.vec_id < b.vec_id AND abs(a.sec - b.sec) <= 90 AND {_COSINE} >= 0.2")
def interval_cosine(spark, sf_dir):
    return M.interval_vectors(_moments(spark, sf_dir), "vec_id", "label", "at", "embedding", 90, 0.2).select("a", "b", F.round("sim", 4).alias("sim"))


@query(
    f"""
WITH RECURSIVE {_MOMENTS},
n(label, anchor) AS (SELECT label, min(sec) FROM m GROUP BY 1 UNION ALL SELECT n.label, min(m.sec) FROM n JOIN m ON m.label = n.label AND m.sec > n.anchor + 90 GROUP BY n.label),
w AS (SELECT m.*, (SELECT max(anchor) FROM n WHERE n.label = m.label AND n.anchor <= m.sec) AS anchor FROM m)
SELECT a.vec_id AS a, b.vec_id AS b, round({_COSINE}, 4) AS sim FROM w a JOIN w b ON a.label = b.label AND a.anchor = b.anchor AND a.vec_id < b.vec_id AND {_COSINE} >= 0.25"""
)
def anchored_pairs(spark, sf_dir):
    return M.anchored_pairs(_moments(spark, sf_dir), "vec_id", "label", "at", "embedding", 90, 0.25).select("a", "b", F.round("sim", 4).alias("sim"))


_NEW_OLD = f"WITH {_MOMENTS}, o AS (SELECT * FROM m WHERE label % 2 = 0), n AS (SELECT *, label - 1 AS source FROM m WHERE label % 2 = 1), b AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings)"


@query(
    _NEW_OLD
    + f""", p AS (SELECT a.vec_id AS asset_id, b.vec_id AS group_id, {_COSINE} AS sim, abs(a.sec - b.sec) AS dt, a.embedding = b.embedding AS same,
  list_sum(list_transform(list_zip(x.bits, y.bits), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS dist FROM n a JOIN o b ON a.source = b.label AND abs(a.sec - b.sec) <= 90 JOIN b x ON x.vec_id = a.vec_id JOIN b y ON y.vec_id = b.vec_id),
q AS (SELECT asset_id, group_id FROM p WHERE dist <= 20 AND dt <= 60 OR sim >= 0.3 UNION ALL SELECT a.vec_id, b.vec_id FROM n a JOIN o b ON a.embedding = b.embedding)
SELECT asset_id, min(group_id) AS group_id FROM q GROUP BY 1"""
)
def strong_matches(spark, sf_dir):
    """Vectors of odd labels come anew into the source before theirs; each vector of an even label leads a
    group. Equal digests, near codes within a minute, or near vectors within 90 seconds match."""
    m = _moments(spark, sf_dir).withColumns({"code": X.sign_bits("embedding", 64), "digest": F.sha2(F.to_json("embedding"), 256)})
    new = m.filter("label % 2 = 1").withColumn("label", F.col("label") - 1).withColumnRenamed("vec_id", "asset_id")
    old = m.filter("label % 2 = 0").withColumnRenamed("vec_id", "group_id")
    arms = M.strong_arms(new, old, "label", "at", code=("code", 20, 60), vector=("embedding", 0.3, 90), digest="digest")
    return M.first_match(new.select("asset_id"), arms, "asset_id", "group_id").select("asset_id", "group_id")


@query()
def star_clusters(spark, sf_dir):
    """Greedy clusters; tests compare with a loop."""
    return similar_stars(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.3)


@query(
    f"""
WITH RECURSIVE e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND {_DOT} >= 0.4),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(n, m) AS (SELECT a, a FROM s UNION SELECT s.b, r.m FROM r JOIN s ON s.a = r.n)
SELECT n AS node, min(m) AS component FROM r GROUP BY 1"""
)
def similarity_components(spark, sf_dir):
    return G.components(M.similar_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.4).select("a", "b"))


@query(
    """
WITH RECURSIVE u AS (SELECT doc_id, sha256(line) AS d FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) >= 30),
f AS (SELECT d, min(doc_id) AS first FROM u GROUP BY 1), e AS (SELECT DISTINCT first AS a, doc_id AS b FROM u JOIN f USING (d) WHERE first < doc_id),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(n, m) AS (SELECT a, a FROM s UNION SELECT s.b, r.m FROM r JOIN s ON s.a = r.n)
SELECT n AS node, min(m) AS component FROM r GROUP BY 1"""
)
def incremental_components(spark, sf_dir):
    """Links over shared lines that come in three batches, by id: each batch only moves the components it touches."""
    links = shared_digests(spark, sf_dir).select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    labels = G.components(links.filter("(a + b) % 3 = 0"))
    for k in (1, 2):
        labels = E.extend_components(labels, links.filter(f"(a + b) % 3 = {k}")).select("node", "component")
    return labels


@query()
def similar_grouping(spark, sf_dir):
    """One run of the grouping step over new vectors; tests hold it against a loop. Every tenth vector leads an old
    group of the two after it, every third of the others was done before; bounds fit these vectors."""
    m = _moments(spark, sf_dir)
    asset = F.format_string("a%07d", F.col("vec_id"))
    photos = m.select("vec_id", asset.alias("asset_id"), F.col("label").cast("string").alias("source"), "at", X.sign_bits("embedding", 64).alias("code"), "embedding", F.get("embedding", F.lit(0)).cast("double").alias("score"))
    photos = photos.withColumn("digest", F.sha2(F.to_json(F.slice("embedding", 1, 1)), 256)).withColumnRenamed("embedding", "vector")
    old = photos.filter("vec_id % 10 < 3").withColumn("group_id", X.serial_id("sim_", F.expr("vec_id div 10")))
    groups = old.filter("vec_id % 10 = 0").select("group_id", F.col("asset_id").alias("best"))
    step = E.similar_step(photos.drop("vec_id"), groups, old.select("group_id", "asset_id"), photos.filter("vec_id % 10 in (5, 8)").select("asset_id"), photos.filter("vec_id % 50 = 0").select("asset_id"), append=(18, 60), near=(20, 400), alike=(0.3, 90))
    return step[0]


@query(
    """
WITH g AS (SELECT sha256(text) AS d, min(doc_id) AS group_id FROM documents WHERE doc_id % 2 = 0 GROUP BY 1),
c AS (SELECT n_chars, min(doc_id) AS group_id FROM documents WHERE doc_id % 2 = 0 GROUP BY 1),
m AS (SELECT doc_id, group_id FROM documents JOIN g ON g.d = sha256(text) WHERE doc_id % 2 = 1 UNION ALL SELECT doc_id, group_id FROM documents JOIN c USING (n_chars) WHERE doc_id % 2 = 1)
SELECT doc_id, min(group_id) AS group_id FROM m GROUP BY 1"""
)
def strong_match_append(spark, sf_dir):
    """New rows are the odd ids, groups are led by even ones: two kinds of match, the first group wins."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.sha2("text", 256).alias("d"))
    old, new = d.filter("doc_id % 2 = 0"), d.filter("doc_id % 2 = 1")
    by = [new.join(old.groupBy(c).agg(F.min("doc_id").alias("group_id")), c) for c in ("d", "n_chars")]
    return M.first_match(new.select("doc_id"), by, "doc_id", "group_id").select("doc_id", "group_id")


@query(
    f"""
WITH n AS (SELECT query, label FROM (
  SELECT a.vec_id AS query, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DOT} DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= 10),
v AS (SELECT query, label, count(*) AS votes FROM n GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY votes DESC, label) AS rn, coalesce(lead(votes) OVER (PARTITION BY query ORDER BY votes DESC, label), 0) AS second FROM v)
SELECT query, label, votes, second, CASE WHEN votes - second < 2 THEN 'abstain_margin' WHEN votes / 10 < 0.4 THEN 'abstain_ratio' ELSE 'assign' END AS decision FROM r WHERE rn = 1"""
)
def knn_vote(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    near = M.knn(e.select("vec_id", "embedding"), e, "vec_id", "embedding", "label", 10, skip_self=True)
    return S.vote(near, 10, ratio=0.4, margin=2, least=-2.0).select("query", "label", F.col("votes").cast("bigint").alias("votes"), F.col("second").cast("bigint").alias("second"), "decision")


@query(
    f"""
SELECT query, ref, round(sim, 4) AS sim, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, ref) AS rank FROM (
    SELECT a.vec_id AS query, b.vec_id AS ref, CASE WHEN b.vec_id < a.vec_id THEN {_DOT} ELSE -1.0 END AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id))
WHERE rank <= 3 AND sim > -1"""
)
def knn_gated(spark, sf_dir):
    """References that come after the query aren't valid for it."""
    e = table(spark, sf_dir, "embeddings")
    near = M.knn(e.select("vec_id", "embedding"), e, "vec_id", "embedding", "label", 3, valid=("vec_id", "vec_id"), skip_self=True)
    return near.filter("sim > -1").select("query", "ref", F.round("sim", 4).alias("sim"), "rank")


_CLASS = f"""
WITH s AS (SELECT a.vec_id AS query, a.label AS own, b.label, {_DOT} AS sim, b.vec_id AS ref FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
t AS (SELECT query, own, label, avg(sim) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query, label ORDER BY sim DESC, ref) AS rn FROM s) WHERE rn <= 3 GROUP BY 1, 2, 3),
o AS (SELECT query, label AS other, score AS other_score, row_number() OVER (PARTITION BY query ORDER BY score DESC, label) AS rn FROM t WHERE label <> own),
c AS (SELECT t.query, own, score AS own_score, other, other_score FROM t JOIN o ON o.query = t.query AND rn = 1 WHERE t.label = t.own)
"""


@query(_CLASS + "SELECT query, own, round(own_score, 4) AS own_score, other, round(other_score, 4) AS other_score FROM c WHERE other_score - own_score >= 0.03 AND other_score >= 0.25")
def class_top3_conflict(spark, sf_dir):
    c = S.conflicts(S.own_and_other(M.class_similarity(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")), 0.03, 0.25)
    return c.select("query", "own", F.round("own_score", 4).alias("own_score"), "other", F.round("other_score", 4).alias("other_score"))


@query(_CLASS + "SELECT query, own, other FROM c WHERE abs(own_score - other_score) <= 0.03")
def ambiguity_band(spark, sf_dir):
    return S.ambiguous(S.own_and_other(M.class_similarity(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label"))).select("query", "own", "other")


_BOX = "b AS (SELECT vec_id, label, abs(CAST(embedding[1] AS DOUBLE)) AS x, abs(CAST(embedding[2] AS DOUBLE)) AS y, 0.2 + abs(CAST(embedding[3] AS DOUBLE)) AS w, 0.2 + abs(CAST(embedding[4] AS DOUBLE)) AS h FROM embeddings)"


def _boxes(spark, sf_dir):
    e = [F.abs(F.get("embedding", F.lit(i)).cast("double")) for i in range(4)]
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", e[0].alias("x"), e[1].alias("y"), (0.2 + e[2]).alias("w"), (0.2 + e[3]).alias("h"))


@query(
    f"""
WITH {_BOX}, p AS (SELECT p.label, p.vec_id AS a, q.vec_id AS b, p.w * p.h + q.w * q.h AS both_areas,
  greatest(0, least(p.x + p.w, q.x + q.w) - greatest(p.x, q.x)) * greatest(0, least(p.y + p.h, q.y + q.h) - greatest(p.y, q.y)) AS i FROM b p JOIN b q ON p.label = q.label AND p.vec_id < q.vec_id)
SELECT label, a, b, round(i / (both_areas - i), 4) AS iou FROM p WHERE i / (both_areas - i) > 0.6"""
)
def iou_pairs(spark, sf_dir):
    return M.box_pairs(_boxes(spark, sf_dir), "vec_id", "label", ("x", "y", "w", "h"), 0.6).withColumn("iou", F.round("iou", 4))


@query(
    f"""
WITH RECURSIVE {_BOX}, o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY w DESC, vec_id) AS rn FROM b),
k(label, rn, kept) AS (SELECT label, CAST(0 AS BIGINT), CAST([] AS STRUCT(i BIGINT, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE)[]) FROM (SELECT DISTINCT label FROM o)
  UNION ALL SELECT k.label, o.rn, CASE WHEN len(list_filter(k.kept, lambda z: greatest(0, least(z.x + z.w, o.x + o.w) - greatest(z.x, o.x)) * greatest(0, least(z.y + z.h, o.y + o.h) - greatest(z.y, o.y))
    > 0.6 * (z.w * z.h + o.w * o.h - greatest(0, least(z.x + z.w, o.x + o.w) - greatest(z.x, o.x)) * greatest(0, least(z.y + z.h, o.y + o.h) - greatest(z.y, o.y))))) = 0
    THEN list_append(k.kept, {{'i': o.vec_id, 'x': o.x, 'y': o.y, 'w': o.w, 'h': o.h}}) ELSE k.kept END FROM k JOIN o ON o.label = k.label AND o.rn = k.rn + 1),
f AS (SELECT label, arg_max(kept, rn) AS kept FROM k GROUP BY 1)
SELECT label, unnest(list_transform(kept, lambda z: z.i)) AS vec_id FROM f"""
)
def box_suppression(spark, sf_dir):
    return M.suppress(_boxes(spark, sf_dir), "vec_id", "label", ("x", "y", "w", "h"), "w", 0.6)


@query(
    """
WITH st AS (SELECT avg(l_discount * 100) AS m, sqrt(greatest(avg(l_discount * 100 * l_discount * 100) - avg(l_discount * 100) * avg(l_discount * 100), 0)) AS sd FROM lineitem),
sc AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (CASE WHEN l_quantity < 10 THEN -6.0 WHEN l_quantity < 20 THEN 0.0 ELSE 2.0 END) + 2 * tanh((l_discount * 100 - m) / (2 * sd))
  + ln(greatest(l_partkey * l_suppkey, 1) + 1) * 0.4 + CASE WHEN l_returnflag = 'R' THEN 1.5 ELSE 0 END AS score FROM lineitem, st)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round_even(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY round_even(score, 4) DESC, l_partkey DESC, l_suppkey DESC, l_linenumber DESC) AS rn FROM sc) WHERE rn = 1"""
)
def asset_score_pick(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", (F.col("l_discount") * 100).alias("aes"))
    v = F.col("aes")
    st = lines.agg(F.avg(v).alias("m"), F.sqrt(F.greatest(F.avg(v * v) - F.avg(v) * F.avg(v), F.lit(0.0))).alias("sd"))
    label = F.when(F.col("l_quantity") < 10, "blurry").when(F.col("l_quantity") < 20, "soft").otherwise("sharp")
    s = lines.crossJoin(F.broadcast(st)).withColumn("score", X.asset_score(label, "aes", "m", "sd", "l_partkey", "l_suppkey", F.col("l_returnflag") == "R"))
    best = top(s, "l_orderkey", [F.col(c).desc() for c in ("score", "l_partkey", "l_suppkey", "l_linenumber")])
    return best.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "score")


def _number(*parts: str) -> str:
    return f"CAST('0x' || substr(sha256(concat_ws(chr(31), {', '.join(parts)})), 1, 15) AS BIGINT)"


@query(
    f"""
WITH c AS (SELECT label AS l, count(*) AS n, count(*) * (count(*) - 1) // 2 AS pairs FROM embeddings GROUP BY 1 HAVING count(*) >= 5),
p AS (SELECT vec_id AS k, label AS l, row_number() OVER (PARTITION BY label ORDER BY sha256('7' || chr(31) || vec_id), vec_id) - 1 AS p FROM embeddings JOIN c ON l = label),
q AS (SELECT l, CASE WHEN pairs <= 1600 THEN i ELSE {_number("'7'", "'inside'", "l", "i")} % pairs END AS number, CASE WHEN pairs <= 1600 THEN {_number("'7'", "'order'", "l", "i")} ELSE i END AS o FROM c, range(1600) t(i) WHERE pairs > 1600 OR i < pairs),
r AS (SELECT l, number, row_number() OVER (PARTITION BY l ORDER BY o, number) AS rn FROM (SELECT l, number, min(o) AS o FROM q GROUP BY 1, 2)),
s AS (SELECT a.k AS a, b.k AS b FROM p a JOIN p b ON a.l = b.l AND a.p < b.p JOIN r ON r.l = a.l AND r.number = b.p * (b.p - 1) // 2 + a.p AND rn <= 400),
o AS (SELECT l, n, row_number() OVER (ORDER BY l) - 1 AS c, count(*) OVER () AS m FROM c), t AS (SELECT count(*) AS n FROM s),
d AS (SELECT d, {_number("'7'", "'first'", "d")} % m AS ca, {_number("'7'", "'second'", "d")} % (m - 1) AS cb FROM (SELECT unnest(range(4 * n)) AS d, (SELECT max(m) FROM o) AS m FROM t)),
e AS (SELECT d, x.l AS la, {_number("'7'", "'a'", "d")} % x.n AS pa, y.l AS lb, {_number("'7'", "'b'", "d")} % y.n AS pb FROM d JOIN o x ON x.c = ca JOIN o y ON y.c = CASE WHEN cb >= ca THEN cb + 1 ELSE cb END),
f AS (SELECT least(x.k, y.k) AS a, greatest(x.k, y.k) AS b, min(d) AS d FROM e JOIN p x ON x.l = la AND x.p = pa JOIN p y ON y.l = lb AND y.p = pb GROUP BY 1, 2)
SELECT least(a, b) AS a, greatest(a, b) AS b, true AS same FROM s UNION ALL SELECT a, b, false FROM (SELECT a, b, row_number() OVER (ORDER BY d) AS rn FROM f) WHERE rn <= (SELECT n FROM t)"""
)
def calibration_pairs(spark, sf_dir):
    """Seeded pairs inside each class, up to 400, and as many of different classes; all pairs are equally likely."""
    return S.sample_pairs(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id", "label")


@query("SELECT n_regionkey AS source, n_nationkey AS target FROM nation WHERE n_regionkey IN (1, 3)")
def relation_hop(spark, sf_dir):
    edges = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("source"), F.col("n_nationkey").alias("target"), F.lit("parent_of").alias("type"))
    return G.one_hop(edges, "parent_of", spark.createDataFrame([(1,), (3,)], "node int"))
