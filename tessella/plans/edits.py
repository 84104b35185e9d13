"""Edits over whole tables: people, crops, keyed updates, steps that miss, samples of the commonest tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import incremental as I
from ..operators import mutations as C
from ..operators import people as P
from ..operators import relational as R
from ..sources import tables as T
from ..sources.tables import table
from .catalog import query

_DOT = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query(
    """
WITH c AS (SELECT o_custkey, o_orderstatus, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
SELECT c_custkey, coalesce(o_orderstatus, c_mktsegment) AS c_mktsegment, coalesce(o_totalprice, c_acctbal) AS c_acctbal FROM customer LEFT JOIN c ON o_custkey = c_custkey AND rn = 1"""
)
def update_by_last_order(spark, sf_dir):
    """Customers take values of their orders, of which the last counts: a keyed update by a delta with repeated keys."""
    changes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("c_mktsegment"), F.col("o_totalprice").alias("c_acctbal"), "o_orderdate", "o_orderkey")
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return C.update_from(old, changes, ["c_custkey"], ["c_mktsegment", "c_acctbal"], [F.col("o_orderdate"), F.col("o_orderkey")])


@query(
    """
SELECT doc_id, 'length' AS step, CASE WHEN n_chars % 3 = 0 THEN 'missed' ELSE 'done' END AS what FROM documents
UNION ALL SELECT doc_id, 'lang', CASE WHEN lang = 'de' THEN 'missed' ELSE 'done' END FROM documents WHERE n_chars >= 200"""
)
def steps_with_misses(spark, sf_dir):
    """Two steps over all documents, one of them gated, that each miss some; a second run finds nothing to do."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    steps = [I.Step("length", lambda x: x.withColumn("missed", F.col("n_chars") % 3 == 0)), I.Step("lang", lambda x: x.withColumn("missed", F.col("lang") == "de"), gate=F.col("n_chars") >= 200)]
    none = spark.createDataFrame([], "doc_id long, step string, version string")
    state, misses = none, none.drop("version")
    for _ in range(2):
        state, misses, _out, report = I.run_steps(d, state, misses, steps, "doc_id")
    if report.errors or any(report.done.values()):
        raise RuntimeError(f"the second run did {report.done}, {report.errors}")
    return state.select("doc_id", "step", F.lit("done").alias("what")).unionByName(misses.select("doc_id", "step", F.lit("missed").alias("what")))


@query(
    """
WITH t AS (SELECT l_suppkey, row_number() OVER (ORDER BY count(*) DESC, l_suppkey) AS place FROM lineitem GROUP BY 1),
r AS (SELECT l_orderkey, l_linenumber, l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY sha256('42' || chr(31) || l_orderkey || chr(31) || l_linenumber), l_orderkey, l_linenumber) AS rn FROM lineitem JOIN t USING (l_suppkey) WHERE place <= 12)
SELECT l_orderkey, l_linenumber, l_suppkey FROM r WHERE rn <= 20"""
)
def commonest_tags_sample(spark, sf_dir):
    """Twenty seeded rows of each of the twelve commonest tags."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return R.stratified_top(lines, "l_suppkey", 12, 20, ["l_orderkey", "l_linenumber"])


_FACES = "f AS (SELECT vec_id AS face_id, CASE WHEN vec_id % 4 > 0 THEN 'p' || label END AS person_id, CASE WHEN vec_id % 5 = 0 THEN 1 ELSE 0 END AS person_locked, vec_id % 97 AS cluster_id, false AS ignored, embedding FROM embeddings)"


def _faces(spark, sf_dir):
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        v.alias("face_id"), F.when(v % 4 > 0, F.concat(F.lit("p"), F.col("label").cast("string"))).alias("person_id"), F.when(v % 5 == 0, 1).otherwise(0).alias("person_locked"), (v % 97).alias("cluster_id"), F.lit(False).alias("ignored"), "embedding"
    )


@query(
    f"""
WITH {_FACES}, a AS (SELECT face_id, CASE WHEN face_id % 10 = 3 THEN CASE WHEN face_id % 20 = 3 THEN 'p0' END ELSE person_id END AS person_id, CASE WHEN face_id % 10 = 3 THEN 1 ELSE person_locked END AS person_locked, cluster_id, ignored FROM f),
c AS (SELECT face_id, person_locked, cluster_id, CASE WHEN person_id IS NULL AND person_locked = 0 AND cluster_id % 8 = 1 THEN 'p1' ELSE person_id END AS person_id, CASE WHEN person_id IS NULL AND person_locked = 0 AND cluster_id % 8 = 2 THEN true ELSE ignored END AS ignored FROM a)
SELECT face_id, CASE WHEN person_id = 'p2' THEN NULL ELSE person_id END AS person_id, person_locked, cluster_id, ignored FROM c"""
)
def people_edits(spark, sf_dir):
    """Faces given to a person or nobody, whole clusters given or ignored, and a person taken away."""
    f = _faces(spark, sf_dir).drop("embedding")
    people = f.filter("person_id is not null").select("person_id").distinct().select("person_id", F.lit("?").alias("display_name"), F.lit(None).cast("bigint").alias("avatar"))
    given = f.filter("face_id % 10 = 3").select("face_id", F.when(F.col("face_id") % 20 == 3, "p0").alias("person_id"))
    f = P.assign_faces(f, given, people)
    of = lambda k, person, ignored: f.filter(f"cluster_id % 8 = {k}").select("cluster_id").distinct().select("cluster_id", F.lit(person).cast("string").alias("person_id"), F.lit(ignored).cast("boolean").alias("ignored"))
    f = P.assign_clusters(f, of(1, "p1", None).unionByName(of(2, None, True)))
    return P.edit_people(people, f, gone=people.filter("person_id = 'p2'"))[1].select("face_id", "person_id", "person_locked", "cluster_id", "ignored")


@query(
    f"""
WITH {_FACES}, s AS (SELECT a.face_id, b.person_id, round({_DOT}, 12) AS sim, row_number() OVER (PARTITION BY a.face_id ORDER BY round({_DOT}, 12) DESC, b.face_id) AS near FROM f a JOIN f b ON a.person_id IS NULL AND b.person_id IS NOT NULL),
g AS (SELECT face_id, person_id, max(sim) AS sim FROM s WHERE near <= 20 GROUP BY 1, 2)
SELECT face_id, person_id, round(sim, 4) AS sim, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY face_id ORDER BY sim DESC, person_id) AS rank FROM g) WHERE rank <= 3"""
)
def people_suggestions(spark, sf_dir):
    return P.suggestions(_faces(spark, sf_dir), "embedding").select("face_id", "person_id", F.round("sim", 4).alias("sim"), "rank")


@query(
    """
SELECT doc_id AS asset_id, CAST(CASE WHEN k THEN x ELSE 0.0 END AS DOUBLE) AS x, CAST(CASE WHEN k THEN 0.25 ELSE 0.0 END AS DOUBLE) AS y, CAST(CASE WHEN k THEN 0.5 ELSE 1.0 END AS DOUBLE) AS w, CAST(CASE WHEN k THEN 0.5 ELSE 1.0 END AS DOUBLE) AS h, k AS cropped
FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 0.5 ELSE 0.125 END AS x, (doc_id % 2 = 0 OR doc_id % 3 = 1) AND doc_id % 7 > 0 AS k FROM documents)"""
)
def crop_edits(spark, sf_dir):
    """Crops of even ids are there; every third one is set anew, every seventh cleared; then all assets with theirs."""
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("asset_id"))
    crop = lambda df, x: df.select("asset_id", F.lit(x).alias("x"), F.lit(0.25).alias("y"), F.lit(0.5).alias("w"), F.lit(0.5).alias("h"))
    crops = P.edit_crops(crop(ids.filter("asset_id % 2 = 0"), 0.125), crop(ids.filter("asset_id % 3 = 1"), 0.5), ids.filter("asset_id % 7 = 0"))
    return P.crop_map(ids, crops)


@query(
    """
SELECT c_custkey AS asset_id, CASE WHEN c_custkey % 5 > 0 THEN n_name ELSE '' END AS city, r_name AS province, CAST(CASE WHEN c_custkey % 5 > 0 THEN n_nationkey * 1.5 ELSE m END AS DOUBLE) AS lat
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey JOIN (SELECT n_regionkey AS k, min(n_nationkey) * 1.5 AS m FROM nation GROUP BY 1) ON k = r_regionkey"""
)
def city_places(spark, sf_dir):
    """Customers as photos of cities (nations) in provinces (regions); every fifth only knows its province."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    cities = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("province"), F.col("n_name").alias("city"), (F.col("n_nationkey") * 1.5).alias("lat"), F.lit(0.0).alias("lon"))
    c = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    geo = c.select(F.col("c_custkey").alias("asset_id"), F.col("r_name").alias("province"), F.when(F.col("c_custkey") % 5 > 0, F.col("n_name")).otherwise("").alias("city"))
    return T.placed(geo, cities).select("asset_id", "city", "province", "lat")


@query("SELECT doc_id, to_json({'id': doc_id, 'lang': lang, 'sizes': [n_chars, length(source)], 'none': CASE WHEN doc_id % 2 = 0 THEN source END}) AS line FROM documents")
def json_dumps(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", X.json_text(F.col("doc_id").alias("id"), "lang", F.array(F.col("n_chars"), F.length("source").cast("bigint")).alias("sizes"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("none")).alias("line"))


@query(
    r"""
WITH r AS (SELECT conv_id, turn, i, trim(line, ' ') AS t, ((conv_id * 7 + turn * 3 + i * 11) % 20) / 20 AS c FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM conversations))
SELECT c.conv_id, c.turn, CAST(count(r.t) AS INTEGER) AS n_regions, CASE WHEN count(r.t) > 0 THEN round_even(avg(r.c), 3) ELSE 0.0 END AS mean_conf FROM conversations c
LEFT JOIN r ON r.conv_id = c.conv_id AND r.turn = c.turn AND r.t <> '' AND r.c >= 0.55 GROUP BY 1, 2"""
)
def recognised_lines(spark, sf_dir):
    """Lines of turns as recognised regions, of which those below the least confidence don't count."""
    c = table(spark, sf_dir, "conversations")
    conf = lambda i: F.pmod(F.col("conv_id") * 7 + F.col("turn") * 3 + i * 11, F.lit(20)) / 20
    regions = F.transform(F.split("text", "\n"), lambda t, i: F.struct(t.alias("text"), conf(i).alias("confidence")))
    return c.select("conv_id", "turn", X.text_regions(regions).alias("r")).select("conv_id", "turn", "r.n_regions", "r.mean_conf")
