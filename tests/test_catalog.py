"""Every query with SQL gives DuckDB's rows on the smallest tables; the others give some rows."""

import math
import os

import duckdb
import pytest

from tessella.plans import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    r = duck.execute(SQL[name])
    at = [[x[0] for x in r.description].index(c) for c in columns]
    assert len(r.description) == len(columns)
    assert got == sorted(repr([plain(x[i]) for i in at]) for x in r.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, FOLDER).count() >= 0


def test_mmr_sim_all_takes_all_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    pairs = QUERIES["mmr_sim_all"](spark, FOLDER)
    ids = {x for r in pairs.select("a", "b").collect() for x in r}
    assert ids == {r["doc_id"] for r in docs.select("doc_id").collect()} and max(ids) >= 120


def test_mutations_over_whole_tables(spark):
    """All lines stay, and accounts of all ids take part."""
    assert QUERIES["reassign_all"](spark, FOLDER).count() == spark.read.parquet(f"{FOLDER}/lineitem.parquet").count()
    c = spark.read.parquet(f"{FOLDER}/customer.parquet")
    any_ = c.filter("c_mktsegment <> 'BUILDING' or c_nationkey % 3 <> 0").count()
    for name in ("upsert_replace_all", "upsert_ignore_all", "upsert_update_all"):
        assert QUERIES[name](spark, FOLDER).count() == any_
    old = c.filter("c_mktsegment <> 'BUILDING'").count()
    assert QUERIES["keyed_update_all"](spark, FOLDER).count() == old > QUERIES["delete_in_all"](spark, FOLDER).count() > 0
