"""The corpus pipeline: quality rules, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of documents; the last returns packing's rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import cut, shared_dir
from tessella.llm.near_dedup import NO_ID, near_duplicates
from tessella.llm.packing import pack
from tessella.llm.quality import judge
from tessella.llm.substring_dedup import dedup_substrings


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the rules and whose source does."""
    return judge(docs, keep_text=True).filter("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group the document with the smallest id; of rows of that id, or without one, that are near
    copies, the one whose text has the smallest hash; of repeated rows, one."""
    found = near_duplicates(docs)
    ident = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(NO_ID)).alias("__id")
    stay = found.groupBy("group").agg(F.min(F.struct(ident("doc_id"), "text_hash")).alias("x")).select("x.__id", F.col("x.text_hash").alias("__hash"))
    hashed = docs.withColumns({"__id": ident("doc_id"), "__hash": F.xxhash64(F.coalesce("text", F.lit("")))})
    kept = hashed.join(cut(stay, "pipeline-stay"), ["__id", "__hash"], "left_semi")
    again = docs.groupBy(ident("doc_id")).count().filter("count > 1").select("__id")
    if again.isEmpty():
        return kept.select(*docs.columns)
    once = kept.join(again, "__id", "left_semi").dropDuplicates(["__id", "__hash"])
    return kept.join(again, "__id", "left_anti").unionByName(once).select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that repeat; a document of which nothing is left goes."""
    out = dedup_substrings(docs, with_text=True)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return out.filter("n_removed = 0 or n_removed < n_words").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("packing", packing),
]

#: SQL has no suffix automata, signatures or dynamic programming; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
