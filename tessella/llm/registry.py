"""The queries of this subpackage, one per operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, ship


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import fingerprint_edits

    return fingerprint_edits(read(spark, sf_dir, "documents", "doc_id", "text"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"), shingle=4, percent=80).drop("text_hash", "group")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import filter_urls

    return filter_urls(read(spark, sf_dir, "pages", "page_id", "url")).drop("url")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_decode

    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import dedup_substrings

    return dedup_substrings(read(spark, sf_dir, "documents", "doc_id", "text"), window=35)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(read(spark, sf_dir, "documents", "doc_id", "text"))


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .records import read_records, write_records

    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return read_records(spark, *write_records(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(read(spark, sf_dir, "documents", "doc_id", "text", "source")).drop("source", "shrunk_rate")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    out = shard(read(spark, sf_dir, "documents", "doc_id", "text"), shards=8)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import score_documents

    return score_documents(read(spark, sf_dir, "documents", "doc_id", "text"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import shared_heads_trie

    return shared_heads_trie(read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .source_audit import audit_sources

    return audit_sources(read(spark, sf_dir, "documents", "text", "lang", "source"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(read(spark, sf_dir, "documents", "doc_id", "text", "source")).drop("source")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    from .oracle import SQL

    return dict(SQL)
