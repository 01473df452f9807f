"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import bpe, chat, licenses, media, mixing, neardup, oracle, quality, vectors, warc
from .common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.count_tokens(docs, tokenizer_path("byte_bpe_50k.json"), limit=512, keep=["doc_id"])


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op4_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), budget=0.5, powers=(0.7, 0.7, 0.7), keep=["doc_id", "source", "lang"])


def op6_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(table(spark, sf_dir, "pages"), min_bytes=0, with_payload=False).drop("payload")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), keep=["doc_id"]).drop("matches")


def op8_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = chat.render_perspectives(table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda x: F.concat_ws("-", x["first"].cast("string"), x["end"].cast("string"))), ",")
    return views.select("conv_id", "perspective", "run", "part", "n_rows", "n_messages", "n_trained", F.length("rendered").cast("long").alias("n_chars"), F.sha2("rendered", 256).alias("rendered_sha256"), mask.alias("mask"))


def op9_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.encode_decode(docs, tokenizer_path("word_bpe_49k.json"), min_share=2e-5, keep=["doc_id"])


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_token_counts": op2_token_counts,
    "op3_media_columns": op3_media_columns,
    "op4_quality_scores": op4_quality_scores,
    "op5_mixing": op5_mixing,
    "op6_warc_roundtrip": op6_warc_roundtrip,
    "op7_license_scan": op7_license_scan,
    "op8_chat_perspectives": op8_chat_perspectives,
    "op9_embedding_near_duplicates": op9_embedding_near_duplicates,
    "op10_bpe_roundtrip": op10_bpe_roundtrip,
}

QUERIES = {name: _shipped(query) for name, query in _QUERIES.items()}

ORACLE_SQL: dict[str, str] = {
    "op1_near_duplicates": oracle.NEAR_DUPLICATES,
    "op6_warc_roundtrip": oracle.WARC,
    "op7_license_scan": oracle.LICENSES,
    "op8_chat_perspectives": oracle.CHATS,
    "op9_embedding_near_duplicates": oracle.VECTORS,
}
