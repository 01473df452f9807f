"""A training-corpus pipeline of four stages over ``documents``.

Each stage gets the session, what its predecessor kept, and the folder of the tables. All but the last
return the columns of documents, with the rows' own values whatever further columns there are.

Edge cases. Null and empty texts: the classifier scores them like any other, near-dedup keeps one for each id (all of null
id), mixing keeps them with their cell's probability, encoding gives no tokens. Null ids: documents of their own, sampled alike.
Repeated ids: rows that are near copies are one document, others are decided each for itself. Empty tables give empty results. Texts of any
length are read whole. No stage's outcome depends on the order of rows or ties in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import bpe, mixing, neardup, quality
from quillspark.llm.common import discard, discard_since, materialise, scratch_mark, table
from quillspark.llm.queries import tokenizer_path
from quillspark.session import ship


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    ship(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    ship(spark)
    return neardup.keep_one(docs, k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow tempered shares of source, language and topic."""
    ship(spark)
    return mixing.sample(docs, budget=0.5, powers=(0.7, 0.7, 0.7))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token counts and digests of ids and decoded text."""
    ship(spark)
    return bpe.encode_decode(docs, tokenizer_path("word_bpe_49k.json"), min_share=2e-5)


STAGES = [
    ("quality classifier", classify_quality),
    ("minhash near-dedup", drop_near_duplicates),
    ("mixing to target weights", mix_sources),
    ("bpe encoding and decoding", encode_tokens),
]

#: No SQL: the first stage is a trained model. The stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        mark, before = scratch_mark(), docs
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
        discard_since(spark, mark, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
