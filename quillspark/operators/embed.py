"""Embedding as an operator: a vector column, with a cache that sends each different text once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.embedding import Provider, check_vectors
from ..session import hadoop_path

VECTOR = T.ArrayType(T.FloatType())
CACHE = T.StructType([T.StructField("key", T.StringType()), T.StructField("embedding", VECTOR)])


def embed(rows: DataFrame, provider: Provider, text_col: str = "text", batch: int = 256, name: str = "embedding") -> DataFrame:
    """Add the vector of a text column, one provider call per ``batch`` texts; length and count are checked."""
    kept = [c for c in rows.columns if c.lower() != name.lower()]
    at = kept.index(text_col)
    schema = T.StructType([rows.schema[c] for c in kept] + [T.StructField(name, VECTOR)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for lo in range(0, part.num_rows, batch):
                own = part.slice(lo, batch)
                texts = [t or "" for t in own.column(at).to_pylist()]
                vectors = check_vectors(provider.embed_batch(texts), len(texts), provider.size)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(list(vectors), pa.list_(pa.float32()))], names=[*kept, name])

    return rows.select(kept).mapInArrow(run, schema)


def cache_key(namespace: str, text_col: str = "text") -> F.Column:
    return F.sha2(F.concat(F.lit(namespace), F.lit("\u0000"), F.coalesce(F.col(text_col), F.lit(""))), 256)


def embed_cached(rows: DataFrame, provider: Provider, path: str, text_col: str = "text") -> tuple[DataFrame, dict[str, int]]:
    """Rows with vectors, and how many texts were sent and how many the cache or the batch itself spared."""
    spark = rows.sparkSession
    keyed = rows.withColumn("__key", cache_key(provider.name, text_col))
    fs, where = hadoop_path(spark, path)
    cache = spark.read.schema(CACHE).parquet(path) if fs.exists(where) else spark.createDataFrame([], CACHE)
    wanted = keyed.groupBy(F.col("__key").alias("key")).agg(F.any_value(text_col).alias("text"), F.count("*").alias("n"))
    missing = wanted.join(cache.select("key"), "key", "left_anti")
    sent = missing.count()
    if sent:
        embed(missing.select("key", "text"), provider).select("key", "embedding").write.mode("append").parquet(path)
        cache = spark.read.schema(CACHE).parquet(path)
    total = keyed.count()
    out = keyed.join(cache.withColumnRenamed("key", "__key"), "__key").drop("__key")
    return out, {"misses": sent, "hits": total - sent}
