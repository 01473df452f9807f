"""The vector store: immutable Parquet snapshots under one folder, and a marker file for each finished one.

A snapshot is a list of parts and of dropped records: a change writes what it adds and the ids of what it drops, then a marker that
names these and the parts before, so readers never see half a change and a lost executor only
repeats its task; of two writers of one number the second fails. The last snapshots stay for readers that have begun.
"""

from __future__ import annotations

import hashlib
import json
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..session import hadoop_path, in_blocks, read_bytes, write_bytes

_STRINGS = "chunk_id document_id tenant_id filename previous_version source_type mime_type file_hash title author date department category encoding chunk_strategy parent_id context_id context_text section_path text".split()
_INTS = "page version page_count row_count column_count chunk_start chunk_end chunk_level".split()
SCHEMA = T.StructType([
    *(T.StructField(n, T.StringType()) for n in _STRINGS), *(T.StructField(n, T.IntegerType()) for n in _INTS), T.StructField("file_size", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("extra", T.StringType()),
])
#: What the chunker records; the rest describes the document.
CHUNK_KEYS = ("chunk_strategy", "chunk_start", "chunk_end", "chunk_level", "parent_id", "context_id", "context_text", "section_path")
KEEP = 2
MARKER = "CURRENT-"
#: Parts and lists of dropped records of a snapshot, beyond which it is written together.
COMPACT = 24
LEGACY = ("fixed", {"chunk_size": 500, "overlap": 50})


def store_name(strategy: str, params: dict[str, Any]) -> str:
    """One store per strategy and parameters."""
    if (strategy, params) == LEGACY:
        return "vector_store"
    return f"vector_store.{strategy}-{hashlib.sha256(json.dumps(params, sort_keys=True).encode()).hexdigest()[:8]}"


def check_filters(filters: dict[str, Any] | None) -> dict[str, Any]:
    if filters is not None and not isinstance(filters, dict):
        raise TypeError("filters must be a mapping of field to value")
    return filters or {}


def matches(filters: dict[str, Any] | None, schema: T.StructType) -> Column:
    """All fields equal their values; a missing field or another type never matches."""
    test = F.lit(True)
    for key, value in check_filters(filters).items():
        if key not in schema.names:
            return F.lit(False)
        kind = schema[key].dataType
        numeric = isinstance(kind, T.NumericType)
        alike = isinstance(value, (int, float)) and not isinstance(value, bool) if numeric else isinstance(value, bool) if isinstance(kind, T.BooleanType) else isinstance(value, str)
        test = test & (F.col(f"`{key}`") == F.lit(value)) if alike else F.lit(False)
    return test


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _numbers(self) -> list[int]:
        """The finished snapshots: the numbers of the CURRENT-<n> markers."""
        fs, where = hadoop_path(self.spark, self.path)
        if not fs.exists(where):
            return []
        _, markers = hadoop_path(self.spark, f"{self.path}/{MARKER}*")
        return sorted(int(f.getPath().getName().removeprefix(MARKER)) for f in fs.globStatus(markers) or [])

    def _state(self, number: int) -> dict[str, list[int]]:
        return json.loads(read_bytes(self.spark, f"{self.path}/{MARKER}{number}"))

    def rows(self) -> DataFrame:
        """All records of the current snapshot; an empty frame before the first."""
        numbers = self._numbers()
        if not numbers:
            return self.spark.createDataFrame([], SCHEMA)
        state = self._state(numbers[-1])
        parts = [self.spark.read.schema(SCHEMA).parquet(f"{self.path}/v={n}").withColumn("__n", F.lit(n)) for n in state["parts"]]
        found = reduce(DataFrame.unionByName, parts)
        if state["gone"]:
            gone = [self.spark.read.schema("chunk_id string").parquet(f"{self.path}/gone={n}").withColumn("__gone", F.lit(n)) for n in state["gone"]]
            last = reduce(DataFrame.unionByName, gone).groupBy("chunk_id").agg(F.max("__gone").alias("__gone"))
            found = found.join(last, "chunk_id", "left").filter("__gone IS NULL OR __n >= __gone")
        return found.select(SCHEMA.names)

    def count(self) -> int:
        return self.rows().count()

    def commit(self, rows: DataFrame) -> int:
        """Write a whole snapshot and make it current."""
        return self._finish(rows, None, whole=True)

    def apply(self, added: DataFrame | None = None, gone: DataFrame | None = None) -> int:
        """Make a snapshot of the current one without the records of ``gone`` (chunk_id) and with ``added``; only these are written.

        After ``COMPACT`` such changes the records are written together again.
        """
        number = self._finish(added, gone, whole=False)
        state = self._state(number)
        return self.commit(self.rows()) if len(state["parts"]) + len(state["gone"]) > COMPACT else number

    def _finish(self, rows: DataFrame | None, gone: DataFrame | None, whole: bool) -> int:
        numbers = self._numbers()
        number = numbers[-1] + 1 if numbers else 1
        state = {"parts": [], "gone": []} if whole or not numbers else self._state(numbers[-1])
        if rows is not None:
            _like_store(rows).write.mode("overwrite").parquet(f"{self.path}/v={number}")
            state["parts"].append(number)
        if gone is not None:
            gone.select("chunk_id").distinct().write.mode("overwrite").parquet(f"{self.path}/gone={number}")
            state["gone"].append(number)
        # The snapshot is whole before its marker exists, and older markers stay: a reader or a crash at any moment finds the last one.
        write_bytes(self.spark, f"{self.path}/{MARKER}{number}", json.dumps(state).encode(), overwrite=False)
        fs, where = hadoop_path(self.spark, self.path)
        kept = [n for n in (*numbers, number) if n > number - KEEP]
        named = {f"{MARKER}{n}" for n in kept} | {f"{kind}={n}" for k in kept for kind, key in (("v", "parts"), ("gone", "gone")) for n in self._state(k)[key]}
        for found in fs.listStatus(where):
            if (name := found.getPath().getName()) not in named and name.startswith((MARKER, "v=", "gone=")):
                fs.delete(found.getPath(), True)
        return number

    def add(self, chunks: DataFrame) -> int:
        """Append records with embeddings of the store's length; returns how many."""
        own = self.rows().select(F.size("embedding").alias("n")).limit(1)
        sizes = [r[0] for r in chunks.select(F.size("embedding").alias("n")).union(own).distinct().limit(2).collect()]
        if len(sizes) > 1:
            raise ValueError(f"embeddings of different length: {sorted(sizes)}")
        bad = chunks.filter(F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("embedding", lambda x: x != 0))
        if not bad.isEmpty():
            raise ValueError("embeddings must be finite and not zero")
        n = chunks.count()
        if n:
            self.apply(chunks)
        return n

    def delete(self, ids: DataFrame) -> int:
        """Drop the records of these chunk ids; unknown ids don't matter."""
        found = self.rows().join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id")
        n = found.count()
        if n:
            self.apply(gone=found)
        return n

    def update(self, chunk_id: str, **fields: Any) -> None:
        """Change one record; KeyError unless there is exactly one."""
        this = self.rows().filter(F.col("chunk_id") == chunk_id)
        if this.limit(2).count() != 1:
            raise KeyError(chunk_id)
        self.apply(this.withColumns({k: F.lit(v).cast(SCHEMA[k].dataType) for k, v in fields.items()}), this.select("chunk_id"))

    def search(self, query: list[float], k: int = 5, filters: dict[str, Any] | None = None) -> DataFrame:
        rows = self.rows()
        if k <= 0:
            raise ValueError("k must be greater than zero")
        if rows.isEmpty():
            raise ValueError("the store is empty")
        return top_k(rows, query, k, filters)

    def documents(self, tenant_id: str) -> DataFrame:
        """The document ids a tenant has stored."""
        own = self.rows().filter(F.coalesce("tenant_id", F.lit(tenant_id)) == tenant_id)
        return own.select(X.legacy_document_id(F.col("document_id"), F.col("chunk_id")).alias("document_id")).distinct()


def _like_store(rows: DataFrame) -> DataFrame:
    return rows.select([(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMA])


def top_k(rows: DataFrame, query: list[float], k: int, filters: dict[str, Any] | None = None, id_col: str = "chunk_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest rows by cosine, after the filter; ties by id. ``rank`` counts from 1."""
    vector = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.filter(matches(filters, rows.schema)).withColumn("score", X.cosine(F.col(vec_col), vector)).filter("score IS NOT NULL")
    best = scored.orderBy(F.desc("score"), id_col).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)))  # k rows


def top_k_batch(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "chunk_id", vec_col: str = "embedding", blocks: int = 16, size: int = 10_000) -> DataFrame:
    """The k nearest rows of every query (query_id, query): a stated query set against all rows, in blocks.

    Queries go out in blocks of ``size``, one broadcast and one pass over the rows for each. Each task multiplies
    whole batches and keeps its own best k of each query, so k rows per query and task are shuffled.
    """
    import numpy as np
    import pyarrow as pa

    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField(id_col, rows.schema[id_col].dataType), T.StructField("score", T.DoubleType())])

    def against(held: list) -> DataFrame:
        matrix = np.array([r.query for r in held], np.float64)
        matrix = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
        shared = rows.sparkSession.sparkContext.broadcast(([r.query_id for r in held], matrix))

        def run(batches):
            names, matrix = shared.value
            for batch in batches:
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                flat /= np.linalg.norm(flat, axis=1, keepdims=True)
                ids = batch.column(0)
                for lo in range(0, len(names), 256):
                    scores = np.round(matrix[lo : lo + 256] @ flat.T, 12)  # equal vectors tie, wherever they stand in a batch
                    for at, row in enumerate(scores):
                        cut = np.partition(row, -k)[-k] if len(row) > k else -np.inf
                        take = np.flatnonzero(row >= cut)
                        yield pa.RecordBatch.from_arrays([pa.array([names[lo + at]] * len(take)), ids.take(pa.array(take)), pa.array(row[take])], names=schema.names)

        return rows.select(id_col, vec_col).filter(F.size(vec_col) == matrix.shape[1]).mapInArrow(run, schema)

    parts = [against(held) for held in in_blocks(queries.select("query_id", "query"), size)]
    best = reduce(DataFrame.unionByName, parts) if parts else rows.sparkSession.createDataFrame([], schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
