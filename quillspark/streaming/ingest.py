"""Streaming ingestion: files that arrive in an append-only folder are indexed batch by batch.

The store's snapshot is the state. The file source remembers paths, so a file edited in place isn't
read again: a batch run over the folder remains the exact mode.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X
from ..functions.embedding import Provider
from ..operators.indexing import index
from ..operators.store import Store
from ..sources.files import SIDECAR, canonical_mime, file_name, file_type, parse_files

BINARY = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def documents_of(files: DataFrame) -> DataFrame:
    """Documents of a batch of binary files; files of unknown type or that can't be read have none."""
    named = files.withColumn("name", file_name(F.col("path"))).filter(~F.col("name").startswith(".") & ~F.lower("name").endswith(SIDECAR))
    good = named.withColumn("kind", file_type(F.col("name"))).filter("kind IS NOT NULL AND length > 0").withColumn("file_hash", F.sha2("content", 256))
    rows = good.select("path", "name", "kind", "length", "file_hash").join(parse_files(good), "path").filter("error IS NULL").select("*", F.posexplode("sections").alias("at", "section"))
    return rows.select(
        X.document_id(F.col("file_hash"), F.col("at") + 1).alias("document_id"), F.col("path").alias("source"), F.col("name").alias("filename"), F.col("section.page_number").alias("page"), X.clean_text(F.col("section.text")).alias("text"),
        F.col("length").alias("file_size"), F.col("kind").alias("source_type"), canonical_mime(F.col("kind")).alias("mime_type"), "file_hash", F.lit(None).cast("string").alias("tenant_id"), F.col("format.title").alias("title"), F.col("format.author").alias("author"), F.col("format.date").alias("date"),
    ).filter("text <> ''")


def stream_folder(spark: SparkSession, folder: str, store: Store, provider: Provider, checkpoint: str, strategy: str = "fixed", params: dict[str, Any] | None = None, once: bool = True) -> StreamingQuery:
    """Index new files as they arrive; ``once`` takes what is there and stops."""
    files = spark.readStream.format("binaryFile").schema(BINARY).load(folder)

    def take(batch: DataFrame, _: int) -> None:
        index(store, documents_of(batch), provider, strategy, params)

    writer = files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
