"""Candidates from shared buckets, without comparing all pairs of a bucket.

``first_pairs`` proposes two partners for each member of a bucket. Once the proposals are
verified and joined to components, a link that is still missing crosses components; ``crossing``
finds those. In a small bucket they are few and are joined; in a large one the members outside its
largest component meet all members of other components in blocks of bounded size, each in a task's memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import among, discard, materialise

#: Parts into which the members of a bucket are dealt before they are paired.
SALTS = 32
#: Members of a side of a block, and their bytes.
BLOCK = 1024
BLOCK_BYTES = 8 << 20
#: Buckets up to this size are joined with themselves.
SMALL = 16

PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def shared_buckets(banded: DataFrame) -> DataFrame:
    """The rows (bucket, id, ...) of the buckets with more than one member."""
    counts = materialise(banded.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1").select("bucket"), "shared")
    members = materialise(among(banded, "bucket", counts, 1 << 20).join(counts, "bucket"), "members")
    discard(counts)
    return members


def first_pairs(members: DataFrame) -> DataFrame:
    """Pairs inside buckets: owner, other. A member owns two for each of its buckets at most.

    The order is that of the ids' hashes in every bucket, so buckets with the same members propose the same pairs.
    """
    order = F.xxhash64("id")
    rows = members.select("bucket", "id", order.alias("h"), F.pmod(order, F.lit(SALTS)).alias("salt"))
    part = Window.partitionBy("bucket", "salt").orderBy("h", "id")
    inner = rows.withColumns({"before": F.lag("id").over(part), "top": F.first("id").over(part)})
    leaders = inner.filter("before IS NULL").select("bucket", "id", "h")
    whole = Window.partitionBy("bucket").orderBy("h", "id")  # one leader a part, so at most SALTS rows
    outer = leaders.withColumns({"before": F.lag("id").over(whole), "top": F.first("id").over(whole)})
    both = inner.filter("before IS NOT NULL").select("id", "before", "top").unionByName(outer.filter("before IS NOT NULL").select("id", "before", "top"))
    pairs = both.select(F.col("id").alias("owner"), F.explode(F.array("before", "top")).alias("other"))
    return pairs.filter("owner <> other").distinct()


def crossing(members: DataFrame, components: DataFrame, weights: DataFrame, payload: Callable[[DataFrame], DataFrame], compare: Callable[[pa.Table], Iterator[tuple[np.ndarray, np.ndarray]]]) -> tuple[DataFrame, DataFrame]:
    """Pairs a < b of different components in a bucket: all of small buckets, and what ``compare`` passes of large ones.

    ``payload`` gives columns for the ids (id) of large buckets, and ``weights`` all ids' bytes (id, bytes). ``compare`` gets
    a block as a table with asks, id, c (component), the members' and the payload's columns, and yields the ids of pairs of
    one row that asks and one that doesn't. A side of a block has about ``BLOCK`` rows and ``BLOCK_BYTES`` bytes at most;
    a row that is larger than that by itself stands with about as much again.
    """
    labelled = members.join(components.select("id", "component"), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    labelled = materialise(labelled.join(weights, "id"), "labelled")
    parts = labelled.groupBy("bucket", "c").agg(F.count("*").alias("m"), F.sum("bytes").alias("bytes"))
    mixed = parts.groupBy("bucket").agg(F.sum("m").alias("members"), F.sum("bytes").alias("bytes"), F.max(F.struct("m", "c", "bytes")).alias("top"), F.count("*").alias("parts")).filter("parts > 1")
    blocks = lambda m, size: F.ceil(F.greatest(m / BLOCK, size / BLOCK_BYTES, F.lit(1))).cast("long")
    mixed = mixed.select("bucket", "members", F.col("top.c").alias("main"), blocks(F.col("members"), F.col("bytes")).alias("blocks"), blocks(F.col("members") - F.col("top.m"), F.col("bytes") - F.col("top.bytes")).alias("others"))
    mixed = materialise(mixed, "mixed")
    rows = materialise(among(labelled.drop("bytes"), "bucket", mixed.select("bucket"), 1 << 20).join(mixed, "bucket"), "unsettled")
    discard(labelled, mixed)
    few = rows.filter(F.col("members") <= SMALL)
    one, two = few.filter("c <> main").select("bucket", F.col("id").alias("x"), F.col("c").alias("cx")), few.select("bucket", F.col("id").alias("y"), F.col("c").alias("cy"))
    small = materialise(one.join(two, "bucket").filter("cx <> cy").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "small")
    many = rows.filter(F.col("members") > SMALL)
    more = [c for c in members.columns if c not in ("bucket", "id")]
    h = F.xxhash64("id", F.lit(1))
    told = many.select("bucket", "id", "c", *more, F.lit(False).alias("asks"), F.pmod(h, F.col("blocks")).alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)).alias("i"))
    asking = many.filter("c <> main").select("bucket", "id", "c", *more, F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("j"), F.pmod(h, F.col("others")).alias("i"))
    dealt = told.unionByName(asking)
    held = materialise(payload(many.select("id").distinct()), "payload")
    full = dealt.join(held, "id").withColumn("block", F.xxhash64("bucket", "i", "j")).drop("bucket", "i", "j")
    found = in_blocks(full, compare)
    large = materialise(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "large")
    discard(rows, held)
    return small, large


def in_blocks(rows: DataFrame, compare: Callable[[pa.Table], Iterator[tuple[np.ndarray, np.ndarray]]], schema: T.StructType = PAIR) -> DataFrame:
    """Bring the rows of each ``block`` together and hand them to ``compare`` as one table."""
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        block = None

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                for found in compare(pa.Table.from_batches(held)):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=names)
            held.clear()

        for batch in batches:
            keys = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi > lo:
                    if keys[lo] != block:
                        yield from close()
                        block = keys[lo]
                    held.append(batch.slice(lo, hi - lo))
        yield from close()

    return rows.repartition(F.col("block")).sortWithinPartitions("block").mapInArrow(run, schema)
