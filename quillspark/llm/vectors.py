"""Embedding near-dedup (9): E8 lattice cells in several tables, neighbouring cells probed, cosines verified.

Unit vectors are projected at random to groups of eight dimensions; each group is decoded to its
nearest E8 point, and a table's key is the points of its groups. Each vector stands in its own cell
and in the nearest neighbouring ones of each table. Members of a cell are candidates: random partners first, then what
crosses the components so found (see ``buckets``). Every candidate's cosine is computed in double
precision. All links of a vector lie inside its component, so the links are
counted there, block against block, without writing any pair.

Equal vectors are one class from the start, so a vector that a third of all rows share costs no more than one.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing and
are their own component; vectors of different length never link; rows of null id get null component_id; repeated ids
share a component and count each row as a vector; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .buckets import BLOCK, crossing, first_pairs, in_blocks, shared_buckets
from .common import discard, materialise
from .components import connected_components
from .lattice import LatticeHash


@dataclass(frozen=True)
class Params:
    threshold: float = 0.9
    tables: int = 20
    blocks: int = 3
    width: float = 2.4
    probes: int = 3


def _clean(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    vec = F.transform(F.col(f"`{vec_col}`"), lambda x: x.cast("double"))
    good = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), vec.alias("v")).withColumn("v", F.when(F.coalesce(good, F.lit(False)), F.col("v")))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equal length as unit vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    flat = flat / np.abs(flat).max(1, keepdims=True)  # squares of very large or small numbers stay finite
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _cells(classes: DataFrame, p: Params) -> DataFrame:
    """(bucket, id): each class in its cells of all tables."""
    schema = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("id", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[int, LatticeHash] = {}
        for batch in batches:
            lengths = batch.column("size").to_numpy()
            for size in np.unique(lengths).tolist():
                own = batch.filter(pa.array(lengths == size))
                if size not in hashes:
                    hashes[size] = LatticeHash(size, p.tables, p.blocks, p.width, p.probes)
                for lo in range(0, own.num_rows, 2048):
                    part = own.slice(lo, 2048)
                    keys = hashes[size].keys(_matrix(part.column("v")))
                    tables = np.arange(p.tables, dtype=np.int64)[None, :, None] * 1_000_003 + size * 7
                    keys = (keys ^ (tables * np.int64(-7046029254386353131))).reshape(len(keys), -1)
                    ids = np.repeat(part.column("id").to_numpy(), keys.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], names=["bucket", "id"])

    return classes.select("id", "v", F.size("v").alias("size")).mapInArrow(run, schema)


def _verified(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs a, b whose cosine reaches the threshold."""
    one = pairs.join(classes.select(F.col("id").alias("a"), F.col("v").alias("va")), "a")
    two = one.join(classes.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b").filter(F.size("va") == F.size("vb"))
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("size").to_numpy()
            for size in np.unique(lengths).tolist():
                own = batch.filter(pa.array(lengths == size))
                ok = pa.array((_matrix(own.column("va")) * _matrix(own.column("vb"))).sum(1) >= threshold)
                yield pa.RecordBatch.from_arrays([own.column("a").filter(ok), own.column("b").filter(ok)], names=["a", "b"])

    return two.select("a", "b", "va", "vb", F.size("va").alias("size")).mapInArrow(run, schema)


def _count_links(inside: DataFrame, threshold: float) -> DataFrame:
    """id, linked: how many vectors of other classes each class of (id, component, v, copies) links with."""
    sizes = materialise(inside.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "sizes")
    h = F.pmod(F.xxhash64("id", F.lit(2)), F.col("blocks"))
    rows = inside.join(sizes, "component").withColumn("own", h)
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1))
    dealt = rows.withColumn("other", each).select(
        F.explode(F.array(F.struct(F.lit(True).alias("asks"), F.col("own").alias("i"), F.col("other").alias("j")), F.struct(F.lit(False).alias("asks"), F.col("other").alias("i"), F.col("own").alias("j")))).alias("d"), "component", "id", "copies", "v",
    )
    full = dealt.select(F.xxhash64("component", "d.i", "d.j").alias("block"), "d.asks", "id", "copies", "v")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("linked", T.LongType())])

    def compare(block: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        asks = block.column("asks").to_numpy(zero_copy_only=False)
        ids, copies, vectors = block.column("id").to_numpy(), block.column("copies").to_numpy(), _matrix(block.column("v"))
        one, two = np.flatnonzero(asks), np.flatnonzero(~asks)
        for lo in range(0, len(one), 256):
            part = one[lo : lo + 256]
            near = (vectors[part] @ vectors[two].T >= threshold) & (ids[part][:, None] != ids[two])
            yield ids[part], near.astype(np.int64) @ copies[two]

    return in_blocks(full, compare, schema).groupBy("id").agg(F.sum("linked").alias("linked"))


def near_vectors(rows: DataFrame, p: Params | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, n_links, component_id and kept of every row."""
    p = p or Params()
    clean = _clean(rows, id_col, vec_col)
    key = F.when(F.col("v").isNotNull() & F.col("id").isNotNull(), F.sha2(F.concat_ws(",", F.transform("v", lambda x: x.cast("string"))), 256))
    every = materialise(clean.withColumn("key", key), "vectors")
    classes = materialise(every.filter("key IS NOT NULL").groupBy("key").agg(F.min(F.struct("id", "v")).alias("r"), F.count("*").alias("copies")).select("key", "r.id", "r.v", "copies"), "classes")
    cells = materialise(_cells(classes, p), "cells")
    members = shared_buckets(cells)
    discard(cells)
    proposed = first_pairs(members).select(F.least("owner", "other").alias("a"), F.greatest("owner", "other").alias("b")).distinct()
    first = materialise(_verified(proposed, classes, p.threshold), "verified")
    components = connected_components(first)

    def compare(block: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        asks = block.column("asks").to_numpy(zero_copy_only=False)
        ids, c, vectors = block.column("id").to_numpy(), block.column("c").to_numpy(), _matrix(block.column("v"))
        one, two = np.flatnonzero(asks), np.flatnonzero(~asks)
        for lo in range(0, len(one), 256):
            part = one[lo : lo + 256]
            r, s = np.nonzero((vectors[part] @ vectors[two].T >= p.threshold) & (c[part][:, None] != c[two]))
            yield ids[part[r]], ids[two[s]]

    small, large = crossing(members, components, classes.select("id", (F.size("v") * 8).cast("long").alias("bytes")), lambda ids: classes.select("id", "v").join(ids, "id"), compare)
    second = materialise(_verified(small, classes, p.threshold).unionByName(large).distinct(), "verified")
    if not second.isEmpty():
        components = connected_components(first.unionByName(second))
    inside = materialise(classes.join(components, "id").select("component", "id", "v", "copies"), "inside")
    linked = _count_links(inside, p.threshold)
    named = classes.select("key", "id", "copies").join(linked, "id", "left").join(components, "id", "left")
    named = materialise(named.select("key", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "named")
    found = every.select("id", "key").join(named, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return found.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))
