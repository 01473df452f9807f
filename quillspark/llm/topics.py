"""Topics of texts: clusters of random-indexing vectors, fitted on all documents.

A word has a fixed sparse random vector, weighted by how few documents hold it; a document is the
unit sum of its words' vectors. The centres come from spherical k-means over every document, begun with the one of least hash and
then the farthest ones. Texts are split once, to counts by bucket ("bags") that are written beside the kept columns; document frequencies,
vectors, each round's sums and the topics are passes over these, without a shuffle but for the ``buckets`` frequencies. A round sends
``topics`` sums for each task to the driver. A document's topic is its nearest centre.

Vectors, centres and their sums are whole numbers of which every product and sum is exact in 53 bits, so topics depend neither on the
order of rows nor on their partitions.

Edge cases: null and empty texts, and texts of blanks only, have topic "none" and no tokens; texts are read whole, whatever their length, and split
in pieces of about ``max_chars`` bytes; clashing columns of the input are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, map_text, materialise

NONE = "none"
MEMO = 200_000
BAG = "__bag"
HASH = "__hash"
#: A unit of length in document vectors and centres, and of weight in word vectors.
UNIT = 1 << 24
WEIGHT = 1 << 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLANK = re.compile(rb"[ \t\n\r\x0b\f]")


@dataclass(frozen=True)
class Params:
    topics: int = 8
    buckets: int = 1 << 14
    size: int = 32
    nonzero: int = 4
    rounds: int = 20
    max_chars: int = 20_000
    seed: int = 23


class _Known(dict):
    """Buckets of the words seen lately."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word) % self.buckets
        return found


def words_of(text: str, size: int) -> Iterator[list[bytes]]:
    """Runs of bytes other than blanks, A-Z in lower case, by pieces of about ``size`` bytes that end at blanks."""
    data, at = text.encode("utf-8", "surrogatepass").translate(_LOWER), 0
    while at < len(data):
        cut = _BLANK.search(data, at + size) if len(data) - at > size else None
        end = cut.start() if cut else len(data)
        yield data[at:end].split()
        at = end


def _place(p: Params) -> type:
    return np.uint16 if p.buckets <= 1 << 16 else np.uint32


def unpack(bag: bytes, place: type) -> tuple[np.ndarray, np.ndarray]:
    """A bag's buckets, ascending, and their counts."""
    n = len(bag) // (np.dtype(place).itemsize + 4)
    return np.frombuffer(bag, place, n), np.frombuffer(bag, np.uint32, n, n * np.dtype(place).itemsize)


def count(docs: DataFrame, p: Params, id_col: str, text_col: str, keep: list[str], tokens: str) -> DataFrame:
    """The columns ``keep``, ``tokens`` of each row's whole text, its bag and a hash; written, as several passes read it."""

    def kernel():
        known, place, sums = _Known(p.buckets), _place(p), np.zeros(p.buckets, np.uint32)

        def bag(text: str) -> tuple[int, bytes]:
            n = 0
            for words in words_of(text, p.max_chars):
                if len(known) > MEMO:
                    known.clear()
                counts = Counter(words)
                np.add.at(sums, np.fromiter(map(known.__getitem__, counts), np.int64, len(counts)), np.fromiter(counts.values(), np.uint32, len(counts)))
                n += len(words)
            held = np.flatnonzero(sums)
            packed = held.astype(place).tobytes() + sums[held].tobytes()
            sums[held] = 0
            return n, packed

        def apply(texts: list[str]) -> list[pa.Array]:
            found = [bag(t) for t in texts]
            return [pa.array([n for n, _ in found], pa.int64()), pa.array([b for _, b in found], pa.binary())]

        return apply

    hashed = docs.withColumn(HASH, F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.lit(p.seed)))
    return materialise(map_text(hashed, kernel, [T.StructField(tokens, T.LongType()), T.StructField(BAG, T.BinaryType())], text_col, [*keep, HASH]), "bags")


def word_vectors(bags: DataFrame, p: Params) -> np.ndarray:
    """Random vectors by bucket, weighted by the logarithm of all documents with words to those that hold it; whole numbers."""
    place = _place(p)
    rows = bags.filter(F.length(BAG) > 0).select(BAG)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(p.buckets + 1, np.int64)
        for batch in batches:
            for bag in batch.column(0).to_pylist():
                held[unpack(bag, place)[0]] += 1
            held[-1] += batch.num_rows
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int64()), "n": pa.array(held[at], pa.int64())})

    held = np.zeros(p.buckets + 1, np.int64)
    for r in rows.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        held[r.bucket] = r.n
    rng = np.random.default_rng(p.seed)
    vectors = np.zeros((p.buckets, p.size))
    places = np.argsort(rng.random((p.buckets, p.size)), axis=1)[:, : p.nonzero]
    np.put_along_axis(vectors, places, rng.choice([-1.0, 1.0], (p.buckets, p.nonzero)), 1)
    return vectors * np.rint(np.log((1 + held[-1]) / (1 + held[:-1])) * WEIGHT)[:, None]


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length ``UNIT``, rounded to whole numbers; rows of zero stay."""
    rows = np.asarray(rows, np.float64)
    return np.rint(rows / np.maximum(np.sqrt((rows * rows).sum(1, keepdims=True)), 1e-300) * UNIT)


def vectors_of(bags: list[bytes], vectors: np.ndarray, place: type) -> np.ndarray:
    sums = np.empty((len(bags), vectors.shape[1]))
    for row, bag in zip(sums, bags, strict=True):
        held, counts = unpack(bag, place)
        row[:] = counts.astype(np.float64) @ vectors[held]
    return unit(sums)


def _read(column: pa.Array) -> np.ndarray:
    """Document vectors, which are at most UNIT long: products of two and their sums are exact in float64."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(len(column), -1).astype(np.float64)


def centres_of(x: DataFrame, p: Params) -> np.ndarray:
    """Spherical k-means over the rows (``HASH``, ``x``) of all documents with words."""
    first = x.agg(F.min(F.struct(HASH, "x")).alias("m")).first().m
    if first is None:
        return np.zeros((1, p.size))
    x = x.select("x")
    chosen = [bytes(first.x)]
    centres = np.frombuffer(chosen[0], np.int32).astype(np.float64)[None]

    def farthest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            near = (_read(batch.column(0)) @ centres.T).max(1, initial=-np.inf)
            for i in np.flatnonzero(near == near.min(initial=np.inf)):
                found = (float(near[i]), batch.column(0)[int(i)].as_py())
                best = min(best or found, found)
        if best:
            yield pa.RecordBatch.from_pydict({"near": pa.array([best[0]]), "x": pa.array([best[1]], pa.binary())})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(centres.shape, np.int64)
        for batch in batches:
            rows = _read(batch.column(0))
            sums += (np.eye(len(centres))[(rows @ centres.T).argmax(1)].T @ rows).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"sums": pa.array([sums.tobytes()], pa.binary())})

    while len(chosen) < p.topics:  # the document that is farthest from all centres so far
        found = x.mapInArrow(farthest, "near double, x binary").agg(F.min(F.struct("near", "x")).alias("m")).first().m
        if bytes(found.x) in chosen:
            break
        chosen.append(bytes(found.x))
        centres = np.vstack([centres, np.frombuffer(found.x, np.int32).astype(np.float64)])
    for _ in range(p.rounds):
        sums = np.zeros(centres.shape, np.int64)
        for r in x.mapInArrow(summed, "sums binary").collect():
            sums += np.frombuffer(r.sums, np.int64).reshape(sums.shape)
        moved = np.where(sums.any(1, keepdims=True), unit(sums), centres)
        if np.array_equal(moved, centres):
            break
        centres = moved
    return centres


def fit(bags: DataFrame, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Word vectors and centres of all documents that ``count`` wrote."""
    vectors = word_vectors(bags, p)
    shared, place = bags.sparkSession.sparkContext.broadcast(vectors), _place(p)  # buckets * size floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = vectors_of(batch.column(1).to_pylist(), shared.value, place).astype(np.int32)
            yield pa.RecordBatch.from_pydict({HASH: batch.column(0), "x": pa.array([row.tobytes() for row in found], pa.binary())})

    x = materialise(bags.filter(F.length(BAG) > 0).select(HASH, BAG).mapInArrow(run, f"{HASH} long, x binary"), "vectors")
    centres = centres_of(x, p)
    discard(x)
    return vectors, centres


def assign(bags: DataFrame, model: tuple[np.ndarray, np.ndarray], p: Params, keep: list[str], topic: str) -> DataFrame:
    """The columns ``keep`` of what ``count`` wrote, and the topic."""
    shared, place = bags.sparkSession.sparkContext.broadcast(model), _place(p)

    def kernel():
        vectors, centres = shared.value

        def apply(found: list[bytes]) -> list[pa.Array]:
            nearest = (vectors_of(found, vectors, place) @ centres.T).argmax(1)
            return [pa.array([f"topic-{t}" if bag else NONE for t, bag in zip(nearest.tolist(), found, strict=True)], pa.string())]

        return apply

    return map_text(bags, kernel, [T.StructField(topic, T.StringType())], BAG, keep)


def read_topics(docs: DataFrame, p: Params, id_col: str, text_col: str, keep: list[str], tokens: str, topic: str) -> DataFrame:
    """The columns ``keep``, and ``tokens`` and ``topic`` of each row's whole text."""
    bags = count(docs, p, id_col, text_col, keep, tokens)
    return assign(bags, fit(bags, p), p, [*[c for c in keep if c.lower() != tokens.lower()], tokens], topic)
