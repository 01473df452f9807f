"""The nearest chunks of a stated query set among all chunks of all documents, found where the chunks are made."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.embedding import HashProvider, words_of
from ..session import in_blocks
from .chunking import Piece, fold

#: Chunks whose scores are found at once, and queries.
CHUNKS, QUERIES = 1024, 256
#: What a score in single precision may be off by; below it a chunk can't be among the nearest.
MARGIN = 1e-4


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


class Nearest:
    """The k best retrievable chunks of every query and label so far; ties by chunk id, document and place.

    Scores in single precision say which chunks may be among the best; these get theirs in double, rounded so that equal vectors tie.
    """

    def __init__(self, names: list, matrix: np.ndarray, provider: HashProvider, k: int):
        self.names, self.matrix, self.provider, self.k = names, matrix, provider, k
        self.single = matrix.astype(np.float32)
        self.waiting: dict[str, list[tuple[np.ndarray, list[tuple]]]] = defaultdict(list)
        self.best: dict[str, list[list[tuple]]] = {}
        self.least: dict[str, np.ndarray] = {}

    def add(self, label: str, document: str, text: str, pieces: list[Piece]) -> None:
        around = {p.name: (p.start, p.end) for p in pieces if not p.retrievable}
        own = [p for p in pieces if p.retrievable]
        for at in range(0, len(own), CHUNKS):
            part = own[at : at + CHUNKS]
            vectors = self.provider.embed_spans(words_of(text), [(p.start, p.end) for p in part], [p.lead for p in part])
            rows = [(f"{document}_{p.name}", document, p.start, p.end, *around.get(p.context, (p.start, p.end))) for p in part]
            self.waiting[label].append((vectors, rows))
            if sum(len(r) for _, r in self.waiting[label]) >= CHUNKS:
                self._rank(label)

    def _rank(self, label: str) -> None:
        parts = self.waiting.pop(label)
        vectors, rows = np.concatenate([v for v, _ in parts]), [r for _, own in parts for r in own]
        single = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        best = self.best.setdefault(label, [[] for _ in self.names])
        least = self.least.setdefault(label, np.full(len(self.names), -np.inf))
        for lo in range(0, len(self.names), QUERIES):
            scores = self.single[lo : lo + QUERIES] @ single.T
            bound = least[lo : lo + QUERIES]
            if len(rows) > self.k and np.isneginf(bound).any():
                bound = np.maximum(bound, np.partition(scores, -self.k, axis=1)[:, -self.k] - MARGIN)
            query, chunk = np.nonzero(scores >= (bound - MARGIN)[:, None])
            for n in np.unique(query):
                take = chunk[query == n]
                exact = np.round((_unit(vectors[take]) * self.matrix[lo + n]).sum(axis=1), 12)
                held = best[lo + n] + [(-s, *rows[c]) for s, c in zip(exact.tolist(), take.tolist(), strict=True) if s >= least[lo + n]]
                best[lo + n] = held = sorted(held)[: self.k]
                if len(held) == self.k:
                    least[lo + n] = -held[-1][0]

    def done(self) -> Iterator[tuple]:
        for label in list(self.waiting):
            self._rank(label)
        for label, best in self.best.items():
            for name, held in zip(self.names, best, strict=True):
                yield from ((label, name, -row[0], *row[1:]) for row in held)


def nearest(docs: DataFrame, specs: dict[str, tuple[str, dict[str, Any]]], queries: DataFrame, provider: HashProvider, k: int, size: int = 10_000) -> DataFrame:
    """label, query_id, rank, chunk_id, document_id, start, end, and the place of the chunk's context: the k nearest chunks by cosine.

    Documents are cut, embedded and ranked in one pass, a block of ``size`` queries at a time; k rows of each query, label and task are shuffled.
    """
    places = ("start", "end", "context_start", "context_end")
    schema = T.StructType([T.StructField("label", T.StringType()), T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("chunk_id", T.StringType()), T.StructField("document_id", T.StringType()), *(T.StructField(c, T.IntegerType()) for c in places)])

    def against(held: list) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(([r.query_id for r in held], _unit(np.array([r.query for r in held]))))
        return fold(docs, specs, lambda: Nearest(*shared.value, provider, k), schema, provider)

    parts = [against(held) for held in in_blocks(queries.select("query_id", "query"), size)]
    best = reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], schema)
    order = Window.partitionBy("label", "query_id").orderBy(F.desc("score"), "chunk_id", "document_id", "start", "end")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
