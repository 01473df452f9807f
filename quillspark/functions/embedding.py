"""Embedding providers: what turns texts into vectors, inside kernels or on the driver."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from typing import Protocol

import numpy as np


class Provider(Protocol):
    """Vectors for texts, in their order, all of one length."""

    size: int
    name: str

    def embed_batch(self, texts: list[str]) -> np.ndarray: ...


_WORD = re.compile(r"\w+")


def _hash(word: str) -> int:
    return int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "little")


class _Hashes(dict):
    """Hashes of words, made when first asked for; emptied when it is full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        found = self[word] = _hash(word)
        return found


_hashes = _Hashes()


@lru_cache(2)
def _word_chars(limit: int = 0x110000) -> np.ndarray:
    """For every character below ``limit`` whether ``\\w`` matches it."""
    return np.array([c.isalnum() or c == "_" for c in map(chr, range(limit))], bool)


class Words:
    """The words of one text with their places and hashes, so that many spans of it are embedded without reading it again.

    A span's words are those of its text alone: words that its ends cut count as what is left of them.
    """

    def __init__(self, text: str):
        self.text, self.lower = text, text.lower()
        #: Else lower case moves places, or depends on what stands around a letter.
        self.plain = len(self.lower) == len(text) and "Σ" not in text
        if self.plain:
            inside = np.zeros(len(text) + 2, bool)
            chars = np.frombuffer(self.lower.encode("utf-32-le", "surrogatepass"), np.uint32)
            inside[1:-1] = _word_chars(0x10000 if not len(chars) or chars.max() < 0x10000 else 0x110000)[chars]
            edges = np.flatnonzero(inside[1:] != inside[:-1])
            self.starts, self.ends = edges[::2], edges[1::2]
            self.hashes = np.fromiter(map(_hashes.__getitem__, _WORD.findall(self.lower)), np.int64, len(self.starts))

    def counts(self, spans: list[tuple[int, int]], size: int) -> np.ndarray:
        """Words by hash bucket, a row for each span."""
        at = np.array(spans, np.int64).reshape(-1, 2)
        lo, hi = np.searchsorted(self.ends, at[:, 0], "right"), np.searchsorted(self.starts, at[:, 1], "left")
        held = (hi > lo) & (at[:, 1] > at[:, 0])
        if not held.any():
            return np.zeros((len(at), size), np.int64)
        first, last = np.minimum(lo, len(self.starts) - 1), np.maximum(hi - 1, 0)
        left, right = held & (self.starts[first] < at[:, 0]), held & (self.ends[last] > at[:, 1])
        parts = [(n, self.lower[at[n, 0] : min(self.ends[first[n]], at[n, 1])]) for n in np.flatnonzero(left)]
        parts += [(n, self.lower[self.starts[last[n]] : at[n, 1]]) for n in np.flatnonzero(right & ~(left & (first == last)))]
        lo, hi = lo + left, hi - right
        many = np.where(held, np.maximum(hi - lo, 0), 0)
        rows = np.repeat(np.arange(len(at)), many)
        words = np.arange(len(rows)) + np.repeat(lo - np.cumsum(many) + many, many)
        filled = rows * size + self.hashes[words] % size
        if parts:
            filled = np.concatenate([filled, np.array([n * size + _hashes[w] % size for n, w in parts], np.int64)])
        return np.bincount(filled, minlength=len(at) * size).reshape(len(at), size)


#: Of the last text, which several strategies may cut.
words_of = lru_cache(1)(Words)


class HashProvider:
    """Word counts by hash bucket, for work without a model; the first component is never zero."""

    def __init__(self, size: int = 512):
        self.size, self.name = size, f"hash-{size}"

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        words = [_WORD.findall(text.lower()) for text in texts]
        rows = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        buckets = np.fromiter((_hashes[w] for line in words for w in line), np.int64, len(rows)) % self.size
        return self._vectors(np.bincount(rows * self.size + buckets, minlength=len(texts) * self.size).reshape(len(texts), self.size))

    def _vectors(self, counts: np.ndarray) -> np.ndarray:
        out = counts.astype(np.float32)
        out[:, 0] += np.float32(0.001)
        return out

    def embed_spans(self, words: Words, spans: list[tuple[int, int]], leads: list[str] | None = None) -> np.ndarray:
        """The vectors of ``embed_batch`` of these spans of a text, each behind its lead: nothing, or lines of the text's own words."""
        leads = leads or [""] * len(spans)
        if not words.plain:
            return self.embed_batch([lead + words.text[a:b] for lead, (a, b) in zip(leads, spans, strict=True)])
        counts = words.counts(spans, self.size)
        for lead in {*leads} - {""}:
            counts[[said == lead for said in leads]] += np.bincount([_hashes[w] % self.size for w in _WORD.findall(lead.lower())], minlength=self.size)
        return self._vectors(counts)

    def embed(self, text: str) -> np.ndarray:
        return self.embed_batch([text])[0]


class KeywordProvider:
    """How often each keyword occurs, plus a little; a provider for tests and examples."""

    def __init__(self, keywords: list[str]):
        self.keywords, self.size, self.name = keywords, len(keywords), "keywords"

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        return np.array([[t.lower().count(k) + 0.01 for k in self.keywords] for t in texts], np.float32).reshape(len(texts), self.size)


class RemoteProvider:
    """A hosted model, one call per batch. The client is made in the process that uses it."""

    def __init__(self, model: str = "text-embedding-3-small", size: int = 1536, client=None):
        self.name, self.size, self._client = model, size, client

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros((0, self.size), np.float32)
        if self._client is None:
            from openai import OpenAI

            self._client = OpenAI()
        answer = self._client.embeddings.create(model=self.name, input=texts)
        return check_vectors(np.array([d.embedding for d in sorted(answer.data, key=lambda d: d.index)], np.float32), len(texts), self.size)


def check_vectors(vectors: np.ndarray, count: int, size: int) -> np.ndarray:
    if len(vectors) != count:
        raise ValueError(f"{len(vectors)} embeddings for {count} texts")
    if count and vectors.shape[1] != size:
        raise ValueError(f"embeddings of {vectors.shape[1]} numbers, not {size}")
    return vectors


def cosine_similarity(a: list[float], b: list[float]) -> float:
    x, y = np.asarray(a, float), np.asarray(b, float)
    if x.shape != y.shape:
        raise ValueError("vectors of different length")
    scale = np.linalg.norm(x) * np.linalg.norm(y)
    if not scale:
        raise ValueError("a zero vector has no direction")
    return float(x @ y / scale)
