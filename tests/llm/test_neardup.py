"""Near duplicates against brute force, with groups that chain, copies, and odd rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import buckets, neardup
from quillspark.llm.components import connected_components


def brute(rows: list[tuple], k: int, percent: int) -> dict[int, int]:
    sets = {i: neardup.shingles(neardup.words_of(t or ""), k) for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def corpus(words, seed: int = 3) -> list[tuple]:
    rng = np.random.default_rng(seed)
    rows: list[tuple] = []
    for g in range(12):  # groups of near copies, some of them only reached through others
        base = words(g, 120)
        for copy in range(1 + 6 * (g % 3) + (90 if g == 5 else 0)):
            text = list(base)
            for at in rng.integers(0, 120, rng.integers(0, 6)):
                text[at] = words(1000 + int(rng.integers(0, 10**6)), 1)[0]
            if copy % 4 == 3:
                base = text
            rows.append(" ".join(text))
    rows += ["exact copy of a line that repeats here"] * 40 + ["EXACT copy of a line\tthat repeats here", "", None, "   ", "one two", "ONE two", "one", "é ü " * 50, " ".join(words(77, 30_000))]
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_against_brute_force(spark, words, monkeypatch, k, percent):
    monkeypatch.setattr(buckets, "SMALL", 4)
    monkeypatch.setattr(buckets, "BLOCK", 16)
    rows = corpus(words)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("key", F.lit(1)).repartition(3)
    got = {r.doc_id: r for r in neardup.near_duplicates(docs, k, percent).collect()}
    expected = brute(rows, k, percent)
    assert {i: r.component_id for i, r in got.items()} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    texts = dict(rows)
    assert all(r.n_shingles == len(neardup.shingles(neardup.words_of(texts[i] or ""), k)) for i, r in got.items())


def test_odd_tables(spark):
    schema = "doc_id long, text string, lang string"
    assert neardup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c", "x"), (1, "a b c", "x"), (1, "a b c", "x"), (2, None, None)]
    got = sorted(map(tuple, neardup.near_duplicates(spark.createDataFrame(rows, schema), 3, 85).collect()), key=str)
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True), (None, 1, None, False)]
    kept = neardup.keep_one(spark.createDataFrame(rows, schema), 3, 85)
    assert kept.columns == ["doc_id", "text", "lang"] and sorted(r.doc_id for r in kept.collect()) == [1, 2]


def test_rows_without_an_id_of_their_own(spark, words):
    """Null and repeated ids: a text goes only if another row holds nearly the same."""
    text = [" ".join(words(i, 60)) for i in range(6)]
    near = text[1] + " more"
    rows = [(0, text[0]), (1, near), (7, text[1]), (7, text[2]), (7, text[2]), (None, text[3]), (None, text[3]), (None, text[0]), (None, text[4]), (8, text[5])]
    kept = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    want = [(0, text[0]), (1, near), (7, text[2]), (None, text[3]), (None, text[4]), (8, text[5])]
    assert sorted(map(tuple, kept), key=str) == sorted(want, key=str)


def test_a_repeated_id_is_one_vertex(spark):
    rows = [(5, "a b c d e f"), (5, "x y z w v u"), (3, "x y z w v u"), (9, "a b c d e f"), (5, ""), (5, None), (9, ""), (4, "q w e r t y"), (8, "q w e r t y")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got} == {5: 3, 3: 3, 9: 3, 4: 4, 8: 4}
    assert sorted((r.doc_id, r.n_shingles, r.kept) for r in got) == sorted([(5, 4, False), (5, 4, False), (3, 4, True), (9, 4, False), (5, 0, False), (5, 0, False), (9, 0, False), (4, 4, True), (8, 4, False)])


def test_blocks_are_bound_by_bytes(spark, words, monkeypatch):
    """Long near copies: blocks of few rows find the same groups."""
    monkeypatch.setattr(buckets, "SMALL", 2)
    monkeypatch.setattr(buckets, "BLOCK_BYTES", 40_000)
    rows = []
    for g in range(2):
        base = words(g, 2000)
        for copy in range(12):
            text = list(base)
            for at in range(copy * 50, copy * 50 + 45):
                text[at] = words(5000 + g * 1000 + copy, 1)[0]
            rows.append((g * 100 + copy, " ".join(text)))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == brute(rows, 3, 85)


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 9), (7, 7), (None, 1)] + [(100 + i, 101 + i) for i in range(60)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 6)} | {8: 8, 9: 8} | {i: 100 for i in range(100, 161)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    own = neardup.Sketcher(3)
    x = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    a, b = np.unique(x[:800]), np.unique(x[100:])
    ka, kb = own.registers(a), own.registers(b)
    assert neardup.merge(ka, kb) == own.registers(np.union1d(a, b))
    u, v = np.frombuffer(ka, np.uint8), np.frombuffer(kb, np.uint8)
    one = lambda n: np.array([float(n)])
    guess = neardup.estimate(one(len(a)), one(len(b)), one((u > v).sum()), one((u < v).sum()))[0]
    assert abs(guess - 700 / 900) < 0.12
