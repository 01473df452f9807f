"""Operators on frames: cleaning, chunking, store, indexing, retrieval, evaluation, streaming, plans."""

from __future__ import annotations

import json
import time
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quillspark.functions import spans as S
from quillspark.functions import text as X
from quillspark.functions.embedding import HashProvider, KeywordProvider
from quillspark.operators import chunking as C
from quillspark.operators import evaluation as V
from quillspark.operators.embed import embed, embed_cached
from quillspark.operators import store as store_module
from quillspark.operators.indexing import index, plan, replay, replayed
from quillspark.operators.nearest import nearest
from quillspark.operators.retrieval import NO_CONTEXT, Answerer, RemoteLLM, Retriever, expand_to_context, generate_all, prompt, prompts
from quillspark.operators.store import Store, store_name, top_k, top_k_batch
from quillspark.plans import experiment
from quillspark.plans.app import Quote, models, question_loop
from quillspark.plans.report import clip, clip_left
from quillspark.settings import Settings
from quillspark.streaming.ingest import stream_folder

PROVIDER = KeywordProvider(["cat", "dog", "fish"])


def test_clean(spark):
    raw = "﻿ a\r\nb\rc  d\x00\t e  \n\n\n\n f  "
    got = spark.createDataFrame([(raw,), (None,), ("",)], "t string").select(X.clean_text(F.col("t"))).collect()
    assert got[0][0] == "﻿ a\nb\nc d e\n\n f" and got[1][0] is None and got[2][0] == ""


def test_chunks_of_odd_texts(spark):
    texts = [("d1", "word " * 300), ("d2", "x" * 500), ("d3", "x" * 501), ("d4", "  "), ("d5", None), ("d6", "a\n\nb c")]
    docs = spark.createDataFrame(texts, "document_id string, text string")
    rows = C.chunk(docs, "fixed").orderBy("chunk_id").collect()
    expected = sorted((f"{d}_{p.name}", p.start, p.end) for d, t in texts if t and t.strip() for p in C.fixed(t))
    assert [(r.chunk_id, r.start, r.end) for r in rows] == expected
    words = lambda text: S.between(text, 0, len(text), S.SEPARATORS["word"])
    spans = C.spans_frame(docs, words, "document_id").filter("document_id in ('d4', 'd5', 'd6')").orderBy("n").collect()
    assert [tuple(r) for r in spans] == [("d6", 0, 0, 1), ("d6", 1, 3, 4), ("d6", 2, 5, 6)]


def test_store_changes_are_deltas(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/s")
    rows = lambda *ids: spark.createDataFrame([(f"c{i}", [1.0, float(i)]) for i in ids], "chunk_id string, embedding array<float>")
    held = lambda: sorted(r.chunk_id for r in store.rows().collect())
    names = lambda: sorted(p.name for p in (tmp_path / "s").iterdir() if not p.name.endswith(".crc"))
    assert store.count() == 0
    store.add(rows(0, 1))
    (tmp_path / "s" / "v=2").mkdir()  # a writer died before its marker
    assert held() == ["c0", "c1"] and store._numbers() == [1]
    store.add(rows(2))
    assert store.delete(rows(0, 9)) == 1 and held() == ["c1", "c2"]
    store.add(rows(0))  # back again, after it was dropped
    store.update("c1", title="T")
    assert held() == ["c0", "c1", "c2"] and {r.chunk_id: r.title for r in store.rows().collect()}["c1"] == "T"
    assert names() == ["CURRENT-4", "CURRENT-5", "gone=3", "gone=5", "v=1", "v=2", "v=4", "v=5"]
    monkeypatch.setattr(store_module, "COMPACT", 6)
    store.add(rows(7))
    assert held() == ["c0", "c1", "c2", "c7"] and store._state(7) == {"parts": [7], "gone": []}
    with pytest.raises(KeyError):
        store.update("nobody", title="T")


def test_plan_by_groups_is_the_plan_by_tenant(spark):
    """Names that share documents, in chains, against one replay of a tenant's whole manifest."""
    rng = np.random.default_rng(6)
    stored = [(t, f"f{i}", f"{'abcdefgh'[int(rng.integers(0, 8))]}{i % 3}-1", f"x{t}{i}", 1) for t in "uv" for i in range(12)]
    arrivals = [(t, n, f"f{int(rng.integers(0, 16))}", f"{'abcdefgh'[int(rng.integers(0, 8))]}{int(rng.integers(0, 3))}-{1 + n % 2}") for t in "uv" for n in range(40)]
    old = spark.createDataFrame(stored, "tenant_id string, filename string, document_id string, chunk_id string, version int").withColumn("previous_version", F.lit(None).cast("string"))
    got = sorted(map(tuple, plan(old, spark.createDataFrame(arrivals, "tenant_id string, seq long, filename string, document_id string")).collect()), key=str)
    want = [(t, *r) for t in "uv" for r in replay(sorted((f, d, 1, None) for u, f, d, _, _ in stored if u == t), [a[1:] for a in arrivals if a[0] == t])]
    assert got == sorted(want, key=str)


def test_long_texts_take_seconds(spark):
    """Costs grow with the text, not with its square."""
    docs = spark.createDataFrame([("d", "word " * 400_000)], "document_id string, text string")
    began = time.time()
    assert C.chunk(docs, "fixed").count() == -(-(2_000_000 - 500) // 450) + 1
    assert C.spans_frame(docs, lambda t: S.pack(S.between(t, 0, len(t), r"\s+"), 200), "document_id").count() == 10_000
    assert time.time() - began < 30


@pytest.mark.parametrize("name", ["sentence", "structure", "hierarchical"])
def test_partitioning_does_not_matter(spark, name):
    docs = spark.createDataFrame([(f"d{i}", f"# T{i}\n\n" + "Some text here. " * (20 * i)) for i in range(1, 9)], "document_id string, text string")
    one, many = (sorted(map(tuple, C.chunk(docs.repartition(n), name).collect()), key=str) for n in (1, 5))
    assert one == many


def test_routing(spark):
    docs = spark.createDataFrame([("a", "x, y\n1, 2", "csv"), ("b", "# H\n\ntext", "markdown"), ("c", "text", None)], "document_id string, text string, source_type string")
    assert {r.document_id: r.strategy for r in C.chunk(docs, "metadata_aware").collect()} == {"a": "metadata_aware:recursive", "b": "metadata_aware:structure", "c": "metadata_aware:recursive"}
    with pytest.raises(ValueError, match="itself"):
        C.chunk(docs, "metadata_aware", {"rules": [{"when": {}, "strategy": "metadata_aware"}]})
    with pytest.raises(ValueError, match="provider"):
        C.chunk(docs, "semantic")


def test_context_join(spark):
    docs = spark.createDataFrame([("d", "Some words here. " * 60)], "document_id string, text string")
    rows = C.with_context(C.chunk(docs, "parent_child", {"parent_size": 300, "child_size": 80})).collect()
    assert rows and all(r.text in r.context_text for r in rows)


def _documents(spark, rows):
    frame = spark.createDataFrame(rows, "source string, filename string, text string, tenant_id string, department string")
    return frame.withColumn("document_id", X.document_id(X.content_hash(F.col("text")), F.lit(1)))


def test_index_versions_refresh_and_duplicates(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.count() == 0
    first = _documents(spark, [("1", "a.txt", "A cat sat.", None, "x"), ("2", "b.txt", "A dog ran.", None, "x"), ("3", "c.txt", "A cat sat.", None, "x"), ("4", "a.txt", "A cat sat.", "t2", "x")])
    done = {(r.tenant_id, r.filename): r for r in index(store, first, PROVIDER).collect()}
    assert done["default", "a.txt"].action == "index" and done["default", "c.txt"].duplicate_of == "a.txt" and done["t2", "a.txt"].action == "index"
    assert store.count() == 3
    again = index(store, first, PROVIDER).collect()
    assert {r.action for r in again} == {"refresh", "duplicate"} and store.count() == 3
    second = _documents(spark, [("1", "a.txt", "A fish swam.", None, "x"), ("2", "b.txt", "A dog ran.", None, "new")])
    index(store, second, PROVIDER)
    rows = {(r.tenant_id, r.filename): r for r in store.rows().collect()}
    assert rows["default", "a.txt"].version == 2 and rows["default", "a.txt"].text == "A fish swam." and rows["default", "a.txt"].previous_version
    assert rows["default", "b.txt"].department == "new" and rows["t2", "a.txt"].version == 1
    assert rows["default", "a.txt"].chunk_id.startswith("default:")


def test_groups_are_replayed_as_they_come():
    """Many small groups and one that lies in several batches: each is replayed alone and in order."""
    arrivals = [("t", f"n{n}", n, f"n{n}", f"k{n}-1", 0, None) for n in range(12_000)]
    long = [("u", "a", -1, "a", "k0-1", 1, None)] + [("u", "a", n, "ab"[n % 2], f"k{n // 3}-1", 0, None) for n in range(40)]
    names = ["tenant_id", "__group", "seq", "filename", "document_id", "version", "previous_version"]
    rows = arrivals + long
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[at : at + 17]]) for at in range(0, len(rows), 17)]
    batches = [pa.RecordBatch.from_arrays([c.cast(pa.string()) if c.type == pa.null() else c for c in b.columns], names=names) for b in batches]
    out = [tuple(r.values()) for b in replayed(iter(batches)) for r in b.to_pylist()]
    assert [r[1:5] for r in out if r[0] == "t"] == [(n, f"n{n}", f"k{n}-1", "index") for n in range(12_000)]
    assert [r[1:] for r in out if r[0] == "u"] == replay([("a", "k0-1", 1, None)], [r[2:5] for r in long[1:]])


def test_chunks_carry_their_document_and_context(spark):
    """What joins by id gave, from the pass that cuts; of two rows of one id each keeps its own."""
    docs = spark.createDataFrame([("d", "Some words here. " * 60, 1), ("e", "Other words there. " * 40, None)], "document_id string, text string, n int")
    for name, params in (("parent_child", {"parent_size": 300, "child_size": 80}), ("fixed", {})):
        got = C.chunk(docs, name, params, carry=["n"], context=True)
        want = C.with_context(C.chunk(docs, name, params)).join(docs.select("document_id", "n"), "document_id")
        assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    twice = C.chunk(docs.withColumn("document_id", F.lit("d")), "parent_child", carry=["n"], context=True).collect()
    assert all(r.text in r.context_text and ("Some" in r.text) == (r.n == 1) for r in twice)


def test_replay_follows_the_order():
    # A takes B's old content while B is edited: skipped if A comes first, indexed if B does.
    stored = [("a", "k1-1", 1, None), ("b", "k2-1", 1, None)]
    assert [r[3] for r in replay(stored, [(0, "a", "k2-1"), (1, "b", "k3-1")])] == ["duplicate", "index", "retire"]
    assert [r[3] for r in replay(stored, [(0, "b", "k3-1"), (1, "a", "k2-1")])] == ["index", "retire", "index", "retire"]
    back = replay([], [(0, "a", "k1-1"), (1, "a", "k2-1"), (2, "a", "k1-1")])
    assert [(r[3], r[4], r[7]) for r in back] == [("index", 1, False), ("index", 2, False), ("index", 3, True)]


def _store(spark, path):
    store = Store(spark, f"file://{path}/s")
    rows = [("c1", "cat cat", "t1", 1), ("c2", "cat dog", "t1", 2), ("c3", "dog", "t2", 1), ("c4", "fish", None, 3)]
    frame = spark.createDataFrame(rows, "chunk_id string, text string, tenant_id string, page int")
    store.add(embed(frame.withColumn("filename", F.lit("f.txt")), PROVIDER))
    return store


def test_search_filters_and_changes(spark, tmp_path):
    store = _store(spark, tmp_path)
    query = PROVIDER.embed_batch(["cat"])[0].tolist()
    found = lambda **f: [r.chunk_id for r in store.search(query, 10, f or None).orderBy("rank").collect()]
    assert found()[:2] == ["c1", "c2"]
    assert found(tenant_id="t1", page=2) == ["c2"] and found(page="2") == [] and found(nothing=1) == []
    with pytest.raises(TypeError):
        store.search(query, 1, ["x"])
    with pytest.raises(ValueError):
        store.search(query, 0)
    store.update("c1", page=9)
    assert found(page=9) == ["c1"]
    with pytest.raises(KeyError):
        store.update("zz", page=1)
    assert store.delete(spark.createDataFrame([("c1",), ("zz",)], "chunk_id string")) == 1 and store.count() == 3
    with pytest.raises(ValueError, match="length"):
        store.add(spark.createDataFrame([("x", [1.0])], "chunk_id string, embedding array<float>"))
    with pytest.raises(ValueError, match="finite"):
        store.add(spark.createDataFrame([("x", [0.0, 0.0, 0.0])], "chunk_id string, embedding array<float>"))
    assert store.documents("t1").count() == 2
    assert store_name("fixed", {"chunk_size": 500, "overlap": 50}) == "vector_store" and store_name("token", {}).startswith("vector_store.token-")


def test_top_k_of_more_queries_than_a_block(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(10_050, 3)).astype(np.float32)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "query_id long, query array<float>")
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors[:40])], "chunk_id long, embedding array<float>")
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    want = np.argsort(-(unit @ unit[:40].T), axis=1)[:, :3]
    got = {(r.query_id, r["rank"]): r.chunk_id for r in top_k_batch(rows, queries, 3).collect()}
    assert got == {(i, n + 1): j for i, found in enumerate(want.tolist()) for n, j in enumerate(found)}
    few = queries.filter("query_id < 10")
    assert sorted(top_k_batch(rows, few, 3, size=4).collect()) == sorted(top_k_batch(rows, few, 3).collect())
    assert top_k_batch(rows, queries.limit(0), 3).count() == 0


def test_answers(spark, tmp_path):
    class Echo:
        def generate(self, text):
            return f" {len(text) > 0} "

    answerer = Answerer(Retriever(_store(spark, tmp_path), PROVIDER, 2), Echo())
    said, results = answerer.answer("a cat?")
    assert said == "True" and [r["chunk_id"] for r in results] == ["c1", "c2"]
    assert answerer.answer("a cat?", filters={"tenant_id": "none"})[0] == NO_CONTEXT
    with pytest.raises(ValueError):
        answerer.answer("  ")
    out = []
    question_loop(answerer, ["", "cat\n", "quit\n", "never"], out.append)
    assert out[0] == "True" and out[1] == "c1 | Source: f.txt | Page: 1"


def test_prompt():
    text = prompt("Why?", [{"chunk_id": "c", "score": 0.5, "text": "T", "filename": "f", "page": 2, "document_id": "d", "section_path": "A", "context_id": "z"}])
    assert "Similarity score: 0.500000\nc | Source: f | Page: 2 | Document: d\n" in text and '"section_path": "A"' in text and "context_id" not in text
    assert "No context was retrieved." in prompt("Why?", [])


def test_prompts_of_a_frame(spark):
    """The same prompts as one by one, results in order of rank; a null question is an empty one."""
    rows = [(1, "Why?", 2, "b", 0.25, "B", None), (1, "Why?", 1, "a", 0.5, "A", "f"), (2, None, 1, "a", 0.5, "A", "f")]
    found = {r.id: r.prompt for r in prompts(spark.createDataFrame(rows, "id long, question string, rank int, chunk_id string, score double, text string, filename string"), ["id"]).collect()}
    a, b = ({"chunk_id": c, "score": s, "text": t, "filename": f} for c, s, t, f in (("a", 0.5, "A", "f"), ("b", 0.25, "B", None)))
    assert found == {1: prompt("Why?", [a, b]), 2: prompt("", [a])}


def test_expansion(spark):
    rows = [(1, "c1", "one", "p", "PPP"), (2, "c2", "two", "p", "PPP"), (3, "c3", "three", None, None), (4, "c4", "four", None, None)]
    got = expand_to_context(spark.createDataFrame(rows, "rank int, chunk_id string, text string, context_id string, context_text string")).orderBy("rank").collect()
    assert [(r.chunk_id, r.text, r.matched_text) for r in got] == [("c1", "PPP", "one"), ("c3", "three", None), ("c4", "four", None)]


def test_cache(spark, tmp_path):
    rows = spark.createDataFrame([(1, "cat"), (2, "dog"), (3, "cat")], "id int, text string")
    path = f"file://{tmp_path}/cache"
    out, counts = embed_cached(rows, PROVIDER, path)
    assert counts == {"misses": 2, "hits": 1} and out.count() == 3
    assert embed_cached(rows, PROVIDER, path)[1] == {"misses": 0, "hits": 3}


def test_metrics(spark):
    gold = spark.createDataFrame([("q", 0, "d", 100, 200), ("q", 1, "d", 300, 340)], "question_id string, position int, document_id string, e_start int, e_end int")
    ranked = spark.createDataFrame([("q", 1, "d", 0, 90), ("q", 2, "d", 90, 190), ("q", 3, "d", 150, 340)], "question_id string, rank int, document_id string, start int, end int")
    r = V.question_metrics(ranked, ranked, gold, [3]).first()
    assert r.precision == pytest.approx(2 / 3) and r.hit == 1 and r.reciprocal_rank == 0.5 and r.evidence_recall == 1 and r.completeness == 1 and r.context_chars == 380
    r = V.question_metrics(ranked.filter("rank < 3"), ranked.filter("rank < 3"), gold, [2]).first()
    assert r.completeness == pytest.approx(90 / 140) and r.evidence_recall == 0.5 and r.complete_answer == 0


def test_passages_are_located_in_blocks(spark):
    """More passages than a block holds, null and empty ones among them: none is lost, none raises."""
    passages = spark.createDataFrame([(0, None), (1, ""), (2, "cat"), (3, "dog"), (4, "fish"), (5, "owl"), (6, "cat")], "question_id long, passage string").coalesce(1)
    docs = spark.createDataFrame([("a", "a cat, a dog"), ("b", "owl and cat"), ("c", None)], "document_id string, text string")
    want = {(2, "a", 2, 5), (6, "a", 2, 5), (3, "a", 9, 12), (5, "b", 0, 3), (2, "b", 8, 11), (6, "b", 8, 11)}
    for limit in (1, 2, 3, 5, 10_000):
        got = [(r.question_id, r.document_id, r.e_start, r.e_end) for r in V.locate_anywhere(passages, docs, limit).collect()]
        assert set(got) == want and len(got) == len(want)
    assert V.locate_anywhere(passages.filter("question_id < 2"), docs).count() == 0


def _by_hand(chunks, items, texts, k):
    """The seven metrics of one strategy by brute force: {item: values}."""
    provider, own, out = HashProvider(512), [c for c in chunks if c.retrievable], {}
    spans = {c.chunk_id: (c.document_id, c.start, c.end) for c in chunks}
    unit = lambda rows: (v := provider.embed_batch(rows).astype(float)) / np.linalg.norm(v, axis=1, keepdims=True)
    scores = np.round(unit(list(items.values())) @ unit([c.text for c in own]).T, 12)
    for (item, passage), row in zip(items.items(), scores, strict=True):
        top = [own[j] for j in sorted(range(len(own)), key=lambda j: (-row[j], own[j].chunk_id))[:k]]
        gold = [(d, at, at + len(passage)) for d, t in texts.items() if (at := t.find(passage)) >= 0]
        shared = lambda c, g: len(set(range(c.start, c.end)) & set(range(*g[1:]))) if c.document_id == g[0] else 0
        rel = [any((n := shared(c, g)) and (n >= 0.5 * (g[2] - g[1]) or n >= 0.5 * (c.end - c.start)) for g in gold) for c in top]
        given = {spans[c.context_id] if c.context_id else (c.document_id, c.start, c.end) for c in top}
        covered = [len({x for d, a, b in given if d == g[0] for x in range(a, b)} & set(range(*g[1:]))) for g in gold]
        found = [n >= 0.8 * (g[2] - g[1]) for n, g in zip(covered, gold, strict=True)]
        told = (np.mean(found), sum(covered) / sum(b - a for _, a, b in gold), float(all(found))) if gold else (0.0, 0.0, 0.0)
        out[item] = (np.mean(rel), float(any(rel)), 1 / (rel.index(True) + 1) if any(rel) else 0.0, *told, sum(b - a for _, a, b in given))
    return out


def test_searched_metrics_rank_all_chunks(spark, tmp_path):
    rng = np.random.default_rng(3)
    words = [f"w{chr(97 + i % 26)}{i}" for i in range(60)]
    prose = lambda n: " ".join(rng.choice(words, n)) + "."
    items = {1: prose(12), 2: prose(9), 3: "held by nothing " + prose(5), 4: prose(30)}
    texts = [prose(20) + " " + " ".join(prose(8) for _ in range(12)) for _ in range(9)]
    texts[2] += " " + items[1]
    texts[5] = items[2] + " " + texts[5] + "\n\n" + items[4]
    texts[7] = texts[5]
    spark.createDataFrame([(i, t, "en", f"f{i}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    queries = __spark_entry__.queries()
    got = {(r.label, r.question_id, r.k): tuple(r)[3:] for r in queries["search_question_metrics"](spark, str(tmp_path)).collect()}
    assert set(got) == {(n, i, k) for n in C.strategies() for i in items for k in (1, 3, 5)}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumn("document_id", F.col("doc_id").cast("string"))
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("csv", "json", "markdown", "html", "docx", "txt", "pdf")]), (F.col("doc_id") % 7 + 1).cast("int"))
    for name in C.strategies():
        chunks = C.chunk(docs.withColumn("source_type", kinds), name, provider=HashProvider(512)).collect()
        for k in (1, 3, 5):
            for item, want in _by_hand(chunks, items, {str(i): t for i, t in enumerate(texts)}, k).items():
                assert got[name, item, k] == pytest.approx(want, abs=2e-6), (name, item, k)


def _tables(spark, path, texts, items):
    """documents.parquet and benchmark.parquet in a folder."""
    spark.createDataFrame([(i, t, "en", f"f{n}") for n, (i, t) in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.mark.parametrize("ids", [(1, 2, 3, 4, 5), (1, 1, None, None, 2)])
def test_words_are_counted_inside_the_row(spark, tmp_path, ids):
    """Repeated and null ids are put together as in SQL; without them nothing is aggregated by id and bucket."""
    texts = ["b a b", "a c!", "x", " x y ", "..."]
    found = __spark_entry__.queries()["hash_embedding"](spark, _tables(spark, tmp_path, zip(ids, texts, strict=True), []))
    want = Counter((i, int(HashProvider(512).embed(w)[1:].argmax()) + 1) for i, t in zip(ids, texts, strict=True) for w in t.replace("!", "").split() if w != "...")
    assert {(r.doc_id, r.bucket): r.value for r in found.collect()} == {k: float(n) for k, n in want.items()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ("Aggregate" in plan) == (len({*ids}) < len(ids))


@pytest.mark.parametrize("name", ["question_metrics", "metrics_by_strategy", "metrics_by_document", "best_by_document", "best_by_k"])
def test_passages_are_located_and_ranked_once(spark, tmp_path, monkeypatch, name):
    """What follows reads small tables, and only documents with a passage are cut."""
    texts = [(n, f"text {n} " * 90 + ("the passage held " * 3 if n % 7 == 0 else "")) for n in range(30)]
    cut, chunk = [], C.chunk
    monkeypatch.setattr(C, "chunk", lambda docs, *a, **b: cut.append(docs.count()) or chunk(docs, *a, **b))
    found = __spark_entry__.queries()[name](spark, _tables(spark, tmp_path, texts, ["the passage held", "nowhere"]))
    assert cut == [5, 5] and found.count() > 0
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["case_study_holders", "evidence_overlap", "evidence_coverage"])
def test_only_documents_with_a_passage_are_cut(spark, tmp_path, monkeypatch, name):
    texts = [(n, f"text {n} " * 90 + ("the passage held " * 3 if n % 7 == 0 else "")) for n in range(30)]
    cut, chunk = [], C.chunk
    monkeypatch.setattr(C, "chunk", lambda docs, *a, **b: cut.append(sorted(r.doc_id for r in docs.collect())) or chunk(docs, *a, **b))
    found = __spark_entry__.queries()[name](spark, _tables(spark, tmp_path, texts, ["the passage held", "nowhere"]))
    assert cut == [[0, 7, 14, 21, 28]] and found.count() > 0


def test_best_of_a_search_reads_its_ranking_only(spark, tmp_path):
    """What is best is marked on a ranking that is a table: documents are cut and located once, and not again for the result."""
    texts = [(n, f"text {n} of words. " * 40 + ("the passage held " * 3 if n == 3 else "")) for n in range(9)]
    found = __spark_entry__.queries()["search_best_by_k"](spark, _tables(spark, tmp_path, texts, ["the passage held", "nowhere"]))
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    rows = found.collect()
    assert len(rows) == 30 and all(r.is_best == (r.reciprocal_rank == max(x.reciprocal_rank for x in rows if x.k == r.k)) for r in rows)


def test_documents_that_hold_a_passage(spark):
    docs = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3"), (None, "4"), ("c", "5")], "document_id string, text string")
    gold = spark.createDataFrame([(1, "a"), (2, "a"), (1, "c"), (3, None)], "question_id int, document_id string")
    for slots in (1, 1 << 19):  # the bitmap lets others through when it is full; the join doesn't
        assert sorted(r.text for r in V.holding(docs, gold, slots).collect()) == ["1", "2", "5"]


def test_a_worker_holds_one_text_and_one_batch(monkeypatch):
    """Chunk rows leave in batches of bounded size while a batch of texts is still being read."""
    monkeypatch.setattr(C, "BATCH_CHARS", 10_000)
    texts = ["line of words\n" * n for n in (3, 4_000, 10, 3_000)]
    read = []
    plans = [("recursive", lambda text, **p: read.append(len(text)) or C.recursive(text, **p), {"chunk_size": 500, "separators": ["line", "word"]})]
    batch = pa.RecordBatch.from_pylist([{"document_id": f"d{n}", "prefix": f"d{n}", "text": t, "route": 0} for n, t in enumerate(texts)])
    sizes, before = [], []
    for out in C.cut(iter([batch]), plans):
        sizes.append(sum(map(len, out.column(3).to_pylist())))
        before.append(len(read))
    assert max(sizes) <= 10_500 and before[0] == 2 and len(read) == 4
    assert sum(sizes) == sum(p.end - p.start for t in texts for p in C.recursive(t, separators=["line", "word"]))


def test_search_ranks_where_chunks_are_made(spark):
    """One pass over the documents for all strategies, no vector leaves it, and the ranking is that of all vectors, ties among them."""
    rng = np.random.default_rng(8)
    texts = ["# Top\n\n" + " ".join(rng.choice(["cat", "dog", "fish", "owl", "Σας"[: 3 * (i % 4 == 0)] or "hen"], 150)) + "." for i in range(12)]
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate([*texts, texts[1], texts[1]])], "document_id string, text string")
    queries = spark.createDataFrame([(i, HashProvider(32).embed(q).tolist()) for i, q in enumerate(["cat", "owl hen", "top fish", "none"])], "query_id long, query array<float>")
    specs = {n: (n, {"min_chars": 0} if n == "semantic" else {}) for n in ("fixed", "structure", "parent_child", "semantic")}
    for parts, size in ((1, 10), (4, 3)):
        found = nearest(docs.repartition(parts), specs, queries, HashProvider(32), 4, size)
        got = {(r.label, r.query_id, r["rank"]): (r.chunk_id, r.context_end - r.context_start) for r in found.collect()}
        for name, (_, params) in specs.items():
            chunks = C.chunk(docs, name, params, provider=HashProvider(32))
            length = {r.chunk_id: r.end - r.start for r in chunks.collect()}
            around = {r.chunk_id: r.context_id or r.chunk_id for r in chunks.collect()}
            want = top_k_batch(embed(chunks.filter("retrievable"), HashProvider(32)), queries, 4).collect()
            assert {k[1:]: v for k, v in got.items() if k[0] == name} == {(r.query_id, r["rank"]): (r.chunk_id, length[around[r.chunk_id]]) for r in want}
    plan = nearest(docs, specs, queries, HashProvider(32), 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "embedding" not in plan


def test_experiment(spark, tmp_path):
    corpus = tmp_path / "corpus"
    corpus.mkdir()
    (corpus / "pets.txt").write_text("The cat sleeps all day on the mat. " * 5 + "The dog guards the old gate at night. " * 5)
    (tmp_path / "q.json").write_text(json.dumps({"questions": [{"id": "q1", "question": "who guards the gate", "document": "pets.txt", "evidence": ["The dog guards the old gate"]}]}))
    (tmp_path / "c.json").write_text(json.dumps({"name": "Pets", "corpus_dir": str(corpus), "questions": str(tmp_path / "q.json"), "output_dir": f"file://{tmp_path}/out", "strategies": {"small": {"strategy": "fixed", "params": {"chunk_size": 80, "overlap": 0}}, "parents": {"strategy": "parent_child", "params": {"parent_size": 200, "child_size": 60}}, "cuts": {"strategy": "semantic", "params": {"min_chars": 0}}}}))
    config = experiment.Config.read(str(tmp_path / "c.json"))
    frames = experiment.run(spark, config, HashProvider(64))
    assert {(r.label, r.k) for r in frames["summary"].collect()} == {(n, k) for n in ("small", "parents", "cuts") for k in (1, 3, 5)}
    assert all(r.hit == 1 for r in frames["summary"].filter("k = 5").collect())
    report = (tmp_path / "out" / "report.md").read_text()
    assert all(f"## {title}" in report for title in ("Setup", "Results at k = 3", "Completeness by question at k = 3", "Semantic cuts near answers", "What the metrics mean"))
    assert json.loads((tmp_path / "out" / "config.json").read_text())["strategies"]["cuts"]["params"]["threshold_type"] == "percentile"
    assert frames["boundaries"].count() > 0 and [tuple(r) for r in frames["questions_by_document"].collect()] == [("pets.txt", 1, 1)]
    with pytest.raises(ValueError):
        config.only(["none"])
    assert clip("a |  b" * 9, 8).endswith("…") and clip_left("abcdef", 4) == "…def"


def test_streaming_is_incremental(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    store = Store(spark, f"file://{tmp_path}/store")
    (folder / "a.txt").write_text("A cat.")
    for name, text, n in (("b.txt", "A dog.", 2), ("c.txt", "A fish.", 3)):
        (folder / name).write_text(text)
        stream_folder(spark, str(folder), store, PROVIDER, f"file://{tmp_path}/state").awaitTermination(120)
        assert store.count() == n


def test_plans(spark, tmp_path):
    spark.range(100).select(F.col("id").cast("string").alias("chunk_id"), (F.col("id") % 3).cast("int").alias("page"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding")).write.parquet(f"{tmp_path}/v")
    found = top_k(spark.read.parquet(f"{tmp_path}/v"), [1.0, 0.0], 3, {"page": 1})
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in text and "EqualTo(page,1)" in text and "Python" not in text
    chunks = C.chunk(spark.createDataFrame([("d", "t")], "document_id string, text string"), "fixed")
    plan = chunks._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1


def test_the_contract_is_checked_where_chunks_are_made(spark, monkeypatch):
    """Nothing but counts leaves the pass; each breach is counted, also of two documents of one id; none without documents."""
    docs = spark.createDataFrame([("d", "one two three. " * 80), ("d", "four five. " * 90), ("e", " ")], "document_id string, text string")
    plans = {n: {} for n in ("fixed", "parent_child", "sentence")}
    found = C.contract(docs, plans)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan and "Window" not in plan
    assert sorted(map(tuple, found.collect())) == [(n, 0, 0, 0) for n in sorted(plans)]
    assert sorted(map(tuple, C.contract(docs.filter("false"), plans).collect())) == [(n, 0, 0, 0) for n in sorted(plans)]
    state = C._Contract()
    state.add("x", "d", "aaa bbb, ccc", [C.Piece("chunk", 0, 0, 3), C.Piece("chunk", 2, 8, 12, lead="> "), C.Piece("section", 0, 4, 7, retrievable=False)])
    assert list(state.done()) == [("x", 1, 1, 1)]


def test_the_contract_of_routed_and_semantic_chunks(spark):
    """Rules and provider reach the pass that checks: as many labels as strategies, from one plan without joins."""
    docs = spark.createDataFrame([("a", "x, y\n1, 2\n" * 90, "csv"), ("b", "# H\n\n" + "Some text here. " * 90, "markdown"), ("c", "Plain text. " * 99, None)], "document_id string, text string, source_type string")
    found = C.contract(docs, {"metadata_aware": {}, "semantic": {}}, HashProvider(64))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan and "Window" not in plan
    got = {r.strategy: tuple(r)[1:] for r in found.collect()}
    assert got["semantic"] == (0, 0, 0) and got["metadata_aware"][0] > 0 == got["metadata_aware"][2]  # section paths stand before texts unless they are left out


def test_all_strategies_keep_the_chunk_contract(spark):
    queries = __spark_entry__.queries()
    rows = [r for q in ("chunk_contract_violations", "chunk_contract_violations_provided") for r in queries[q](spark, "/root/testdata/sf0.001").collect()]
    assert sorted(r.strategy for r in rows) == C.strategies()
    assert all(tuple(r)[1:] == (0, 0, 0) for r in rows), rows


def test_settings(tmp_path):
    (tmp_path / "s.json").write_text('{"top_k": 3, "strategy": "sentence", "params": {"max_chars": 300}}')
    found = Settings.read(str(tmp_path / "s.json"), {"QUILLSPARK_TOP_K": "7", "QUILLSPARK_PROVIDER": "remote", "QUILLSPARK_CHAT_MODEL": "m"})
    assert (found.top_k, found.strategy, found.params, found.provider) == (7, "sentence", {"max_chars": 300}, "remote")
    assert json.loads(found.record())["chat_model"] == "m" and Settings.read(None, {}) == Settings()
    (tmp_path / "s.json").write_text('{"topk": 3}')
    with pytest.raises(ValueError, match="topk"):
        Settings.read(str(tmp_path / "s.json"), {})
    provider, llm = models(found)
    assert type(provider).__name__ == "RemoteProvider" and type(llm).__name__ == "RemoteLLM"
    assert [type(x).__name__ for x in models(found, offline=True)] == ["HashProvider", "Quote"]


def test_hosted_model_and_batches(spark):
    calls = []

    class Client:
        class chat:
            class completions:
                @staticmethod
                def create(model, messages, temperature):
                    calls.append((model, messages[0]["content"]))
                    return SimpleNamespace(choices=[SimpleNamespace(message=SimpleNamespace(content=" said "))])

    assert RemoteLLM("m", Client()).generate("why?") == "said" and calls == [("m", "why?")]
    prompts = spark.createDataFrame([(1, "Text:\nfirst\n\nrest"), (2, None)], "id long, prompt string")
    assert {r.id: r.answer for r in generate_all(prompts, Quote()).collect()} == {1: "first", 2: None}


def test_index_with_a_cache_sends_each_text_once(spark, tmp_path):
    docs = spark.createDataFrame([("t", f"f{i}.txt", f"h{i}-1", f"the cat {i}", f"f{i}.txt") for i in range(3)], "tenant_id string, filename string, document_id string, text string, source string")
    cache = f"file://{tmp_path}/cache"
    for name in ("a", "b"):
        store = Store(spark, f"file://{tmp_path}/{name}")
        index(store, docs, PROVIDER, cache=cache).unpersist()
        assert store.count() == 3
    assert spark.read.parquet(cache).count() == 3


def test_semantic_boundaries_as_rows(spark):
    text = "The cat sat. A cat ran. One cat slept. The dog barked. A dog dug. One dog ate."
    docs = spark.createDataFrame([("d", text), ("e", " "), ("f", None)], "document_id string, text string")
    rows = C.semantic_boundaries(docs, KeywordProvider(["cat", "dog"]), {"buffer_size": 0, "breakpoint_threshold": 80.0}).orderBy("idx").collect()
    assert [r.cut for r in rows] == [False, False, True, False, False, False] and rows[-1].distance is None
    gold = spark.createDataFrame([(1, 1, "d", 60, 70)], "question_id int, position int, document_id string, e_start int, e_end int")
    near = V.boundaries_near(spark.createDataFrame(rows), gold, 1).collect()
    assert sorted(r.idx for r in near) == [3, 4, 5]


def test_entry_and_registration(spark):
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert __spark_entry__.entry(spark).count() == 5
