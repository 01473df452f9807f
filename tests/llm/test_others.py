"""Media, quality, mixing, WARC, licenses, chats and vectors on small fixtures."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import buckets, chat, licenses, media, mixing, quality, topics, vectors, warc
from quillspark.llm.lattice import LatticeHash, decode

TEXTS = [None, "", "a", "x" * 64, "é\x00ÿ" * 77, "hello world " * 900, "ÿ" * 8192 * 40, "same", "same"]


def test_media_keeps_every_byte(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("feature", F.lit(1))
    got = {r.doc_id: r for r in media.media_columns(docs, with_media=True).collect()}
    for i, text in enumerate(TEXTS):
        raw = (text or "").encode()
        payload = media.pad(raw)
        assert len(payload) % 64 == 0 and len(payload) >= 64
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest() and re.fullmatch(r"\d+x\d+:[0-9a-f]{16}", r.feature)
    assert got[7].media == got[8].media
    assert media.media_columns(docs.limit(0)).count() == 0


def test_jpeg_of_several_components():
    """A hand-made colour scan with subsampling, zero runs, and one restart interval against a plain decoder."""
    rng = np.random.default_rng(4)
    parts = ((2, 1, 0, 0, 0), (1, 1, 0, 0, 0), (1, 1, 0, 0, 0))
    lengths_ac = {0x00: 3, 0x11: 3, 0x02: 3, 0xF0: 4, 0x01: 3, 0x23: 3}
    dc, ac = media.canonical(media.DC_LENGTHS), media.canonical(lengths_ac)
    blocks = np.zeros((3 * 2 * 4, 64), int)
    for b in blocks:
        b[0] = rng.integers(-200, 200)
        k = 1
        for run, size in ((1, 1), (0, 2), (2, 3), (16, 1)):
            k += run
            if run == 16:
                k += 1
            v = int(rng.integers(1 << (size - 1), 1 << size)) * (1 if rng.random() < 0.5 else -1)
            if run == 16:  # one long run, then a coefficient of run 1
                b[k] = v
            else:
                b[k] = v
            k += 1
    bits, out, before = "", bytearray(), [0, 0, 0]

    def put(code, value, size):
        nonlocal bits
        bits += format(code[0], f"0{code[1]}b")
        if size:
            bits += format(value if value > 0 else value + (1 << size) - 1, f"0{size}b")

    units = [0, 0, 1, 2]
    for n, b in enumerate(blocks):
        c = units[n % 4]
        diff = int(b[0]) - before[c]
        before[c] = int(b[0])
        put(dc[abs(diff).bit_length()], diff, abs(diff).bit_length())
        zeros = 0
        for v in b[1:].tolist():
            if v == 0:
                zeros += 1
                continue
            while zeros > 15:
                put(ac[0xF0], 0, 0)
                zeros -= 16
            key = zeros * 16 + abs(v).bit_length()
            put(ac[key], v, abs(v).bit_length())
            zeros = 0
        if zeros:
            put(ac[0x00], 0, 0)
        if n % 8 == 7 or n == len(blocks) - 1:
            bits += "1" * (-len(bits) % 8)
            out += bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
            bits, before = "", [0, 0, 0]
            out += b"" if n == len(blocks) - 1 else bytes([0xFF, 0xD0 + (n // 8) % 8])
    frame = b"".join([b"\xff\xd8", media.segment(0xDB, b"\x00" + b"\x02" * 64), media.segment(0xC0, bytes([8, 0, 16, 0, 48, 3, 1, 0x21, 0, 2, 0x11, 0, 3, 0x11, 0])), media.segment(0xC4, media.dht(0, media.DC_LENGTHS) + media.dht(0x10, lengths_ac)), media.segment(0xDD, b"\x00\x02"), media.segment(0xDA, b"\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00"), bytes(out), b"\xff\xd9"])
    head, got = media.read_jpegs([frame])[0]
    assert head.parts == parts and (got == blocks).all()
    thumb = media.thumbnail(head, got)
    assert thumb.shape == (2, 6)
    assert thumb[0, 0] == np.clip(np.rint(blocks[0, 0] * 2 / 8 + 128), 0, 255)
    with pytest.raises(ValueError):
        media.parse(b"nothing")


def test_thumbnail_hash_reads_every_point():
    thumb = np.random.default_rng(2).integers(0, 256, (21, 30)).astype(np.uint8)
    edge = lambda i, n: slice(i * n // 8, (i + 1) * n // 8)
    want = [[thumb[edge(i, 21), edge(j, 30)].mean() > thumb.mean() for j in range(8)] for i in range(8)]
    assert media.thumbnail_hash(thumb) == np.packbits(np.ravel(want)).tobytes().hex()
    dark = np.zeros((40, 40), np.uint8)
    bright = dark.copy()
    bright[3::5, 4::5] = 255  # no point that opens an area
    bright[:20] = 0
    assert media.thumbnail_hash(dark) == "0" * 16 and media.thumbnail_hash(bright) == "0" * 8 + "f" * 8
    assert len(media.thumbnail_hash(np.array([[0, 9, 9]], np.uint8))) == 16


def test_quality_learns_and_scores_all(spark, words):
    rows = []
    for i in range(300):
        bad = i % 3 == 0
        text = " ".join(w.upper() + "!!" if bad else w for w in words(i, 30))
        rows.append((i, text, "en", 0 if bad else 1))
    docs = spark.createDataFrame([r[:3] for r in rows] + [(900, None, None), (901, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(r[0], r[3], 0) for r in rows[:250]] + [(0, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == 302 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [r for i, r in got.items() if r.held_out and i < 300]
    assert np.mean([r.predicted == (r.doc_id % 3 != 0) for r in held]) > 0.95
    again = {r.doc_id: r.score for r in quality.classify(docs.repartition(3), labels.repartition(2)).collect()}
    assert again == {i: r.score for i, r in got.items()}
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_quality_learns_from_every_labelled_text(spark, words):
    """Long texts are learnt from whole, and rows beyond one block count."""
    rows = [(i, " ".join(w.upper() + "!!" if i % 4 == 0 else w for w in words(i, 7000 if i % 4 == 0 else 20)), int(i % 4 != 0)) for i in range(120)]
    assert min(len(r[1]) for r in rows if not r[2]) > 50_000
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, label int").drop("label"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    for p in (quality.Params(), quality.Params(block_rows=20, merges=8)):
        got = {r.doc_id: r for r in quality.classify(docs, labels, p).collect()}
        assert np.mean([got[i].predicted == label for i, _, label in rows if got[i].held_out]) > 0.95
        again = {r.doc_id: r.score for r in quality.classify(docs.repartition(3), labels, p).collect()}
        assert again == {i: r.score for i, r in got.items()}


def test_neighbours_against_plain_loops(spark):
    p = quality.Params(buckets=97)
    texts = [list(np.random.default_rng(i).integers(0, 97, n)) for i, n in enumerate((0, 1, 3, 200, 20_003, 45_000))]
    index = quality.index_vectors(p)
    want = np.zeros((97, p.size))
    for ids in texts:
        for step in range(1, 2 * p.window + 1):
            np.add.at(want, ids[step:], np.sign(index)[ids[:-step]])
            np.add.at(want, ids[:-step], np.sign(index)[ids[step:]])
    rows = spark.createDataFrame([(bytearray(np.array(t, np.uint16).tobytes()),) for t in texts], "ids binary")
    want = index + want / np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    assert np.abs(quality.word_vectors(rows, p) - want).max() < 1e-6


def plain_raking(rows, budget, powers, targets, blend):
    """Probabilities of (source, lang, topic, tokens) by plain loops, for given shares of the targets."""
    total = sum(r[3] for r in rows)
    wants = []
    for m, power in enumerate(powers):
        own = {}
        for r in rows:
            own[r[m]] = own.get(r[m], 0) + r[3]
        raised = {v: targets[m].get(v, 0) if targets[m] else t**power for v, t in own.items()}
        scale = 1.0
        for _ in range(len(own) + 1):  # what a value can't give goes to the others
            share = {v: raised[v] / sum(raised.values()) * budget * total * scale for v in own}
            full = sum(own[v] for v in own if share[v] > own[v])
            rest = sum(share[v] / scale for v in own if share[v] <= own[v])
            scale = max(scale, (budget * total - full) / rest if rest else scale)
        wants.append({v: blend * min(own[v], share[v]) + (1 - blend) * budget * own[v] for v in own})
    p, mark = [budget] * len(rows), float("inf")
    for n in range(mixing.SWEEPS):
        for m in range(3):
            now = {}
            for r, q in zip(rows, p, strict=True):
                now[r[m]] = now.get(r[m], 0) + r[3] * q
            p = [min(1.0, q * wants[m][r[m]] / now[r[m]]) for r, q in zip(rows, p, strict=True)]
        off = 0
        for m in range(3):
            for v in wants[m]:
                off = max(off, abs(sum(r[3] * q for r, q in zip(rows, p, strict=True) if r[m] == v) - wants[m][v]))
        if off / (budget * total) < mixing.TOLERANCE:
            return p, True
        if n % 10 == 9:
            if off > mark / 2:
                return p, False
            mark = off
    return p, False


TOKENS = [32, 21, 5, 20, 2, 1, 46, 52]


@pytest.mark.parametrize(
    ("budget", "powers", "targets", "all_met"),
    [
        (0.3, (0.5, 0.5, 0.5), {}, True),
        (0.7, (0.5, 0.5, 0.5), {}, True),
        (0.7, (1.0, 1.0, 1.0), {"lang": {"l0": 0.9, "l1": 0.1}}, False),
        (0.5, (0.0, 0.2, 1.0), {"source": {"s0": 0.2, "s1": 0.8, "absent": 3.0}}, False),
    ],
)
def test_raking_against_plain_loops(spark, budget, powers, targets, all_met):
    """With capped cells, and with targets that have to be projected."""
    cells = [(f"s{i // 4}", f"l{i // 2 % 2}", f"t{i % 2}", n) for i, n in enumerate(TOKENS)]
    rows = [(i, "w " * c[3], *c[:3]) for i, c in enumerate(cells)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, t string")
    given = [targets.get(m) for m in mixing.MARGINS]
    blend = 1.0 if plain_raking(cells, budget, powers, given, 1.0)[1] else max(k / 2**mixing.HALVINGS for k in range(2**mixing.HALVINGS) if plain_raking(cells, budget, powers, given, k / 2**mixing.HALVINGS)[1])
    want, _ = plain_raking(cells, budget, powers, given, blend)
    for local_cells in (100, 1) if budget == 0.3 else (100,):
        mixed, report = mixing.mix_and_report(docs, budget, powers, targets, topic=F.col("t"), local_cells=local_cells)
        got = {r.doc_id: r for r in mixed.collect()}
        assert max(abs(got[i].prob - w) for i, w in enumerate(want)) < 1e-9
        assert {r.blend for r in got.values()} == {blend} and (blend == 1) == all_met
        for r in report.collect():
            assert r.reached == pytest.approx(r.feasible, abs=0.01 * budget * sum(TOKENS)) and r.feasible <= r.tokens + 1e-9
        sums = {m: sum(r.reached for r in report.collect() if r.margin == m) for m in mixing.MARGINS}
        assert all(s == pytest.approx(budget * sum(TOKENS), rel=1e-4) for s in sums.values())


def test_cells_as_frames_rake_alike(spark):
    """The same sweeps by numpy and by DataFrames where targets are cut, capped and out of reach."""
    rows = [(f"s{i // 4}", f"l{i // 2 % 2}", f"t{i % 2}", float(n)) for i, n in enumerate(TOKENS)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens double")
    powers, targets = (0.0, 0.2, 1.0), {"source": {"s0": 0.9, "s1": 0.1, "absent": 3.0}}
    held = mixing._Held(cells.toArrow(), powers, 0.6, targets)
    frames = mixing._Frames(cells, powers, 0.6, targets)
    for c in (held, frames):
        c.begin(0.75)
    for _ in range(3):
        assert held.sweep() == pytest.approx(frames.sweep(), rel=1e-9)
    one, two = ({tuple(r[:4]): r[4:] for r in t} for t in (map(tuple, spark.createDataFrame(held.table(0.75)).collect()), map(tuple, frames.table(0.75).collect())))
    assert one.keys() == two.keys() and all(a == pytest.approx(b, rel=1e-9) if a is not None else b is None for k in one for a, b in zip(one[k], two[k], strict=True))


def test_mixing(spark):
    rows = [(i, "w " * (5 + i % 7), "src0" if i % 3 else f"src{i % 5}", None if i % 11 == 0 else "en" if i % 2 else "fr") for i in range(4000)] + [(9999, None, None, None), (None, "a b", "src0", "en"), (None, "", "src0", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumns({"prob": F.lit("clash"), "Topic": F.lit("mine")})
    targets = {"lang": {"en": 0.4, "fr": 0.5, mixing.MISSING: 0.1}}
    mixed, report = mixing.mix_and_report(docs, 0.3, (0.5, 1.0, 1.0), targets)
    got, shares = mixed.collect(), {r.value: r for r in report.filter("margin = 'lang'").collect()}
    whole = sum(r.tokens for r in shares.values()) * 0.3
    assert {c.lower() for c in mixed.columns} == {"doc_id", "text", "source", "lang", "n_tokens", "topic", "prob", "weight", "keep", "blend"}
    assert len(got) == 4003 and all(r.n_tokens == len((r.text or "").split()) for r in got)
    for value, share in targets["lang"].items():
        assert shares[value].reached / whole == pytest.approx(share, abs=1e-4)
        sampled = sum(r.n_tokens for r in got if r.keep and (r.lang or mixing.MISSING) == value)
        assert sampled / shares[value].reached == pytest.approx(1, abs=0.15)
    kept = mixing.sample(docs, budget=0.3, powers=(0.5, 1.0, 1.0), targets=targets)
    assert kept.columns == docs.columns and {r.Topic for r in kept.collect()} == {"mine"}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.keep)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.sample(docs.limit(0)).count() == 0


def test_topics_are_clusters_of_words(spark, words):
    kinds = [words(10 * k, 40) for k in range(3)]
    rows = [(i, " ".join(np.random.default_rng(i).choice(kinds[i % 3], 30))) for i in range(90)] + [(900, None), (901, " \t"), (902, " ".join(kinds[0] * 3000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    read = lambda d: {r.doc_id: r.topic for r in topics.read_topics(d, topics.Params(topics=3, max_chars=5000), "doc_id", "text", ["doc_id"], "n", "topic").collect()}
    got = read(docs)
    assert got[900] == got[901] == topics.NONE and got[902] == got[0]
    assert [len({got[i] for i in range(k, 90, 3)}) for k in range(3)] == [1, 1, 1] and len(set(got.values())) == 4
    assert read(docs.repartition(5)) == got


def test_topics_are_fitted_on_all_documents(spark, words):
    """A kind of text that only long documents have gets a topic of its own, and the centres are those of all documents' vectors."""
    kinds = [words(10 * k, 40) for k in range(3)]
    rows = [(i, " ".join(np.random.default_rng(i).choice(kinds[2 if i % 30 == 0 else i % 2], 600 if i % 30 == 0 else 30))) for i in range(300)]
    docs, p = spark.createDataFrame(rows, "doc_id long, text string"), topics.Params(topics=3, max_chars=400)
    bags = topics.count(docs, p, "doc_id", "text", ["doc_id", "text"], "n")
    vectors, centres = topics.fit(bags, p)
    got = {r.doc_id: r.topic for r in topics.assign(bags, (vectors, centres), p, ["doc_id"], "topic").collect()}
    assert len({got[i] for i in range(0, 300, 30)}) == 1 and got[0] not in {got[i] for i in range(300) if i % 30}
    held = Counter(w for _, t in rows for w in {topics._Known(p.buckets)[w.encode()] for w in t.split()})
    assert all(np.abs(vectors[b]).max() == np.rint(np.log(301 / (1 + n)) * topics.WEIGHT) for b, n in held.items())
    counts = [Counter(topics._Known(p.buckets)[w.encode()] for w in t.split()) for _, t in rows]
    x = topics.unit(np.stack([sum(n * vectors[b] for b, n in c.items()) for c in counts]))
    own = (x @ centres.T).argmax(1)
    assert [f"topic-{t}" for t in own] == [got[i] for i in range(300)]
    assert np.array_equal(topics.unit(np.stack([x[own == k].sum(0) for k in range(3)])), centres)
    assert all(r.n == len(r.text.split()) for r in bags.collect())


def test_warc_roundtrip(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE", 700)
    fake = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    html = ["<p>a</p>", "<p>a</p>", "<p>a</p>", fake * 9, "", None, "é" * 900, "WARC/1.0\r\nContent-Length: 99999\r\n\r\n", fake + "\r\n\r\n", "\r\n\r\n"]
    rows = [(i, f"http://x/{i}\r\ny" if i % 2 else None, h, "z") for i, h in enumerate(html)] + [(None, "u", "<p>a</p>", "z"), (50, "u", "x" * 5000, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    for least in (0, 1):
        got = {r.page_id: r for r in warc.roundtrip(pages, least).collect()}
        assert len(got) == len(rows)
        for i, _, h, _ in rows:
            raw = (h or "").encode()
            same = [j for j, _, o, _ in rows if (o or "") == (h or "") and j is not None]
            first = max(same) if same and len(raw) >= least else i
            r = got[i]
            assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
            assert (r.record_type, r.refers_to) == (("response", None) if i == first else ("revisit", first))
            assert r.payload == (raw if i == first else None)
        monkeypatch.setattr(warc, "OVERLAP", 400)  # so that blocks reach beyond what a range holds
        short = warc.roundtrip(pages, least, with_payload=False).drop("payload").collect()
        assert sorted(map(tuple, short), key=str) == sorted((tuple(r)[:5] for r in got.values()), key=str)
    assert warc.roundtrip(pages.limit(0)).count() == 0


def test_long_headers_and_large_files(spark, monkeypatch, tmp_path):
    rows = [(1, "http://x/" + "a" * 70_000, "short"), (2, "http://x/" + "b" * 3_000_000, "x" * 2_500_000 + "WARC/1.0\r\n" * 3), (3, None, "short"), (4, "u" * 70_000, "short")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1)
    got = {r.page_id: r for r in warc.roundtrip(pages).collect()}
    assert {i: bytes(r.payload).decode() for i, r in got.items() if r.payload} == {2: rows[1][2], 4: "short"}
    assert {i: r.refers_to for i, r in got.items()} == {1: 4, 2: None, 3: 4, 4: None}
    monkeypatch.setattr(warc, "FILE_BYTES", 1_000_000)  # about one record a file
    warc.write_archives(spark.createDataFrame([(i, "u", "y" * 400_000 + str(i)) for i in range(6)], "page_id long, url string, html string").repartition(1), f"file://{tmp_path}/w")
    assert max(f.stat().st_size for f in (tmp_path / "w").glob("*.txt")) < 1_000_000
    assert warc.read_archives(spark, f"file://{tmp_path}/w").count() == 6


def test_a_broken_chain_is_an_error(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"WARC/1.0\r\nContent-Length: 2\r\n\r\nhi\r\n\r\nnoise")
    with pytest.raises(Exception, match="no record at"):
        warc.read_archives(spark, f"file://{tmp_path}").collect()


def test_pointer_jumping():
    at, following = np.array([0, 10, 15, 30]), np.array([10, 30, 99, 60])
    assert warc.follow(at, following, 50).tolist() == [60, 60, 99, 60]
    assert warc.follow(np.array([0, 10]), np.array([12, 20]), 15).tolist() == [-1, 20]


def test_licenses(spark):
    texts = [None, "", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0 (the 'License')", "MIT license mit LICENSE", "licensed under CC BY-NC 4.0", "Copyright (c) 2020 Ann Lee. All rights reserved.", "This work is licensed under the GNU General Public License, version 3.", "cc  by é cc-by", "permission is hereby granted, free of charge" * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("labels", F.lit(1))
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    for i, text in enumerate(texts):
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        places = sorted((at, label) for p, label in licenses.PHRASES.items() for at in range(len(words)) if words[at : at + len(p.split())] == p.split())
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None)
        assert r.base_labels == ",".join(sorted({p[1] for p in places})) and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert [got[i].labels for i in (2, 3, 5, 6, 7)] == ["mit,mit-notice", "apache,apache-2.0-notice", "cc-by,cc-by-notice", "all-rights-reserved", "gpl,gpl-notice"]
    assert got[4].score == 0.5 and got[2].score == 1.0 and got[9].score == 0.0


def said_by(template: str) -> str:
    """A text that a template accepts: optional regions left out, one word for each variable region."""
    return re.sub(r"<<var[^>]*>>", "anyone", re.sub(r"<<beginOptional>>.*?<<endOptional>>", "", template))


def test_whole_wording_is_mandatory():
    scanner = licenses.Scanner({}, licenses.TEMPLATES)
    labels = lambda t: {m[0] for m in scanner.scan(t)[3]}
    whole = {"mit-text", "bsd-2-text", "bsd-3-text", "isc-text", "apache-2.0-header", "gpl-header"}
    for label, template in licenses.TEMPLATES:
        text = said_by(template)
        words = text.split()
        assert label in labels(f"Copyright 2020 Ann\n{text}\nfoo") and label in labels(text.upper())
        if label in whole:
            assert label not in labels(" ".join(words[: len(words) * 2 // 3]))  # the disclaimer is gone
            for at in range(0, len(words), 7):
                if words[at].strip('("),.;:') not in ("anyone", ""):
                    assert label not in labels(" ".join([*words[:at], "changed", *words[at + 1 :]])), (label, words[at])
    two, three = (said_by(t) for name, t in licenses.TEMPLATES if name in ("bsd-2-text", "bsd-3-text"))
    assert labels(two) == {"bsd-2-text"} and labels(three) == {"bsd-3-text"}


def test_automaton_against_plain_patterns():
    """Every window of random texts against the same markup as a regular expression over words."""
    rng = np.random.default_rng(8)
    templates = {
        "a b <<beginOptional>>c <<beginOptional>>a <<endOptional>><<endOptional>>b": "a b (?:c (?:a )?)?b ",
        "<<beginOptional>>a <<endOptional>>b <<var;max=2>> c": "(?:a )?b (?:[abc] ){0,2}c ",
        "a <<var;min=1;max=3>> a <<beginOptional>>b<<endOptional>>": "a (?:[abc] ){1,3}a (?:b )?",
        "b c <<beginOptional>><<var;min=1;max=1>> a <<endOptional>>": "b c (?:[abc] a )?",
    }
    for template, plain in templates.items():
        pattern = re.compile(plain)
        automaton = licenses.Automaton("x", template)
        for _ in range(300):
            words = [str(w) for w in rng.choice(list("abc"), 8)]
            for at in range(len(words)):
                ends = [n for n in range(at, len(words) + 1) if pattern.fullmatch("".join(f"{w} " for w in words[at:n]))]
                got = automaton.match([w.encode() for w in words], at)
                assert (got or at) == max(ends, default=at), (template, words, at)


def test_automaton_wants_exact_wording():
    a = licenses.Automaton("x", "one <<beginOptional>>two <<var;min=1;max=2>> <<endOptional>>three")
    words = lambda t: licenses.words_of(t)
    assert a.match(words("one three"), 0) == 2 and a.match(words("one two p three"), 0) == 4 and a.match(words("one two p q three four"), 0) == 5
    assert a.match(words("one two three"), 0) is None and a.match(words("one p three"), 0) is None
    with pytest.raises(ValueError):
        licenses.Automaton("x", "one <<beginOptional>>two")


def test_chat_rotation(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi <|end|>"), (1, 2, "bob", "Yo"), (1, 3, "ann", None), (1, 3, "ann", None), (1, 70, None, "late"), (2, 0, "system", "only"), (None, None, "cy", "é🙂")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash"))
    got = {(r.conv_id, r.perspective, r.run): r for r in chat.render_perspectives(turns).collect()}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (1, "unknown", 1), (None, "cy", None)}
    r = got[1, "ann", 0]
    assert r.rendered == "<|system|>\nBe kind.<|end|>\n<|assistant|>\nHi <\\|end|><|end|>\n<|user name=bob|>\nYo<|end|>\n<|assistant|>\n<|end|>\n"
    assert [r.rendered[m["first"] : m["end"]] for m in r.mask] == ["Hi <\\|end|><|end|>\n", "<|end|>\n"] and (r.n_rows, r.n_messages, r.n_trained) == (5, 4, 2)
    every = {(r.conv_id, r.perspective, r.run): r for r in chat.render_perspectives(turns, silent=True).collect()}
    assert set(every) == {(1, p, w) for p in ("ann", "bob", "unknown") for w in (0, 1)} | {(None, "cy", None)}
    assert every[1, "ann", 1].mask == [] and every[1, "unknown", 1] == got[1, "unknown", 1]
    assert chat.render_perspectives(turns.limit(0)).count() == 0


def test_a_turn_of_any_size_and_roles_of_any_name(spark):
    rows = [(1, None, f"r{i % 3}", f"text {i}") for i in range(3000)] + [(1, 5, "x", f"t{i}") for i in range(500)]
    names = ["a<|b", "a< |b", "a<\\|b", "x|>\nevil", "x|>\\nevil", "system|>", ""]
    rows += [(2, i, n, n) for i, n in enumerate(names)]
    got = chat.render_perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert max(r.n_messages for r in got) <= chat.WINDOW and max(len(r.rendered) for r in got) < 3000
    said = [r.rendered[m["first"] : m["end"] - len(chat.END)] for r in got if r.conv_id == 1 for m in r.mask]
    assert sorted(said) == sorted(r[3] for r in rows if r[0] == 1)  # each message is trained on once, by its speaker
    two = {r.perspective: r for r in got if r.conv_id == 2}
    assert set(two) == set(names) and all(r.n_trained == 1 and r.rendered.count("\n<|user name=") + r.rendered.startswith("<|user name=") == len(names) - 1 for r in two.values())
    heads = [h.split("|>\n")[0] for h in two[""].rendered.split("<|user name=")[1:]]
    assert [chat.unescape(h) for h in heads] == names[:-1]


def test_lattice_decoding():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8)) * 1.3
    best, spare, gap = decode(x)
    for points in (best, spare):
        assert ((points % 2 == 0).all(1) | (points % 2 == 1).all(1)).all() and (points.sum(1) % 4 == 0).all()
    assert (((x - best / 2) ** 2).sum(1) <= 1 + 1e-9).all() and (gap >= -1e-9).all() and (best != spare).any(1).all()
    assert LatticeHash(8, 2, 1, 1.0, 1).keys(x).shape == (400, 2, 2)


def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(buckets, "SMALL", 4)
    monkeypatch.setattr(buckets, "BLOCK", 32)
    monkeypatch.setattr(vectors, "BLOCK", 32)
    rng = np.random.default_rng(9)
    rows: list = []
    for size, spread in ((90, 0.03), (7, 0.05), (30, 0.055), (1, 0.1), (40, 0.0)):
        center = rng.normal(size=48)
        center /= np.linalg.norm(center)
        rows += [(center + rng.normal(size=48) * spread).astype(np.float32).tolist() for _ in range(size)]
    rows += [v.astype(np.float32).tolist() for v in rng.normal(size=(200, 48))]
    odd = [None, [], [0.0] * 48, [float("nan")] * 48, [1.0] * 47 + [None], [float("inf")] * 48, [1.0, 2.0], [2.0, 4.0]]
    table = spark.createDataFrame([(i, v, i % 3) for i, v in enumerate(rows + odd)], "vec_id long, embedding array<float>, label int").withColumn("id", F.lit(1)).repartition(3)
    got = {r.vec_id: r for r in vectors.near_vectors(table).collect()}
    x = np.array(rows, float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    up = list(range(len(rows)))
    for _ in range(len(rows)):
        new = [min([up[i], *(up[j] for j in np.flatnonzero(near[i]))]) for i in range(len(rows))]
        if new == up:
            break
        up = new
    recall = sum(got[i].n_links for i in range(len(rows))) / near.sum()
    assert recall >= 0.99 and all(got[i].n_links <= near[i].sum() for i in range(len(rows)))
    assert sum(got[i].component_id == up[i] for i in range(len(rows))) >= 0.99 * len(rows)
    n = len(rows)
    assert [(got[n + k].n_links, got[n + k].component_id) for k in range(8)] == [(0, n + k) for k in range(6)] + [(1, n + 6), (1, n + 6)]
    assert vectors.near_vectors(table.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path, words):
    import corpus_pipeline

    rows = []
    for i in range(200):
        bad = i % 5 == 0
        text = " ".join(w.upper() + "!!" if bad else w for w in words(i // 2 if i % 2 else i, 60))
        rows.append((i, text, "en" if i % 3 else "fr", f"src{i % 4}", len(text)))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, docs, str(tmp_path))
        assert n == 3 or after.columns == docs.columns
        after.write.parquet(f"{tmp_path}/{n}")
        after = spark.read.parquet(f"{tmp_path}/{n}")
        assert 0 < after.count() <= docs.count()
        docs = after
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, docs.collect()))
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES])


def test_pipeline_stages_on_odd_tables(spark, tmp_path, words):
    """Nulls in every column, empty and very long texts, repeated rows and ids, clashing columns, empty tables."""
    import corpus_pipeline

    own = ["topic", "Weight", "keep", "prob", "n_tokens", "score", "predicted", "row", "id", "component", "__row", "blend"]
    text = lambda i: " ".join(words(i, 40))
    rows = [(i, text(i), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(None, text(100), None, None, None), (None, text(3), "en", "s0", 1), (None, None, None, None, None), (70, None, "en", None, 0), (70, None, "en", None, 0), (71, "", None, "s1", 0), (72, " \t", "en", "s1", 2)]
    rows += [(80, text(200), "en", "s1", 1)] * 3 + [(81, text(201), "en", "s1", 1), (81, text(202), "en", "s1", 1), (82, " ".join(words(7, 150_000)), "en", "s2", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).withColumns({c: F.lit(f"own {c}") for c in own})
    spark.createDataFrame([(i, int(i % 2), None) for i in range(40)] + [(None, 1, 0), (5, None, 1), (80, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    key = lambda frame: sorted((tuple(r) for r in frame.collect()), key=str)
    before = Counter(map(tuple, docs.collect()))
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, docs, str(tmp_path))
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        again = key(stage(spark, docs.repartition(3), str(tmp_path)))
        assert key(after) == again, name
        if n < 3:
            assert after.columns == docs.columns and not Counter(map(tuple, after.collect())) - before
    kept = corpus_pipeline.STAGES[1][1](spark, docs, str(tmp_path)).collect()
    ids = Counter(r.doc_id for r in kept)
    assert all(ids[i] == 1 for i in (*range(60), 70, 71, 72, 80, 82)) and ids[81] == 2
    assert sorted(str(r.text)[:20] for r in kept if r.doc_id is None) == sorted([text(100)[:20], "None"])
