"""Kernels without Spark: expected spans of our own texts."""

from __future__ import annotations

import numpy as np
import pytest

from quillspark.functions import semantic as M
from quillspark.functions import spans as S
from quillspark.functions import structure as B
from quillspark.functions.embedding import HashProvider, KeywordProvider, RemoteProvider, Words, check_vectors, cosine_similarity
from quillspark.functions.tokens import WordPieces, budget, token_spans
from quillspark.operators import chunking as C

GUIDE = "# Garden\n\nTools are in the shed.\n\n## Beds\n\n- peas\n- beans\n\n| crop | month |\n| peas | May |\n\n```\ndig()\n```\n"
LONG = " ".join(f"Row {n} has seeds of kind {n}." for n in range(60))
TEXTS = {"guide": GUIDE, "long": LONG, "unicode": "Çà et là, l'été. 日本語の文。 Fin 🙂 ok.", "short": "Hello", "huge": "x" * 1200, "gaps": "One line\n\n\n\nother line"}


def said(text, spans):
    return [text[a:b] for a, b in spans]


def test_squeeze_and_between():
    assert S.squeeze("  a b ", 0, 6) == (2, 5)
    assert S.squeeze("   ", 0, 3) is None
    assert said("a, b,,c", S.between("a, b,,c", 0, 7, ",")) == ["a", "b", "c"]
    assert said("ab", S.between("ab", 0, 2, "x*")) == ["ab"]


def test_pack_keeps_long_spans_and_may_repeat_inside_overlap():
    assert S.pack([(0, 5), (6, 11), (12, 22)], 11, 5) == [(0, 11), (6, 11), (12, 22)]
    assert S.pack([(0, 50), (51, 60)], 10) == [(0, 50), (51, 60)]
    assert S.pack([], 10) == []


def test_sentences():
    text = 'Dr. Hay met J. Fox at 5 p.m. today. "Good." They\nleft early.\n- a point\nNext Line\n\nlast one'
    assert said(text, S.sentences(text)) == ["Dr. Hay met J. Fox at 5 p.m. today.", '"Good.', "They\nleft early.", "- a point", "Next Line", "last one"]


def test_recursive_falls_back_to_characters():
    assert [b - a for a, b in S.recursive("x" * 1200, 0, 1200, 500)] == [500, 500, 200]
    assert S.recursive(" short ", 0, 7, 50) == [(0, 7)]


def test_sentence_windows_shrink_their_overlap():
    text = "Aaaa bbbb. Cccc dddd. Eeee ffff gggg hhhh."
    got = [text[p.start : p.end] for p in C.sentence(text, max_chars=22, overlap_sentences=1)]
    assert got[0] == "Aaaa bbbb. Cccc dddd."
    assert all(len(g) <= 22 for g in got)


def test_blocks():
    kinds = [b.kind for b in B.blocks(GUIDE)]
    assert kinds == ["heading", "paragraph", "heading", "list", "table", "code"]
    assert [p.path for p in B.Outline(GUIDE).parts] == [("Garden",), ("Garden", "Beds")]
    assert [b.kind for b in B.blocks("Title\n=====\nbody\n~~~\nopen")] == ["heading", "paragraph", "code"]
    assert [b.kind for b in B.blocks("Annual Leave\nEveryone gets some days off each year.")] == ["heading", "paragraph"]
    assert [b.kind for b in B.blocks("Annual Leave\nEveryone gets some days.", plain_headings=False)] == ["paragraph"]


@pytest.mark.parametrize("name", sorted(C._registry))
@pytest.mark.parametrize("text", TEXTS.values(), ids=TEXTS.keys())
def test_contract(name, text):
    small = {
        "fixed": {"chunk_size": 80, "overlap": 10}, "sliding_window": {"window_size": 10, "step": 7}, "sentence": {"max_chars": 80, "overlap_sentences": 1}, "recursive": {"chunk_size": 80}, "token": {"max_tokens": 20, "overlap_tokens": 4},
        "semantic": {"max_chars": 120, "min_chars": 20, "provider": HashProvider(32)}, "structure": {"max_chars": 80, "min_section_chars": 10}, "parent_child": {"parent_size": 200, "child_size": 60},
        "hierarchical": {"section_max_chars": 300, "paragraph_max_chars": 120, "chunk_size": 60, "min_section_chars": 10},
    }[name]
    pieces = C.find(name)[1].kernel(text, **small)
    names = {p.name for p in pieces}
    assert len(names) == len(pieces)
    for stem in {p.stem for p in pieces}:
        assert [p.number for p in pieces if p.stem == stem] == list(range(sum(p.stem == stem for p in pieces)))
    assert all(0 <= p.start < p.end <= len(text) for p in pieces)
    assert all(p.parent is None or p.parent in names for p in pieces)
    covered = set().union(*(range(p.start, p.end) for p in pieces if p.retrievable))
    assert all(i in covered for i, c in enumerate(text) if c.isalnum())


def test_fixed_has_no_tail_inside_the_overlap():
    assert [(p.start, p.end) for p in C.fixed("x" * 100, 50, 10)] == [(0, 50), (40, 90), (80, 100)]
    assert [(p.start, p.end) for p in C.fixed("x" * 90, 50, 10)] == [(0, 50), (40, 90)]


def test_parents_hold_their_children():
    pieces = C.parent_child(LONG, 300, 90)
    by = {p.name: p for p in pieces}
    for p in pieces:
        if p.level == 1:
            assert by[p.parent].start <= p.start and p.end <= by[p.parent].end and p.context == p.parent


def test_structure_leads_with_the_path():
    pieces = C.structure(GUIDE, max_chars=40, min_section_chars=0)
    assert pieces[0].lead == "" and pieces[0].path == "Garden"
    assert pieces[-1].lead == "Garden > Beds\n"


def test_semantic_cuts_where_the_topic_turns():
    text = "The cat sat. A cat ran. One cat slept. The dog barked. A dog dug. One dog ate."
    found = M.places(text, KeywordProvider(["cat", "dog"]), buffer_size=0, breakpoint_threshold=80.0)
    assert found.cut.tolist() == [False, False, True, False, False]
    rows = list(M.explain(text, KeywordProvider(["cat", "dog"]), buffer_size=0, breakpoint_threshold=80.0))
    assert [r[0] for r in rows] == list(range(6)) and said(text, [r[1:3] for r in rows])[2] == "One cat slept."
    assert [r[-1] for r in rows] == [False, False, True, False, False, False] and rows[-1][3] is None
    spans = M.semantic_spans(text, KeywordProvider(["cat", "dog"]), buffer_size=0, breakpoint_threshold=80.0, min_chars=0)
    assert said(text, spans) == [text[:36].rstrip(), text[37:]] or len(spans) == 2
    assert M.places("Only one.", HashProvider(8)).threshold == float("inf")


def test_blocks_of_odd_lines():
    kinds = lambda t: [(b.kind, t[b.start : b.end]) for b in B.blocks(t, plain_headings=False)]
    assert kinds("a\nb\n---\n# H #\ntext | row\n- x | y\n- item\n  more | row\nplain") == [
        ("paragraph", "a\nb\n---"), ("heading", "# H #"), ("table", "text | row\n- x | y"), ("list", "- item\n  more | row"), ("paragraph", "plain"),
    ]
    assert kinds("```\n~~~\n# no\n``` x\nafter\n~~~\nopen\n\n") == [("code", "```\n~~~\n# no\n``` x"), ("paragraph", "after"), ("code", "~~~\nopen\n\n")]
    assert kinds("- item\n---\n\n  \n===") == [("list", "- item"), ("paragraph", "---"), ("paragraph", "===")]


def test_semantic_rules():
    found = M.places("Old text here.\n\n# Head\n\nBody. This follows.", HashProvider(8))
    assert found.forced.tolist() == [True, False, False] and found.barred.tolist() == [False, True, True]


def test_splitting_and_joining():
    no = np.zeros(3, bool)
    found = M.Places([(0, 10), (11, 20), (21, 30), (31, 40)], np.array([0.1, 0.9, 0.2]), 0.5, no.copy(), no.copy())
    assert list(M.split_long(found, 0, 3, 25)) == [(0, 1), (2, 3)]
    assert M.join_short(found, [(0, 0), (1, 3)], 15, 45) == [(0, 3)]
    assert M.join_short(found, [(0, 0), (1, 1), (2, 2), (3, 3)], 15, 25) == [(0, 1), (2, 3)]
    found.forced[0] = True
    assert M.join_short(found, [(0, 0), (1, 3)], 15, 45) == [(0, 0), (1, 3)]
    assert M.join_short(found, [], 15, 45) == []


def test_tokens():
    text = "seven plain words stand here in line 12345"
    spans = token_spans(text, 4, 1)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert budget("abcd", 1, WordPieces()) == {"token_count": 1, "max_tokens": 1, "valid": True}


def test_embedding_checks():
    assert HashProvider(16).embed_batch([]).shape == (0, 16)
    assert RemoteProvider(client=object()).embed_batch([]).shape == (0, 1536)
    with pytest.raises(ValueError, match="embeddings for"):
        check_vectors(HashProvider(4).embed_batch(["a"]), 2, 4)
    assert cosine_similarity([1, 0], [1, 0]) == 1
    with pytest.raises(ValueError):
        cosine_similarity([1], [1, 2])
    with pytest.raises(ValueError):
        cosine_similarity([0, 0], [1, 2])


def test_parameters_are_refused():
    for name, params in (("fixed", {"overlap": 500}), ("sliding_window", {"step": 200}), ("sentence", {"overlap_sentences": -1}), ("parent_child", {"child_size": 5000}), ("hierarchical", {"context_level": "x"}), ("semantic", {"min_chars": 2000}), ("token", {"max_tokens": 0})):
        with pytest.raises(ValueError):
            C.check_params(name, params)
    with pytest.raises(ValueError, match="unknown chunking strategy"):
        C.find("nope")
    assert C.find("markdown")[0] == "structure"


def test_spans_are_embedded_like_their_texts():
    """Words that a span's ends cut, letters whose lower case is longer or depends on their place, blank and empty spans."""
    rng, provider = np.random.default_rng(2), HashProvider(64)
    for n in range(400):
        text = "".join(rng.choice(list("ab C,.D\u00e9_1 \n-\u01c4\u00df\u4e2d\U0001d518" + "\u0130\u03a3" * (n % 4 == 0)), int(rng.integers(0, 40))))
        spans = [tuple(sorted(rng.integers(0, len(text) + 1, 2).tolist())) for _ in range(6)]
        leads = ["", "A > b\n", "", "c\n", "A > b\n", ""]
        want = provider.embed_batch([lead + text[a:b] for lead, (a, b) in zip(leads, spans, strict=True)])
        assert (provider.embed_spans(Words(text), spans, leads) == want).all(), (text, spans)


def test_distances_read_a_text_once_and_hold_one_batch(monkeypatch):
    """The same distances whatever the batch, from words that are found once for all windows."""
    text = " ".join(f"Sentence {n} is about {'cats' if n % 7 else 'dogs'}." for n in range(300))
    spans = S.sentences(text)
    windows = M.around(spans, 1)
    vectors = HashProvider(64).embed_batch([text[a:b] for a, b in windows]).astype(float)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    monkeypatch.setattr(HashProvider, "embed_batch", None)
    sizes, own = [], HashProvider.embed_spans
    monkeypatch.setattr(HashProvider, "embed_spans", lambda self, words, part: sizes.append(len(part)) or own(self, words, part))
    for batch in (7, 256):
        got = M.distances_of(text, windows, HashProvider(64), batch)
        assert np.allclose(got, 1 - (vectors[:-1] * vectors[1:]).sum(axis=1), atol=1e-12) and max(sizes) <= batch
        sizes.clear()
