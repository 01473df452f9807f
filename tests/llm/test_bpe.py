"""Tokens against the tokenizers library, and the lexicon on its own."""

from __future__ import annotations

import hashlib
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspark.llm import bpe

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "  a  b ", "a\n\n b\t c", "x <|endoftext|> y<|endoftext|>", "<|startoftext|>hi", "Σας ΑΣ. it's 'LL we'RE don't", "\x1c a\x1db\x00", "ab՘c࢏ d", "é é ñ   z", "İstanbul ǅ ﬁ ½²Ⅷ 12345",
    "日本語 テスト。 한국어 🙂🙂 x‍", "\n", "tab\tend \r\n x", "ᲉꟋ \U00010d50", "Thnteringly onheed, with erenenst!!! ### $$$", "word " * 3000, "x" * 3000, "same text", "same text",
]


def frame(spark, texts=TEXTS):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return rows.withColumn("n_tokens", F.lit("clash")).withColumn("lang", F.lit("en"))


def test_counts(spark):
    got = {r.doc_id: r for r in bpe.count_tokens(frame(spark), BYTES, limit=512).collect()}
    library = Tokenizer.from_file(BYTES)
    for i, text in enumerate(TEXTS):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit, got[i].lang) == (n, len((text or "").encode()), n > 512, "en"), text
    assert bpe.count_tokens(frame(spark).limit(0), BYTES).count() == 0


@pytest.mark.parametrize("share", [0.01, 0.9])
def test_encoding_and_decoding(spark, share):
    got = {r.doc_id: r for r in bpe.encode_decode(frame(spark), WORDS, min_share=share, keep=["doc_id"], full=True).collect()}
    library = Tokenizer.from_file(WORDS)
    for i, text in enumerate(TEXTS):
        ids = library.encode(text or "", add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        assert got[i].ids == ids and got[i].decoded == said, text
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and got[i].decoded_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert bpe.encode_decode(frame(spark).limit(0), WORDS).count() == 0


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_long_words(path, words):
    """Pre-tokens beyond the matrices, of repeating, random and mixed letters, and one of a million."""
    merger, library = bpe.load(path)[0], Tokenizer.from_file(path)
    rng = np.random.default_rng(4)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    long = ["x" * 600, "ab" * 4000, "".join(rng.choice(letters, 5000)), "".join(words(3, 3000))]
    for word, ids in zip(long, merger.merge([w.encode() for w in long]), strict=True):
        assert ids.tolist() == library.encode(word, add_special_tokens=False).ids
    for n in (513, 700):
        word = long[2][:n].encode()
        by_rows = [None]
        merger._rows([word], np.array([0]), n, by_rows)
        assert merger._long(word).tolist() == by_rows[0].tolist()
    began = time.time()
    merger.merge([("".join(rng.choice(letters, 1_000_000))).encode()])
    assert time.time() - began < 40


def test_proven_tokens():
    merger, _ = bpe.load(BYTES)
    library = Tokenizer.from_file(BYTES)
    proven = bpe.single_token_strings(merger)
    assert len(proven) > 45_000
    for text in proven[::501]:
        assert len(library.encode(text, add_special_tokens=False).ids) == 1


def test_lexicon_shares_suffixes(tmp_path):
    words = {w: [i, i + 1] for i, w in enumerate(["a", "an", "and", "hand", "land", "lands", "hands", "é", "zand"])}
    path = tmp_path / "x.lexicon"
    path.write_bytes(bpe.build_lexicon(words))
    found = bpe.Lexicon(str(path))
    asked = [*words, "", "han", "landsx", "q"]
    numbers = found.numbers(asked)
    assert [found.lookup(n) for n in numbers[: len(words)]] == list(words.values())
    assert (numbers[len(words) :] == -1).all() and found.size == len(words)
    assert len(found.final) < sum(len(w.encode()) for w in words)
    path.write_bytes(bpe.build_lexicon({}))
    assert bpe.Lexicon(str(path)).numbers(["a"]).tolist() == [-1]
