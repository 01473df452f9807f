"""Tokens: counts, budgets and windows, over any tokenizer that gives offsets."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import Protocol

from .spans import Span, squeeze


class Tokenizer(Protocol):
    name: str

    def offsets(self, text: str) -> list[int]:
        """Where each token starts, in characters."""
        ...


class WordPieces:
    """Tokens without a vocabulary: runs of letters cut to four, digits to three, other characters alone.

    It stands in where no vocabulary is installed; its counts are its own.
    """

    name = "word-pieces"
    _token = re.compile(r" ?[^\W\d_]{1,4}| ?\d{1,3}|\s+|.", re.DOTALL)

    def offsets(self, text: str) -> list[int]:
        return [m.start() for m in self._token.finditer(text)]


class Ranked:
    """A byte-pair vocabulary of the tiktoken library, by name; needs its table on the machine."""

    def __init__(self, name: str = "cl100k_base"):
        self.name = name

    def offsets(self, text: str) -> list[int]:
        import tiktoken

        coding = tiktoken.get_encoding(self.name)
        return coding.decode_with_offsets(coding.encode(text))[1]


@lru_cache(maxsize=1)
def default_tokenizer() -> Tokenizer:
    """The named vocabulary if its table is there, else the stand-in, which says so by its name."""
    try:
        found = Ranked()
        found.offsets("a")
        return found
    except Exception:
        return WordPieces()


def count_tokens(text: str, tokenizer: Tokenizer | None = None) -> int:
    return len((tokenizer or WordPieces()).offsets(text))


def budget(text: str, limit: int, tokenizer: Tokenizer | None = None) -> dict:
    n = count_tokens(text, tokenizer)
    return {"token_count": n, "max_tokens": limit, "valid": n <= limit}


def token_spans(text: str, size: int, overlap: int, tokenizer: Tokenizer | None = None) -> list[Span]:
    """Windows of tokens as squeezed character spans; blank ones are left out."""
    bounds = [*(tokenizer or WordPieces()).offsets(text), len(text)]
    total, step = len(bounds) - 1, size - overlap
    firsts = range(0, max(1, total - overlap), step)
    return [s for f in firsts if (s := squeeze(text, bounds[f], bounds[min(f + size, total)]))]
