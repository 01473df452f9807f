"""Character spans: where texts are cut. Plain Python, for use inside Arrow kernels.

A span is a half-open pair of code-point offsets into the whole text, so texts are sliced last and
every piece can be traced to its place. Spans of a list are in order and don't nest, which lets
packing work by binary search on their starts and ends.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import lru_cache

Span = tuple[int, int]

# Separators by name, coarsest first.
SEPARATORS = {
    "section": r"\n(?=#{1,6}\s)",
    "paragraph": r"\n[ \t]*\n",
    "line": r"\n",
    "sentence": r"(?<=[.!?])[\"'”’)\]]*\s+",
    "word": r"\s+",
}
# Words whose full stop doesn't end a sentence.
ABBREVIATIONS = frozenset(
    "e.g. i.e. etc. vs. mr. mrs. ms. dr. prof. inc. ltd. co. corp. jr. sr. st. no. fig. approx. dept. u.s. a.m. p.m.".split()
)
# What ends a sentence, and what begins a line of its own.
SENTENCE_END = re.compile(r"[.!?][\"'”’)\]]*\s+")
OWN_LINE = re.compile(r"\s*(?:[-*+•]\s|\d+[.)]\s|#{1,6}\s|\|)")


def squeeze(text: str, lo: int, hi: int) -> Span | None:
    """The span without blanks at its ends, or None if nothing is left."""
    if lo < hi and not text[lo].isspace() and not text[hi - 1].isspace():
        return lo, hi
    piece = text[lo:hi]
    body = piece.lstrip()
    if not body:
        return None
    lo += len(piece) - len(body)
    return lo, lo + len(body.rstrip())


def between(text: str, lo: int, hi: int, pattern: str | re.Pattern) -> list[Span]:
    """The non-blank pieces between matches; matches of no width don't cut."""
    cuts = [m.span() for m in re.compile(pattern).finditer(text, lo, hi) if m.end() > m.start()]
    edges = zip([lo, *(b for _, b in cuts)], [*(a for a, _ in cuts), hi], strict=True)
    return [s for a, b in edges if (s := squeeze(text, a, b))]


def slabs(text: str, lo: int, hi: int, size: int) -> list[Span]:
    """Consecutive pieces of ``size`` characters, squeezed, without blank ones."""
    pieces = re.compile(f"(?s:.{{1,{size}}})").finditer(text, lo, hi)
    return [s for piece in pieces if (s := squeeze(text, *piece.span()))]


def pack(spans: list[Span], limit: int, overlap: int = 0) -> list[Span]:
    """Join runs of neighbours while the whole stays within ``limit``; a longer single span stays whole.

    With ``overlap`` the next run begins with as many of the last spans as fit in it, but never
    with the run's own first span.
    """
    starts, ends = [a for a, _ in spans], [b for _, b in spans]
    packed, first = [], 0
    while first < len(spans):
        last = max(first, bisect_right(ends, starts[first] + limit) - 1)
        packed.append((starts[first], ends[last]))
        if last == len(spans) - 1:
            break
        again = bisect_left(starts, ends[last] - overlap) if overlap else last + 1
        first = min(last + 1, max(first + 1, again))
    return packed


def fit(text: str, span: Span, limit: int) -> list[Span]:
    """A span cut between words until it fits; a word that is too long is cut anywhere."""
    if span[1] - span[0] <= limit:
        return [span]
    words = between(text, *span, SEPARATORS["word"])
    return pack([s for a, b in words for s in (slabs(text, a, b, limit) if b - a > limit else [(a, b)])], limit)


def _unwrapped(text: str, lo: int, hi: int) -> list[Span]:
    """Lines, with those that go on in lower case or with a closing mark joined to the one before."""
    lines = between(text, lo, hi, "\n")
    fresh = [n for n, (a, _) in enumerate(lines) if n == 0 or OWN_LINE.match(text, a) or not (text[a].islower() or text[a] in ",;:)")]
    return [(lines[n][0], lines[end - 1][1]) for n, end in zip(fresh, [*fresh[1:], len(lines)], strict=True)]


def _ends_here(text: str, since: int, stop: int, following: str) -> bool:
    """Does the mark at ``stop`` end a sentence that began at ``since``?"""
    if following.islower():
        return False
    word = text[max(text.rfind(" ", since, stop + 1) + 1, since) : stop + 1].lower()
    initial = len(word) == 2 and "a" <= word[0] <= "z" and word[1] == "."
    return not (initial or word in ABBREVIATIONS)


def sentences(text: str, lo: int = 0, hi: int | None = None) -> list[Span]:
    """Sentences; blank lines and lines that begin something new always end one."""
    hi = len(text) if hi is None else hi
    found: list[Span] = []
    for para in between(text, lo, hi, SEPARATORS["paragraph"]):
        for a, b in _unwrapped(text, *para):
            since = a
            for mark in SENTENCE_END.finditer(text, a, b):
                if mark.end() < b and _ends_here(text, since, mark.start(), text[mark.end()]):
                    found.append((since, mark.start() + 1))  # begins and ends with what isn't blank, as lines do
                    since = mark.end()
            found.append((since, b))
    return found


#: Of the last text, which several strategies may cut.
_sentences_of = lru_cache(1)(sentences)


def fitted_sentences(text: str, limit: int) -> list[Span]:
    return [piece for s in _sentences_of(text) for piece in fit(text, s, limit)]


def windows_of_sentences(spans: list[Span], limit: int, back: int) -> list[Span]:
    """Runs of sentences within ``limit``; each begins ``back`` sentences before the last one's end.

    The step back shrinks until a new sentence fits behind it.
    """
    starts, ends = [a for a, _ in spans], [b for _, b in spans]
    found, first = [], 0
    while first < len(spans):
        last = max(first, bisect_right(ends, starts[first] + limit) - 1)
        found.append((starts[first], ends[last]))
        if last == len(spans) - 1:
            break
        room = bisect_left(starts, ends[last + 1] - limit)
        first = min(last + 1, max(first + 1, last + 1 - back, room))
    return found


def recursive(text: str, lo: int, hi: int, size: int, overlap: int = 0, separators: list[str] | None = None) -> list[Span]:
    """Cut at the coarsest separator that cuts at all, what is still too long at finer ones, then pack."""
    patterns = [re.compile(SEPARATORS.get(s, s)) for s in separators or SEPARATORS]
    done: list[Span] = []
    todo = [(lo, hi, 0)]  # the next piece is at the end
    while todo:
        a, b, level = todo.pop()
        if b - a <= size:
            done.append((a, b))
            continue
        for at in range(level, len(patterns)):
            parts = between(text, a, b, patterns[at])
            if len(parts) > 1:
                todo += [(x, y, at + 1) for x, y in reversed(parts)]
                break
        else:
            done += slabs(text, a, b, size)
    return pack(done, size, overlap)
