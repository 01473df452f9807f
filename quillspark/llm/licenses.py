"""License scans (7): fixed phrases, and templates with optional and replaceable regions.

A template is wording with markup: ``<<beginOptional>> ... <<endOptional>>`` may be absent, and
``<<var;max=n>>`` stands for up to n words of any kind. It is compiled into a token automaton whose
states are the places in the wording; a text is accepted where every mandatory word stands in order
with nothing between but what the markup allows. Runs of mandatory words are looked for first, as
plain substrings, so the automaton only runs over texts that can be accepted.

Words are the runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` in the text with A-Z in lower case.

Edge cases: null and empty texts have no words, no labels and score 0; a place counts each time it
occurs; an empty table gives an empty result; clashing columns of the input are replaced.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_text
from .license_templates import TEMPLATES

# The phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: A-Z to a-z; every other ASCII byte that isn't part of a word to a blank.
_FOLD = bytes((b + 32) if 65 <= b <= 90 else 32 if b < 48 or 58 <= b <= 96 or 123 <= b <= 127 else b for b in range(256))
_MARKUP = re.compile(r"<<(beginOptional|endOptional|var)((?:;\w+=\d+)*)>>")


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Automaton:
    """States are numbered places; each has words leading on, and free steps to other places."""

    def __init__(self, label: str, template: str):
        self.label = label
        self.on: list[dict[bytes, int]] = [{}]
        self.any: list[int | None] = [None]
        self.free: list[list[int]] = [[]]
        self.runs: list[bytes] = []
        at, open_, run = 0, [], []
        place = 0
        for mark in [*_MARKUP.finditer(template), None]:
            for word in words_of(template[place : mark.start() if mark else len(template)]):
                at = self._step(at, word)
                if not open_:
                    run.append(word)
            if run:
                self.runs.append(b" " + b" ".join(run) + b" ")
                run = []
            if mark is None:
                break
            place = mark.end()
            if mark[1] == "beginOptional":
                open_.append(at)
            elif mark[1] == "endOptional":
                end = self._new()
                self.free[at].append(end)
                self.free[open_.pop()].append(end)
                at = end
            else:
                size = dict(x.split("=") for x in mark[2].split(";") if x)
                least, most = int(size.get("min", 0)), int(size["max"])
                end = self._new()
                for n in range(most + 1):
                    if n >= least:
                        self.free[at].append(end)
                    if n < most:
                        following = self._new()
                        self.any[at] = following
                        at = following
                at = end
        if open_:
            raise ValueError(f"{label}: an optional region isn't closed")
        self.last = at
        self.start = self._close({0})
        self.first = {w for s in self.start for w in self.on[s]}

    def _new(self) -> int:
        self.on.append({})
        self.any.append(None)
        self.free.append([])
        return len(self.on) - 1

    def _step(self, at: int, word: bytes) -> int:
        following = self._new()
        self.on[at][word] = following
        return following

    def _close(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def match(self, words: list[bytes], at: int) -> int | None:
        """The word after the longest match that begins here."""
        states, found = self.start, None
        for k in range(at, len(words)):
            following = set()
            for s in states:
                if (t := self.on[s].get(words[k])) is not None:
                    following.add(t)
                if (t := self.any[s]) is not None:
                    following.add(t)
            if not following:
                break
            states = self._close(following)
            if self.last in states:
                found = k + 1
        return found

    def spans(self, words: list[bytes], line: bytes) -> list[tuple[int, int]]:
        """All places where the template matches; ``line`` is the words between blanks."""
        if not all(r in line for r in self.runs):
            return []
        found, at = [], 0
        while at < len(words):
            end = self.match(words, at) if words[at] in self.first else None
            if end:
                found.append((at, end))
            at = end or at + 1
        return found


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]]):
        self.phrases = [(b" " + b" ".join(words_of(p)) + b" ", label) for p, label in phrases.items()]
        self.templates = [Automaton(label, text) for label, text in templates]

    def scan(self, text: str) -> tuple[int, list[int], set[str], list[tuple[str, int, int]]]:
        """Words, the phrases' places, their labels, and the templates' labelled spans."""
        words = words_of(text)
        line = b" " + b" ".join(words) + b" "
        places, labels = [], set()
        for phrase, label in self.phrases:
            at = line.find(phrase)
            word = last = 0
            while at >= 0:
                word += line.count(b" ", last, at)
                last = at
                places.append(word)
                labels.add(label)
                at = line.find(phrase, at + 1)
        matches = [(a.label, lo, hi) for a in self.templates for lo, hi in a.spans(words, line)]
        return len(words), places, labels, matches


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add word count, phrase places, labels, matched spans and a score.

    The score is 1 where a template is accepted, a half where only a phrase stands, else 0. ``matches``
    lists ``label:first-end`` in words, the end not included.
    """
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates

    def kernel():
        scanner = Scanner(phrases, templates)

        def apply(texts: list[str]) -> list[pa.Array]:
            rows = []
            for text in texts:
                n, places, labels, matches = scanner.scan(text)
                every = labels | {m[0] for m in matches}
                rows.append((
                    n, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(every)),
                    1.0 if matches else 0.5 if places else 0.0, ",".join(f"{a}:{lo}-{hi}" for a, lo, hi in sorted(matches)),
                ))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            return [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]

        return apply

    names = [("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()), ("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType()), ("matches", T.StringType())]
    return map_text(docs, kernel, [T.StructField(n, k) for n, k in names], text_col, keep)
