"""Exact byte-pair encoding from public vocabulary files: counting (2) and lexicon encoding (10).

Both operators read the ``tokenizers`` JSON files by path; nothing is trained or copied. A text is
cut at blanks, where no pre-token can reach across, and each piece is looked up in a bounded memo.

Counting proves once, on the driver, which vocabulary strings encode alone as a single token; a
pre-token in that set counts one without any merging, and only the rest is merged.

Encoding finds the corpus's frequent words (each holds a share of all words of at least
``min_share``, so there are at most 1/min_share of them), compiles them with their ids into a
minimal acyclic automaton whose arc outputs add up to the word's number, and lets workers memory-map
it. Words that it doesn't hold are merged exactly, so the lexicon affects speed and not results.

Edge cases: null and empty texts have no tokens; the special strings of a vocabulary file inside a
text become its special ids, as the library does by default; ties and repeated rows are encoded row by row;
an empty table gives an empty result; extra columns of the input are carried by the general
functions unless their names clash with an added column, in which case the added one wins.
"""

from __future__ import annotations

import heapq
import hashlib
import io
import json
import os
import mmap
import re
import struct
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text, materialise, publish, spans_by_size

#: A worker's memo of pieces is emptied once it holds this many.
MEMO = 300_000
#: Longer words don't enter the lexicon.
LONG_WORD = 64

#: Texts are taken in runs of about this many characters: enough to share look-ups, little memory.
RUN_CHARS = 1_000_000

# The pre-token patterns of the two public vocabularies.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> str:
    """The printable stand-in of each byte in byte-level vocabularies: itself where it prints, else the next letter from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return "".join(chr(b) if b in printable else chr(next(spare)) for b in range(256))


LETTERS = byte_letters()
_TO_BYTE = {letter: b for b, letter in enumerate(LETTERS)}


def as_bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


class Merger:
    """Merge the pair of least rank, leftmost first, until none is left; many words at a time.

    Words are rows of symbol ids. Each step finds every row's best pair, joins it and looks up the two
    pairs that this changes, so a step costs a few array operations whatever the number of words. A word
    longer than the widest matrix is merged by a heap, whose costs grow with its length, not with the square.
    """

    #: Words of similar length share a matrix; its width follows the longest of them.
    WIDTHS = (4, 6, 8, 12, 16, 24, 32, 64, 128, 512)

    def __init__(self, model: dict, special: dict[str, int]):
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        vocab = self.vocab
        self.end = model.get("end_of_word_suffix") or ""
        self.special = special
        self.base = 1 + max(vocab.values())
        self.none = len(pairs)
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs] + [0], np.int32)
        order = np.argsort(keys, kind="stable")
        bits = max(4, int(len(keys)).bit_length() + 2)
        self.shift = np.uint64(64 - bits)
        self.slots = np.full((1 << bits) + 64, -1, np.int64)
        self.slot_rank = np.full((1 << bits) + 64, self.none, np.int32)
        self._fill(keys[order], order.astype(np.int32))
        self.made = made
        self.pair_rank: dict[int, int] | None = None
        self.inner = np.array([vocab.get(c, 0) for c in LETTERS], np.int32)
        self.outer = np.array([vocab.get(c + self.end, 0) for c in LETTERS], np.int32)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _fill(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        at, left = self._hash(keys), np.arange(len(keys))
        self.probes = 0
        while len(left):  # open addressing: the first of those that meet in a free slot takes it
            self.probes += 1
            free = self.slots[at[left]] < 0
            places, first = np.unique(at[left][free], return_index=True)
            taken = left[free][first]
            self.slots[places], self.slot_rank[places] = keys[taken], ranks[taken]
            left = np.setdiff1d(left, taken, assume_unique=True)
            at[left] += 1

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) * self.base + b
        at = self._hash(keys)
        found = np.where(self.slots[at] == keys, self.slot_rank[at], self.none).astype(np.int32)
        open_ = np.flatnonzero((found == self.none) & (self.slots[at] >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] += 1
            here = self.slots[at[open_]]
            hit = here == keys[open_]
            found[open_[hit]] = self.slot_rank[at[open_[hit]]]
            open_ = open_[~hit & (here >= 0)]
        return found

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word, given as bytes."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        below = 0
        for width in (*self.WIDTHS, None):
            if width is None:
                for at in np.flatnonzero(lengths > below).tolist():
                    out[at] = self._long(words[at])
            else:
                chosen = np.flatnonzero((lengths > below) & (lengths <= width))
                for lo in range(0, len(chosen), 65536):
                    part = chosen[lo : lo + 65536]
                    self._rows([words[k] for k in part], part, width, out)
                below = width
        return out

    def _long(self, word: bytes) -> np.ndarray:
        """The same for one long word: pairs wait in a heap by rank and place, symbols in a linked list."""
        raw = np.frombuffer(word, np.uint8)
        symbols = self.inner[raw]
        symbols[-1] = self.outer[raw[-1]]
        if self.pair_rank is None:
            held = self.slots >= 0
            self.pair_rank = dict(zip(self.slots[held].tolist(), self.slot_rank[held].tolist(), strict=True))
        first = self.ranks(symbols[:-1], symbols[1:])
        n, base, rank_of, made = len(word), self.base, self.pair_rank.get, self.made.tolist()
        begun = np.flatnonzero(first < self.none)
        heap = (first[begun].astype(np.int64) * n + begun).tolist()  # rank and place in one number
        heapq.heapify(heap)
        symbol, before, after = symbols.tolist(), list(range(-1, n - 1)), [*range(1, n), -1]
        while heap:
            rank, at = divmod(heapq.heappop(heap), n)
            right = after[at]
            if symbol[at] < 0 or right < 0 or rank_of(symbol[at] * base + symbol[right]) != rank:
                continue  # one of the two was joined meanwhile
            symbol[at], symbol[right] = made[rank], -1
            after[at] = beyond = after[right]
            if beyond >= 0:
                before[beyond] = at
                if (r := rank_of(symbol[at] * base + symbol[beyond])) is not None:
                    heapq.heappush(heap, r * n + at)
            if (left := before[at]) >= 0 and (r := rank_of(symbol[left] * base + symbol[at])) is not None:
                heapq.heappush(heap, r * n + left)
        return np.array([x for x in symbol if x >= 0], np.int32)

    def _rows(self, words: list[bytes], where: np.ndarray, width: int, out: list[np.ndarray]) -> None:
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join(words), np.uint8)
        mask = np.arange(width) < size[:, None]
        symbols = np.full((n, width + 1), -1, np.int32)
        symbols[:, :width][mask] = self.inner[raw]
        rows = np.arange(n)
        symbols[rows, size - 1] = self.outer[raw[np.cumsum(size) - 1]]
        rank = np.full((n, width), self.none, np.int32)
        pairs = mask[:, 1:]
        rank[:, : width - 1][pairs] = self.ranks(symbols[:, : width - 1][pairs], symbols[:, 1:width][pairs])
        columns = np.arange(width)
        while len(rows):
            best = rank.argmin(1)
            least = rank[np.arange(len(rows)), best]
            stuck = least == self.none
            if stuck.any():
                for r in np.flatnonzero(stuck):
                    out[where[rows[r]]] = symbols[r, : size[rows[r]]].copy()
                go = ~stuck
                rows, symbols, rank, best, least = rows[go], symbols[go], rank[go], best[go], least[go]
                if not len(rows):
                    break
            here = np.arange(len(rows))
            symbols[here, best] = self.made[least]
            # drop the symbol after the joined one, and the pair it began
            later = columns > best[:, None]
            symbols[:, :width] = np.where(later, symbols[:, 1:], symbols[:, :width])
            moved = np.full_like(rank, self.none)
            moved[:, :-1] = rank[:, 1:]
            rank = np.where(later | (columns == best[:, None]), moved, rank)
            size[rows] -= 1
            right = best + 1 < size[rows]
            k = here[right]
            rank[k, best[right]] = self.ranks(symbols[k, best[right]], symbols[k, best[right] + 1])
            rank[here[~right], best[~right]] = self.none
            left = best > 0
            k = here[left]
            rank[k, best[left] - 1] = self.ranks(symbols[k, best[left] - 1], symbols[k, best[left]])


def load(path: str) -> tuple[Merger, dict]:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return Merger(spec["model"], {t["content"]: t["id"] for t in spec["added_tokens"]}), spec


def single_token_strings(merger: Merger) -> list[str]:
    """Vocabulary strings that are valid text and whose own merging ends in exactly that one token."""
    texts, ids = [], []
    for token, number in merger.vocab.items():
        if token not in merger.special:
            try:
                raw = bytes(_TO_BYTE[c] for c in token)
                raw.decode("utf-8")
            except (KeyError, UnicodeDecodeError):
                continue
            texts.append(raw)
            ids.append(number)
    merged = merger.merge(texts)
    return [t.decode("utf-8") for t, i, m in zip(texts, ids, merged, strict=True) if len(m) == 1 and m[0] == i]


_HIGH = re.compile("[^\x00-ԯ]")


def odd_unicode(text: str) -> bool:
    """Does the text hold code points that Unicode versions classify differently?"""
    return bool(_HIGH.search(text)) and any(unicodedata.category(c) == "Cn" for c in set(text))


class PreTokens:
    """Pre-tokens of a piece; code points new to some Unicode version are split by the library itself."""

    def __init__(self, path: str, pattern: str, fold: bool):
        self.path, self.find, self.fold, self.library = path, regex.compile(pattern).findall, fold, None

    def __call__(self, piece: str) -> list[str]:
        if odd_unicode(piece):
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path)
            if self.fold:
                piece = self.library.normalizer.normalize_str(piece)
            spans = self.library.pre_tokenizer.pre_tokenize_str(piece)
            return [piece[a:b] for _, (a, b) in spans]
        if self.fold:
            if not piece.isascii():
                piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")
            piece = piece.lower()
        return self.find(piece)


# --- 2: token counts -------------------------------------------------------------------------

class TokenCounter:
    """Counts for runs of texts; pre-tokens outside the proven set and not seen before are merged together."""

    def __init__(self, path: str, whole: frozenset[str]):
        self.merger, _ = load(path)
        self.split = PreTokens(path, BYTE_PATTERN, False)
        self.special = re.compile("|".join(map(re.escape, self.merger.special))) if self.merger.special else None
        self.hint = os.path.commonprefix(list(self.merger.special))  # how all special strings begin
        self.whole = dict.fromkeys(whole, 1)
        self.known = dict(self.whole)

    def count(self, texts: list[str]) -> list[int]:
        if len(self.known) > len(self.whole) + MEMO:
            self.known = dict(self.whole)
        known, counts, cut = self.known, [], []
        for text in texts:
            if self.special and self.hint in text and self.special.search(text):
                parts = self.special.split(text)
                counts.append(len(parts) - 1)
                cut.append([t for part in parts for t in self.split(part)])
            else:
                counts.append(0)
                cut.append(self.split(text))
        new = list(set().union(*cut).difference(known))
        known.update(zip(new, map(len, self.merger.merge([as_bytes(t) for t in new])), strict=True))
        get = known.__getitem__
        return [n + sum(map(get, tokens)) for n, tokens in zip(counts, cut, strict=True)]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add n_bytes, n_tokens and over_limit for the whole text of each row."""
    merger, _ = load(tokenizer)
    proven = docs.sparkSession.sparkContext.broadcast(frozenset(single_token_strings(merger)))  # at most the vocabulary

    def kernel():
        counter = TokenCounter(tokenizer, proven.value)

        def apply(texts: list[str]) -> list[pa.Array]:
            counts = [n for lo, hi in spans_by_size(texts, RUN_CHARS) for n in counter.count(texts[lo:hi])]
            return [pa.array([len(as_bytes(t)) for t in texts]), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())]

        return apply

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return map_text(docs, kernel, fields, text_col, keep)


# --- 10: the lexicon -------------------------------------------------------------------------


def build_lexicon(words: dict[str, list[int]]) -> bytes:
    """A minimal acyclic automaton of the words' UTF-8, as an .npz image without compression.

    States share suffixes: a finished branch is replaced by an equal state that is there already. An
    arc's output is the number of words that sort before those behind it, so outputs along a path add
    up to the word's number, which points into the flat id list.
    """
    register: dict[tuple, int] = {}
    arcs: list[list[tuple[int, int]]] = []
    final: list[bool] = []
    count: list[int] = []

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(arcs)
            arcs.append(list(node[1]))
            final.append(node[0])
            count.append(int(node[0]) + sum(count[t] for _, t in node[1]))
        return register[key]

    order = sorted((w.encode("utf-8"), ids) for w, ids in words.items())
    path: list[list] = [[False, []]]  # open states: is final, arcs
    last = b""
    for word, _ in order:
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        for at in range(len(last), shared, -1):
            done = path.pop()
            path[-1][1].append((last[at - 1], freeze(done)))
        path += [[False, []] for _ in range(len(word) - shared)]
        path[-1][0] = True
        last = word
    for at in range(len(last), 0, -1):
        done = path.pop()
        path[-1][1].append((last[at - 1], freeze(done)))
    root = freeze(path[0])

    keys, targets, outputs = [], [], []
    for state, out in enumerate(arcs):
        before = int(final[state])
        for byte, target in out:
            keys.append(state * 256 + byte)
            targets.append(target)
            outputs.append(before)
            before += count[target]
    sizes = [len(ids) for _, ids in order]
    image = io.BytesIO()
    blocks = [
        np.array([root, len(order)], np.int64), np.array(keys, np.int64), np.array(targets, np.int64), np.array(outputs, np.int64),
        np.array(final, np.int64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), np.array([i for _, ids in order for i in ids], np.int64),
    ]
    image.write(np.array([len(blocks), *map(len, blocks)], np.int64).tobytes())
    for block in blocks:
        image.write(block.tobytes())
    return image.getvalue()


class Lexicon:
    """A memory-mapped automaton; whole lists of words are walked together, one byte a step."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n = int(np.frombuffer(self.map, np.int64, 1)[0])
        sizes = np.frombuffer(self.map, np.int64, n, 8)
        at, blocks = 8 * (n + 1), []
        for size in sizes:
            blocks.append(np.frombuffer(self.map, np.int64, int(size), at))
            at += 8 * int(size)
        head, self.keys, self.targets, self.outputs, self.final, self.starts, self.ids = blocks
        self.root, self.size = int(head[0]), int(head[1])

    def numbers(self, words: list[str]) -> np.ndarray:
        """Each word's number, or -1."""
        if not words or not len(self.keys):
            return np.full(len(words), -1, np.int64)
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        starts = np.cumsum(lengths) - lengths
        state, number = np.full(len(raw), self.root, np.int64), np.zeros(len(raw), np.int64)
        live = np.flatnonzero(lengths > 0)
        step = 0
        number[lengths == 0] = -1
        while len(live):
            key = state[live] * 256 + data[starts[live] + step]
            arc = np.searchsorted(self.keys, key)
            arc[arc == len(self.keys)] = 0
            hit = self.keys[arc] == key
            number[live[~hit]] = -1
            live, arc = live[hit], arc[hit]
            number[live] += self.outputs[arc]
            state[live] = self.targets[arc]
            step += 1
            ended = lengths[live] == step
            done = live[ended]
            number[done[self.final[state[done]] == 0]] = -1
            live = live[~ended]
        return number

    def lookup(self, number: int) -> list[int]:
        return self.ids[self.starts[number] : self.starts[number + 1]].tolist()


class WordEncoder:
    """Ids and decoded text of whole texts for a vocabulary with word ends."""

    def __init__(self, path: str, lexicon: str | None):
        self.merger, spec = load(path)
        self.split = PreTokens(path, WORD_PATTERN, True)
        self.special = re.compile("|".join(map(re.escape, sorted(self.merger.special, key=len, reverse=True))))
        self.names = {i: t for t, i in self.merger.vocab.items()} | {i: t for t, i in self.merger.special.items()}
        self.lexicon = Lexicon(lexicon) if lexicon else None
        #: A special id stands for itself; words never are numbers.
        self.base = {i: self._packed([i]) for i in self.merger.special.values()}
        self.words: dict[str | int, tuple[bytes, str]] = dict(self.base)

    def _packed(self, ids: list[int]) -> tuple[bytes, str]:
        return struct.pack(f"<{len(ids)}I", *ids), " ".join(map(self.names.__getitem__, ids))

    def _units(self, text: str) -> list[str | int]:
        """Words and special ids of a text, in order."""
        if "<|" not in text or not self.special.search(text):
            return self.split(text)
        units: list[str | int] = []
        at = 0
        for found in self.special.finditer(text):
            units += self.split(text[at : found.start()])
            units.append(self.merger.special[found[0]])
            at = found.end()
        return units + self.split(text[at:])

    def _learn(self, new: list[str]) -> None:
        numbers = self.lexicon.numbers(new).tolist() if self.lexicon else [-1] * len(new)
        unseen = [w for w, number in zip(new, numbers, strict=True) if number < 0]
        for word, number in zip(new, numbers, strict=True):
            if number >= 0:
                self.words[word] = self._packed(self.lexicon.lookup(number))
        for word, ids in zip(unseen, self.merger.merge([as_bytes(w) for w in unseen]), strict=True):
            self.words[word] = self._packed(ids.tolist())

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text its ids as little-endian 32-bit numbers, and the decoded text."""
        if len(self.words) > MEMO:
            self.words = dict(self.base)
        cut = [self._units(t) for t in texts]
        self._learn(list(set().union(*cut).difference(self.words)))
        out, get = [], self.words.__getitem__
        for units in cut:
            got = list(map(get, units))
            out.append((b"".join([g[0] for g in got]), " ".join([g[1] for g in got])))
        return out


def frequent_words(docs: DataFrame, tokenizer: str, min_share: float, text_col: str = "text") -> list[str]:
    """Words of the blank-delimited pieces that each make up at least ``min_share`` of the whole corpus.

    There are at most 1/min_share such pieces. One that frequent has that share in some task, so each
    task reports only the pieces frequent among its own, and its total: what reaches the driver is bounded.
    """
    schema = T.StructType([T.StructField("piece", T.StringType()), T.StructField("n", T.LongType())])
    cap = int(4 / min_share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        total = removed = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    pieces = text.split()
                    total += len(pieces)
                    held.update(pieces)
                    if len(held) > 2 * cap:  # Misra-Gries: what a piece can lose stays under total / cap
                        least = sorted(held.values())[-cap]
                        held = Counter({w: n - least for w, n in held.items() if n > least})
                        removed += least
        found = [(w, n) for w, n in held.items() if n + removed >= min_share * total and len(w) <= LONG_WORD]
        found.append((None, total))
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["piece", "n"])

    counts = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema).groupBy("piece").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "pieces")
    total = counts.filter("piece IS NULL").agg(F.sum("n")).first()[0] or 0
    pieces = [r.piece for r in counts.filter("piece IS NOT NULL").filter(F.col("n") >= min_share * total).select("piece").collect()]
    split = PreTokens(tokenizer, WORD_PATTERN, True)
    return sorted({w for p in pieces for w in split(p)})


def compile_lexicon(words: list[str], tokenizer: str) -> bytes:
    merger, _ = load(tokenizer)
    return build_lexicon({w: ids.tolist() for w, ids in zip(words, merger.merge([as_bytes(w) for w in words]), strict=True) if w})


def encode_decode(docs: DataFrame, tokenizer: str, min_share: float = 2e-5, text_col: str = "text", keep: list[str] | None = None, full: bool = False) -> DataFrame:
    """Add n_tokens, ids_sha256 and decoded_sha256; with ``full`` also the ids and the decoded text."""
    spark = docs.sparkSession
    name = publish(spark, compile_lexicon(frequent_words(docs, tokenizer, min_share, text_col), tokenizer), ".lexicon")

    def kernel():
        encoder = WordEncoder(tokenizer, SparkFiles.get(name))

        def apply(texts: list[str]) -> list[pa.Array]:
            counts, ids, decoded, all_ids, all_text = [], [], [], [], []
            for lo, hi in spans_by_size(texts, RUN_CHARS):
                for packed, text in encoder.encode(texts[lo:hi]):
                    counts.append(len(packed) // 4)
                    ids.append(hashlib.sha256(packed).hexdigest())
                    decoded.append(hashlib.sha256(text.encode("utf-8")).hexdigest())
                    if full:
                        all_ids.append(np.frombuffer(packed, "<u4").astype(np.int64))
                        all_text.append(text)
            made = [pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            return made + ([pa.array(all_ids, pa.list_(pa.int64())), pa.array(all_text, pa.string())] if full else [])

        return apply

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if full:
        fields += [T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("decoded", T.StringType())]
    return map_text(docs, kernel, fields, text_col, keep)
