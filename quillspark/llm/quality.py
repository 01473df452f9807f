"""Quality classifier (4): random-indexing word vectors, pooled, under a small calibrated network.

Every word has a fixed sparse random index vector; a word's vector is its own index vector plus the
normalised sum of those of its neighbours in the training texts. A document is the mean and the
spread of its words' vectors with three counts. A two-layer network in numpy scores it, and a
temperature fitted on rows that the training didn't see makes the scores probabilities.

The fit reads the whole text of every labelled document: one pass turns texts to bucket numbers, one sums the words' neighbours,
one pools each document to a row of features. The network is trained on blocks of about ``block_rows`` of these rows, dealt by hash. All epochs
see all rows: blocks train side by side for ``epochs`` / ``merges`` epochs at a time, and then their weights and moments are averaged by
rows; up to ``block_rows`` rows are one block. A block sends its weights to the driver, 30 KB for each. Word vectors live in a
table of fixed size, so the model's size doesn't depend on the corpus. Scoring is one pass over whole texts without a shuffle.

Edge cases: null and empty texts get a score like any other, from vectors of zero, and are learnt from if labelled; documents without
a label are scored; equal rows of an id count once in the fit, its different texts each; a document with several label rows counts as the least of them, null labels
are no labels; with no labels, or one class only, every score is the share of label 1 (0.5 without
any); an empty table gives an empty result; clashing columns of the input are replaced.
"""

from __future__ import annotations

import io
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import among, discard, map_text, materialise


@dataclass(frozen=True)
class Params:
    buckets: int = 1 << 14
    size: int = 48
    nonzero: int = 6
    window: int = 2
    hidden: int = 24
    epochs: int = 400
    rate: float = 0.01
    decay: float = 1e-3
    block_rows: int = 4000
    merges: int = 20
    seed: int = 11
    threshold: float = 0.3


#: A worker forgets which words it has seen once there are this many.
MEMO = 200_000


def index_vectors(p: Params) -> np.ndarray:
    """Sparse ternary vectors of unit length, the same in every process."""
    rng = np.random.default_rng(p.seed)
    out = np.zeros((p.buckets, p.size), np.float32)
    places = np.argsort(rng.random((p.buckets, p.size)), axis=1)[:, : p.nonzero]
    np.put_along_axis(out, places, rng.choice(np.array([-1, 1], np.float32), (p.buckets, p.nonzero)) / math.sqrt(p.nonzero), 1)
    return out


class Words:
    """Bucket numbers of a text: for each piece between blanks its word, and its shape with what ends it."""

    def __init__(self, p: Params):
        self.p, self.known = p, {}

    def _piece(self, piece: str) -> tuple[int, int]:
        bare = piece.rstrip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
        tail = piece[len(bare) :][:3]
        shape = "p" if not bare else "d" if bare.isdigit() else "u" if bare.isupper() and len(bare) > 1 else "t" if bare[:1].isupper() else "l" if bare.islower() else "m"
        n = self.p.buckets
        return xxhash.xxh64_intdigest("w" + bare.lower()) % n, xxhash.xxh64_intdigest(f"s{shape}{tail}{min(len(bare), 40) // 8}") % n

    def ids(self, text: str) -> np.ndarray:
        if len(self.known) > MEMO:
            self.known.clear()
        known, found = self.known, []
        for piece in text.split():
            pair = known.get(piece)
            if pair is None:
                pair = known[piece] = self._piece(piece)
            found += pair
        return np.array(found, np.int32)


def pooled(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread, then the length's logarithm and the shares of different words and of words said twice running."""
    size = vectors.shape[1]
    if not len(ids):
        return np.zeros(2 * size + 3, np.float32)
    kinds, counts = np.unique(ids, return_counts=True)
    share = (counts / len(ids)).astype(np.float32)
    rows = vectors[kinds]
    mean = share @ rows
    spread = np.sqrt(np.maximum(share @ (rows * rows) - mean * mean, 0))
    own = ids[::2]  # words alone; their shapes stand between
    again = np.count_nonzero(own[1:] == own[:-1]) / len(own)
    return np.concatenate([mean, spread, [math.log1p(len(ids)) / 10, len(kinds) / len(ids), again]]).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    def __init__(self, arrays: dict[str, np.ndarray], p: Params):
        self.a, self.words = arrays, Words(p)

    def logits(self, x: np.ndarray) -> np.ndarray:
        a = self.a
        hidden = np.tanh(((x - a["mean"]) / a["scale"]) @ a["w1"] + a["b1"])
        return hidden @ a["w2"] + a["b2"]

    def scores(self, texts: list[str]) -> np.ndarray:
        if "w1" not in self.a:
            return np.full(len(texts), float(self.a["share"]))
        x = np.stack([pooled(self.words.ids(t), self.a["vectors"]) for t in texts])
        # the last digits depend on how many texts are multiplied together
        return np.round(sigmoid(self.logits(x) / float(self.a["temperature"])).astype(np.float64), 9)

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.a)
        return out.getvalue()

    @staticmethod
    def unpack(data: bytes, p: Params) -> Model:
        with np.load(io.BytesIO(data)) as found:
            return Model(dict(found), p)


def _place(p: Params) -> type:
    return np.uint16 if p.buckets <= 1 << 16 else np.uint32


def neighbours(ids: np.ndarray, signs: np.ndarray, p: Params, context: np.ndarray) -> None:
    """Add to each bucket of ``context`` the signs of the words around its places in one text."""
    reach = 2 * p.window
    for lo in range(0, len(ids), 20_000):  # long texts in pieces; neighbours reach over the cuts
        part = ids[max(0, lo - reach) : lo + 20_000 + reach]
        index = signs[part]
        near = np.zeros((len(part), p.size), np.int16)
        for step in range(1, min(reach, len(part) - 1) + 1):
            near[step:] += index[:-step]
            near[:-step] += index[step:]
        first, size = min(lo, reach), min(20_000, len(ids) - lo)
        own = part[first : first + size]
        order = np.argsort(own, kind="stable")
        kinds, starts = np.unique(own[order], return_index=True)
        context[kinds] += np.add.reduceat(near[first : first + size][order], starts, axis=0, dtype=np.int64)


def word_vectors(words: DataFrame, p: Params) -> np.ndarray:
    """Index vectors and the unit sums of their neighbours' over all texts; the sums are whole numbers, so their order doesn't matter."""
    index, place, parts = index_vectors(p), _place(p), 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, signs = np.zeros((p.buckets, p.size), np.int64), np.sign(index).astype(np.int16)
        for batch in batches:
            for ids in batch.column(0).to_pylist():
                neighbours(np.frombuffer(ids, place), signs, p, context)
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(parts), pa.int32()), "sums": pa.array([c.tobytes() for c in np.array_split(context, parts)], pa.binary())})

    def summed(group: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(c, np.int64) for c in group.column("sums").to_pylist())
        return pa.table({"part": group.column("part").slice(0, 1), "sums": pa.array([sums.tobytes()], pa.binary())})

    schema = "part int, sums binary"
    found = words.select("ids").mapInArrow(run, schema).groupBy("part").applyInArrow(summed, schema).collect()
    context = np.frombuffer(b"".join(bytes(r.sums) for r in sorted(found, key=lambda r: r.part)), np.int64).reshape(-1, p.size).astype(np.float64) if found else np.zeros((p.buckets, p.size))
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    return (index + context / np.maximum(norm, 1e-9)).astype(np.float32)


#: The network's weights, in the order in which they are packed together.
WEIGHTS = ("w1", "b1", "w2", "b2")


def _shapes(p: Params) -> dict[str, tuple[int, ...]]:
    return {"w1": (2 * p.size + 3, p.hidden), "b1": (p.hidden,), "w2": (p.hidden,), "b2": ()}


def _joined(a: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([np.ravel(a[k]) for k in WEIGHTS])


def _parted(flat: np.ndarray, p: Params) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, shape in _shapes(p).items():
        size = math.prod(shape)
        out[k] = flat[at : at + size].reshape(shape)
        at += size
    return out


def epochs_of(z: np.ndarray, t: np.ndarray, state: np.ndarray, epochs: range, p: Params) -> np.ndarray:
    """Weights and their two moments, as three rows, after some epochs of Adam on the standardised rows of one block."""
    a, first, second = (_parted(row, p) for row in state)
    for epoch in epochs:
        hidden = np.tanh(z @ a["w1"] + a["b1"])
        error = (sigmoid(hidden @ a["w2"] + a["b2"]) - t) / len(t)
        back = np.outer(error, a["w2"]) * (1 - hidden * hidden)
        slopes = {"w1": z.T @ back + p.decay * a["w1"], "b1": back.sum(0), "w2": hidden.T @ error + p.decay * a["w2"], "b2": error.sum()}
        for k, slope in slopes.items():
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.999 * second[k] + 0.001 * slope**2
            a[k] = a[k] - p.rate * (first[k] / (1 - 0.9**epoch)) / (np.sqrt(second[k] / (1 - 0.999**epoch)) + 1e-8)
    return np.stack([_joined(a), _joined(first), _joined(second)])


def _over(blocks: DataFrame, work: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> list[tuple[int, np.ndarray]]:
    """For every block the number of rows that are fitted and what ``work(x, y, held)`` makes of it, in the order of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, x, y in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                label = np.frombuffer(y, np.int8).astype(np.float64)
                held = np.arange(len(label)) % 5 == 4  # every fifth row is kept for the temperature
                made = work(np.frombuffer(x, np.float32).reshape(len(label), -1).astype(np.float64), label, held)
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "n": pa.array([int((~held).sum())], pa.int64()), "made": pa.array([np.asarray(made, np.float64).tobytes()], pa.binary())})

    found = blocks.select("block", "x", "y").mapInArrow(run, "block long, n long, made binary").collect()
    return [(r.n, np.frombuffer(r.made)) for r in sorted(found, key=lambda r: r.block)]


def train(blocks: DataFrame, vectors: np.ndarray, many: bool, p: Params) -> Model:
    """The network fitted on all blocks (block, x, y), and its temperature."""
    width = 2 * p.size + 3
    sums = _over(blocks, lambda x, y, held: x[~held].sum(0))
    total = sum(n for n, _ in sums)
    mean = sum(s for _, s in sums) / total
    spread = sum(s for _, s in _over(blocks, lambda x, y, held: ((x[~held] - mean) ** 2).sum(0)))
    a = {"vectors": vectors, "mean": mean, "scale": np.sqrt(spread / total) + 1e-3}
    scale, rng = a["scale"], np.random.default_rng(p.seed)
    begun = {"w1": rng.normal(0, 1 / math.sqrt(width), (width, p.hidden)), "b1": np.zeros(p.hidden), "w2": rng.normal(0, 1 / math.sqrt(p.hidden), p.hidden), "b2": np.zeros(())}
    state = np.stack([_joined(begun), np.zeros_like(_joined(begun)), np.zeros_like(_joined(begun))])
    for epochs in np.array_split(np.arange(1, p.epochs + 1), p.merges if many else 1):
        span = range(int(epochs[0]), int(epochs[-1]) + 1) if len(epochs) else range(0)
        made = _over(blocks, lambda x, y, held: epochs_of((x[~held] - mean) / scale, y[~held], state, span, p))
        state = (sum(n * s for n, s in made) / total).reshape(3, -1)
    a |= _parted(state[0], p)
    grid = np.exp(np.linspace(-1.5, 2.5, 81))
    net = {k: v for k, v in a.items() if k != "vectors"}

    def losses(x: np.ndarray, y: np.ndarray, held: np.ndarray) -> np.ndarray:
        logit, t = Model(net, p).logits(x[held]), y[held]
        return np.array([-(t * np.log(sigmoid(logit / g) + 1e-12) + (1 - t) * np.log(1 - sigmoid(logit / g) + 1e-12)).sum() for g in grid])

    loss = sum(s for _, s in _over(blocks, losses))
    a["temperature"] = np.array(grid[int(np.argmin(loss))] if loss.any() else 1.0)
    return Model(a, p)


def fold(id_col: str) -> F.Column:
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, p: Params, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> bytes:
    """Train on the whole texts of all labelled documents that aren't held out, and return the packed model."""
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).filter("id IS NOT NULL AND label IN (0, 1)").groupBy("id").agg(F.min("label").alias("label"))
    known = known.filter(fold("id") != 0).withColumn("__key", F.xxhash64("id"))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("__key", F.xxhash64("id"))
    rows = among(texts, "__key", known.select("__key")).drop("__key").join(known.drop("__key"), "id").groupBy("id", "label", "text").agg(F.xxhash64("id", "text").alias("h"))

    def numbers():
        words = Words(p)
        return lambda found: [pa.array([words.ids(t).astype(_place(p)).tobytes() for t in found], pa.binary())]

    words = materialise(map_text(rows, numbers, [T.StructField("ids", T.BinaryType())], "text", ["h", "label"]), "words")
    totals = {r.label: r.n for r in words.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n = sum(totals.values())
    if len(totals) < 2:
        discard(words)
        return Model({"share": np.array(float(max(totals)) if totals else 0.5)}, p).pack()
    vectors, many = word_vectors(words, p), math.ceil(n / p.block_rows)
    shared, place = docs.sparkSession.sparkContext.broadcast(vectors), _place(p)  # buckets * size floats

    def features():
        return lambda found: [pa.array([pooled(np.frombuffer(ids, place), shared.value).tobytes() for ids in found], pa.binary())]

    def block(group: pa.Table) -> pa.Table:
        group = group.sort_by([("h", "ascending"), ("x", "ascending"), ("label", "ascending")])
        x, y = b"".join(group.column("x").to_pylist()), np.array(group.column("label").to_pylist(), np.int8).tobytes()
        return pa.table({"block": group.column("block").slice(0, 1), "x": pa.array([x], pa.binary()), "y": pa.array([y], pa.binary())})

    dealt = map_text(words, features, [T.StructField("x", T.BinaryType())], "ids", ["h", "label"]).withColumn("block", F.pmod("h", F.lit(many)))
    blocks = materialise(dealt.groupBy("block").applyInArrow(block, "block long, x binary, y binary"), "blocks")
    discard(words)
    model = train(blocks, vectors, many > 1, p).pack()
    discard(blocks)
    return model


def score(docs: DataFrame, model: bytes, p: Params, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add score and predicted to each row, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets * size floats

    def kernel():
        own = Model.unpack(shared.value, p)

        def apply(texts: list[str]) -> list[pa.Array]:
            found = own.scores(texts)
            return [pa.array(found, pa.float64()), pa.array((found >= p.threshold).astype(np.int32), pa.int32())]

        return apply

    return map_text(docs, kernel, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], text_col, keep)


def classify(docs: DataFrame, labels: DataFrame, p: Params | None = None, id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    p = p or Params()
    scored = score(docs, fit(docs, labels, p, id_col), p, keep=[id_col])
    return scored.select(F.col(f"`{id_col}`"), (fold(id_col) == 0).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, p: Params | None = None, id_col: str = "doc_id") -> DataFrame:
    """The documents that aren't rejected, with their own columns."""
    p = p or Params()
    own = {c: f"__own_{i}" for i, c in enumerate(docs.columns)}
    source = docs.select([F.col(f"`{c}`").alias(n) for c, n in own.items()])
    kept = score(source, fit(docs, labels, p, id_col), p, own["text"], list(own.values())).filter("predicted = 1")
    return kept.select([F.col(n).alias(c) for c, n in own.items()])
