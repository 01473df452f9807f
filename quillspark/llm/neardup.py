"""MinHash near-dedup (1) with SetSketch registers.

A document's set is its distinct word shingles. A register keeps the smallest of the set's hashes,
truncated to an exponential scale: K = floor(1 + log_b(a / E)) of a minimum E that is
exponentially distributed. Registers of a union are the larger ones of both sets, so sketches merge;
equal registers grow likelier with similarity, so bands of registers are keys of
candidates; and how often registers are larger, smaller and equal gives, with the sets' sizes, a joint likelihood of the
similarity. Candidates whose most likely similarity is clearly too low go; the rest is
verified on the full sets of word sequences.

Documents of equal sets are one class from the start. Classes that share a band's registers form a
bucket. No bucket's pairs are all compared on the plain: first, in each bucket, every class is
paired with two others (large buckets in salted parts, whose leaders are paired again), and the
verified pairs are joined to components. Any link still missing then crosses components. Only where a
bucket holds several components, the members outside its largest one are compared with all members of other components, in
blocks bounded by rows and bytes, by sketches and then by full sets, so that no link of a bucket that joins components is lost; a block
reports only links that join something. Texts are shuffled only for documents that stand in a pair.

Pairs outside blocks are verified on the sets of word sequences themselves; blocks compare the full sets of 64-bit hashes of
these sequences, and equal hashes of all sequences (128 bits) make a class. Among n different sequences two have equal 64-bit
hashes with a probability of n * n / 2^65, 3e-8 for a million.

Edge cases: null and empty texts and those without words have the empty set (n_shingles 0) and link with nothing; a text with
fewer words than a shingle has one shingle, all its words; rows of null id are returned with null component and take no part; an
id that repeats is one vertex: all its rows' sets link, and all its rows have its component; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .buckets import crossing, first_pairs, shared_buckets
from .common import among, discard, map_text, materialise, remove
from .components import connected_components

BASE = 1.15
RATE = 20.0
BANDS = 28
ROWS = 5
REGISTERS = BANDS * ROWS
#: Verified pairs that each member proposes at most in the first pass; the second pass is complete.
PROPOSED = 6
MEMO = 200_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_rng = np.random.default_rng(20210)
_XOR = _rng.integers(0, 1 << 64, REGISTERS, dtype=np.uint64)
_MUL = _rng.integers(0, 1 << 64, REGISTERS, dtype=np.uint64) | np.uint64(1)
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingles(words: list[bytes], k: int) -> set[tuple[bytes, ...]]:
    if not words:
        return set()
    return {tuple(words)} if len(words) < k else set(zip(*(words[i:] for i in range(k)), strict=False))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _M1
    x = (x ^ (x >> np.uint64(32))) * _M2
    return x ^ (x >> np.uint64(31))


class Sketcher:
    def __init__(self, k: int):
        self.k, self.known = k, {}

    def hashes(self, text: str) -> np.ndarray:
        """A 64-bit hash of each different shingle, sorted."""
        if len(self.known) > MEMO:
            self.known.clear()
        known, found = self.known, []
        for word in words_of(text):
            h = known.get(word)
            if h is None:
                h = known[word] = xxhash.xxh64_intdigest(word)
            found.append(h)
        if not found:
            return np.zeros(0, np.uint64)
        x = np.array(found, np.uint64)
        n = max(1, len(x) - self.k + 1)
        span = min(self.k, len(x))
        out = np.full(n, span, np.uint64)
        for i in range(span):
            out = _mix(out * _M3 + x[i : i + n])
        return np.unique(out)

    def registers(self, x: np.ndarray) -> bytes:
        least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
        for lo in range(0, len(x), 1024):
            np.minimum(least, ((x[lo : lo + 1024, None] ^ _XOR) * _MUL).min(0), out=least)
        return truncate(least).tobytes()


def truncate(least: np.ndarray) -> np.ndarray:
    """Registers of minima of uniform 64-bit hashes."""
    e = -np.log1p(-np.minimum((least.astype(np.float64) + 0.5) / 2.0**64, 1 - 2.0**-53))
    return np.clip(np.floor(1 + np.log(RATE / e) / math.log(BASE)), 0, 255).astype(np.uint8)


def merge(one: bytes, two: bytes) -> bytes:
    """The sketch of the union."""
    return np.maximum(np.frombuffer(one, np.uint8), np.frombuffer(two, np.uint8)).tobytes()


def likely(na: np.ndarray, nb: np.ndarray, more: np.ndarray, less: np.ndarray, least: float | np.ndarray) -> np.ndarray:
    """Is the most likely Jaccard similarity at least ``least``?

    The joint log-likelihood of how many registers are larger (``more``) and smaller (``less``) in the first sketch is
    concave in the similarity, so the sign of its slope at ``least`` tells on which side the maximum lies.
    """
    u = na / (na + nb)
    v = 1 - u
    c, log_b = (BASE - 1) / BASE, math.log(BASE)
    x, y = np.maximum(u - v * least, 1e-9), np.maximum(v - u * least, 1e-9)
    px, py = -np.log1p(-x * c) / log_b, -np.log1p(-y * c) / log_b
    dx, dy = c / (log_b * (1 - x * c)), c / (log_b * (1 - y * c))
    equal = REGISTERS - more - less
    return equal * (v * dx + u * dy) / np.maximum(1 - px - py, 1e-9) - more * v * dx / px - less * u * dy / py >= 0


def estimate(na: np.ndarray, nb: np.ndarray, more: np.ndarray, less: np.ndarray) -> np.ndarray:
    """The most likely similarity, by halving."""
    lo, hi = np.zeros(len(na)), np.minimum(na, nb) / np.maximum(na, nb)
    for _ in range(12):
        mid = (lo + hi) / 2
        up = likely(na, nb, more, less, mid)
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    return (lo + hi) / 2


def _floor(percent: int) -> float:
    """Four and a half standard deviations of the estimate below the threshold."""
    j = percent / 100
    return max(0.0, j - 4.5 * math.sqrt(j * (1 - j) / REGISTERS))


def sketches(rows: DataFrame, k: int) -> DataFrame:
    """n, key (the set's fingerprint) and sketch of every row of (row, id, text), instead of the text."""

    def kernel():
        own = Sketcher(k)

        def apply(texts: list[str]) -> list[pa.Array]:
            sizes, keys, registers = [], [], []
            for text in texts:
                x = own.hashes(text)
                sizes.append(len(x))
                keys.append(xxhash.xxh3_128_digest(x.tobytes()))
                registers.append(own.registers(x))
            return [pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(registers, pa.binary())]

        return apply

    fields = [T.StructField("n", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("sketch", T.BinaryType())]
    return map_text(rows, kernel, fields, keep=["row", "id"])


def _bands() -> F.Column:
    """The keys of a sketch's bands."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(F.substring(F.col("sketch"), (i * ROWS + 1).cast("int"), F.lit(ROWS)), i))


def _rough(pairs: DataFrame, percent: int) -> DataFrame:
    """Of pairs with sizes and sketches those that may be similar enough, with their estimate."""
    floor = _floor(percent)
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("guess", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            na, nb = batch.column("na").to_numpy().astype(float), batch.column("nb").to_numpy().astype(float)
            ka, kb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in ("sa", "sb"))
            more, less = (ka > kb).sum(1), (ka < kb).sum(1)
            ok = (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & likely(na, nb, more, less, floor)
            guess = estimate(na[ok], nb[ok], more[ok], less[ok])
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok]), pa.array(guess)], names=["a", "b", "guess"])

    return pairs.mapInArrow(run, schema)


def _verified(pairs: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b, ok: the written pairs compared on the full sets of word sequences."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    texts = materialise(among(rows.select("row", "text"), "row", ends), "texts")
    one = pairs.join(texts.select(F.col("row").alias("a"), F.col("text").alias("ta")), "a")
    two = one.join(texts.select(F.col("row").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("ok", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, set()
        for batch in batches:
            ok = []
            for i in range(batch.num_rows):
                ta, tb = batch.column(2)[i].as_py(), batch.column(3)[i].as_py()
                if tb != last:
                    last, known = tb, shingles(words_of(tb or ""), k)
                other = shingles(words_of(ta or ""), k)
                both = len(known & other)
                ok.append(both > 0 and 100 * both >= percent * (len(known) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    out = materialise(two.mapInArrow(run, schema), "verified")
    discard(texts)
    return out


def common(one: np.ndarray, two: np.ndarray) -> int:
    """How many values two sorted arrays of different values share."""
    if len(one) > len(two):
        one, two = two, one
    if not len(one):
        return 0
    at = np.searchsorted(two, one)
    return int((two[np.minimum(at, len(two) - 1)] == one).sum())


def _in_block(percent: int):
    """Verified links between components of one block, enough to join what they join.

    Pairs go through the sizes and the sketches first, most likely first; then the full sets of shingle
    hashes are compared, unless the two are joined already. A pair is left to the first band that its sketches share, so no
    pair is compared twice.
    """
    floor = _floor(percent)

    def compare(block: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        asks = block.column("asks").to_numpy(zero_copy_only=False)
        ids, comps, n, bands = (block.column(c).to_numpy() for c in ("id", "c", "n", "band"))
        sketch = np.frombuffer(b"".join(block.column("sketch").to_pylist()), np.uint8).reshape(-1, REGISTERS)
        raw = block.column("hashes")

        def full(row: int) -> np.ndarray:
            return np.frombuffer(raw[row].as_buffer(), np.uint64)

        root: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = c = root.get(up, up)
            return c

        ask, told = np.flatnonzero(asks), np.flatnonzero(~asks)
        step = max(1, 2_000_000 // (REGISTERS * max(1, len(told))))
        one_found, two_found = [], []
        for lo in range(0, len(ask), step):
            one = ask[lo : lo + step]
            most, least = np.maximum(n[one][:, None], n[told]), np.minimum(n[one][:, None], n[told])
            r, s = np.nonzero((comps[one][:, None] != comps[told]) & (100 * least >= percent * most))
            if not len(r):
                continue
            x, y = one[r], told[s]
            ka, kb = sketch[x], sketch[y]
            first = (ka == kb).reshape(-1, BANDS, ROWS).all(2).argmax(1)
            more, less = (ka > kb).sum(1), (ka < kb).sum(1)
            na, nb = n[x].astype(float), n[y].astype(float)
            keep = np.flatnonzero((first == bands[x]) & likely(na, nb, more, less, floor))
            keep = keep[np.argsort((more + less)[keep], kind="stable")]
            for i, j in zip(x[keep].tolist(), y[keep].tolist(), strict=True):
                a, b = find(int(comps[i])), find(int(comps[j]))
                if a != b:
                    both = common(full(i), full(j))
                    if 100 * both >= percent * (n[i] + n[j] - both):
                        root[a] = b
                        one_found.append(ids[i])
                        two_found.append(ids[j])
        yield np.array(one_found, np.int64), np.array(two_found, np.int64)

    return compare


def _with_hashes(reps: DataFrame, ids: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """id, n, sketch and the full set's shingle hashes of the wanted classes."""

    def kernel():
        own = Sketcher(k)
        return lambda texts: [pa.array([own.hashes(t).tobytes() for t in texts], pa.binary())]

    texts = among(rows.select(F.col("row").alias("id"), "text"), "id", ids)
    hashed = map_text(texts, kernel, [T.StructField("hashes", T.BinaryType())], keep=["id"])
    return reps.select("id", "n", "sketch").join(ids, "id").join(hashed, "id")


def _addressed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """(row, id, text) with a number for each row: its id, unless an id repeats. And whether one does."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    if rows.filter("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("m")).filter("m > 1").isEmpty():
        return rows.withColumn("row", F.col("id")), False
    return materialise(rows.withColumn("row", F.monotonically_increasing_id()), "rows"), True


def _same_id(every: DataFrame, reps: DataFrame) -> DataFrame:
    """a, b: links between the classes of the rows that share an id."""
    held = every.filter("n > 0 AND id IS NOT NULL")
    several = held.groupBy("id").agg(F.min("key").alias("k0"), F.max("key").alias("k1")).filter("k0 <> k1").select("id", "k0")
    met = held.select("id", "key").join(several, "id").filter("key <> k0").select("key", "k0").distinct()
    named = reps.select("key", "id")
    return met.join(named.withColumnRenamed("id", "a"), "key").join(named.select(F.col("key").alias("k0"), F.col("id").alias("b")), "k0").select("a", "b")


def groups(rows: DataFrame, k: int, percent: int, ids_join: bool) -> DataFrame:
    """row, id, n and component of every row of (row, id, text); the component is the smallest row of a group, null for empty sets.

    Rows of null ``row`` take no part. ``ids_join``: rows that share an id belong together whatever their texts.
    """
    every = materialise(sketches(rows, k), "sketches")
    classes = every.filter("n > 0 AND row IS NOT NULL").groupBy("key").agg(F.min(F.struct("row", "n", "sketch")).alias("r")).select("key", F.col("r.row").alias("id"), "r.n", "r.sketch")
    reps = materialise(classes, "classes")
    members = shared_buckets(reps.select(F.posexplode(_bands()).alias("band", "bucket"), "id"))

    def sketched(pairs: DataFrame) -> DataFrame:
        one = pairs.join(reps.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
        return one.join(reps.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")

    guessed = _rough(sketched(first_pairs(members).select(F.col("owner").alias("a"), F.col("other").alias("b"))), percent)
    best = Window.partitionBy("a").orderBy(F.desc("guess"), "b")  # at most two pairs a band stand under an owner
    chosen = guessed.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= PROPOSED).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    first = _verified(materialise(chosen, "chosen"), rows, k, percent)
    links = first.filter("ok").select("a", "b")
    if ids_join:
        links = materialise(links.unionByName(_same_id(every, reps)), "links")
    components = connected_components(links)
    weights = reps.select("id", (F.col("n") * 8 + 2 * REGISTERS).alias("bytes"))
    small, large = crossing(members, components, weights, lambda ids: _with_hashes(reps, ids, rows, k), _in_block(percent))
    discard(members)
    missing = materialise(_rough(sketched(small.join(first.select("a", "b"), ["a", "b"], "left_anti")), percent).select("a", "b"), "missing")
    second = materialise(_verified(missing, rows, k, percent).filter("ok").select("a", "b").unionByName(large), "links")
    discard(small, large, missing)
    if not second.isEmpty():
        components = connected_components(links.unionByName(second))
    named = materialise(reps.select("key", "id").join(components, "id", "left").select("key", F.coalesce("component", "id").alias("component")), "named")
    discard(first, second, reps)
    return every.select("row", "id", "n", "key").join(named, "key", "left").select("row", "id", "n", F.when(F.col("row").isNotNull(), F.col("component")).alias("component"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id and kept of every row; links need ``percent`` of Jaccard similarity."""
    rows, repeated = _addressed(docs, id_col, text_col)
    if repeated:
        rows = rows.withColumn("row", F.when(F.col("id").isNotNull(), F.col("row")))
        found = materialise(groups(rows, k, percent, True), "groups")
        least = found.filter("component IS NOT NULL").groupBy("component").agg(F.min("id").alias("least"))
        named = materialise(found.filter("id IS NOT NULL").join(least, "component", "left").groupBy("id").agg(F.min(F.coalesce("least", "id")).alias("component_id")), "named")
        found = found.select("id", "n").join(named, "id", "left")
    else:
        found = groups(rows, k, percent, False).withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")))
    component = F.col("component_id")
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, with its own columns.

    Rows of null id, and different texts under one id, are compared and decided each for itself; of a group's
    rows one that has an id stays if there is any, that of the smallest id. Documents without words stay, one for each id.
    """
    own = {c: f"__own_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select([F.col(f"`{c}`").alias(n) for c, n in own.items()])
    number = F.col(own[id_col]).cast("long")
    if rows.groupBy(number.alias("id")).agg(F.count("*").alias("m")).filter("m > 1 OR id IS NULL").isEmpty():
        rows = rows.withColumn("__row", number)
    else:
        rows = materialise(rows.withColumn("__row", F.monotonically_increasing_id()), "rows")
    found = materialise(groups(rows.select(F.col("__row").alias("row"), number.alias("id"), F.col(own[text_col]).alias("text")), k, percent, False), "groups")
    kind = F.when(F.col("component").isNotNull(), 0).when(F.col("id").isNotNull(), 1).otherwise(2).alias("kind")
    chosen = found.groupBy(kind, F.coalesce("component", "id", "row").alias("of")).agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))["row"].alias("row"))
    dropped = materialise(found.select("row").join(chosen.select("row"), "row", "left_anti"), "dropped")
    return remove(rows, "__row", dropped).select([F.col(n).alias(c) for c, n in own.items()])
