"""Mixing sources to target weights (5): iterative proportional fitting, then calibrated sampling.

Documents are summed to cells of (source, language, topic). Raking multiplies the cells' sampling probabilities by
target / current for one margin after another until all three margins of tokens hold; a probability stays at 1 at most. A
document is kept if the hash of its id, read as a number in [0, 1), is below its cell's probability, so a sample is
reproducible and doesn't depend on the partitioning.

Targets may ask for more than there is, so they are first projected to what is feasible. Each margin by itself: a value
gets at most all of its tokens, and what it can't give is dealt to the others in proportion. All margins
together: the targets move toward the corpus' own margins, which are always feasible, by the least share (in steps of
1 / 2 ** ``HALVINGS``) at which raking meets all of them within ``TOLERANCE`` of all tokens wanted, in at most ``SWEEPS`` sweeps, each
``STEADY`` of which halve what is missing. ``blend`` is what is left of the
targets, 1 if all of them are met. ``margins`` reports for every value the target, the feasible and the reached tokens.

The steps are written once, over cells held by numpy in one task (up to ``LOCAL_CELLS``, sent back to the documents by
broadcast, both behind a count) or held as a DataFrame (any number; the join is left to the optimizer, which splits hot cells).

Edge cases: null in a margin is a value of its own; null and empty texts have no tokens and topic "none", take part
in no margin and share their cell's probability (1 in a cell without tokens); repeated ids are decided alike; target values that
don't occur are left out; an empty table gives an empty result; extra columns are carried, and clashing ones replaced
(``sample`` returns the documents' own columns, whatever their names).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import topics as topic_model
from .common import discard, materialise, without

LOCAL_CELLS = 50_000
SWEEPS = 100
#: Raking that doesn't halve what is missing in so many sweeps has no feasible targets.
STEADY = 10
TOLERANCE = 1e-5
HALVINGS = 6
MARGINS = ("source", "lang", "topic")
#: Null's place among the values of a margin.
MISSING = "\u0000null"

CELL = T.StructType([T.StructField("kind", T.StringType()), *(T.StructField(m, T.StringType()) for m in MARGINS), *(T.StructField(c, T.DoubleType()) for c in ("tokens", "prob", "target", "feasible", "reached", "blend"))])


class _Held:
    """Cells as numpy arrays: a code for each margin's value, and tokens."""

    def __init__(self, whole: pa.Table, powers, budget: float, targets: dict):
        self.budget, self.tokens = budget, whole.column("tokens").to_numpy().astype(np.float64)
        self.values, self.codes, self.own, self.target = [], [], [], []
        for m, power in zip(MARGINS, powers, strict=True):
            values, code = np.unique(np.array(whole.column(m).to_pylist(), object), return_inverse=True)
            own = np.bincount(code, self.tokens, len(values))
            raised = np.array([targets[m].get(v, 0.0) for v in values], np.float64) if targets.get(m) else np.where(own > 0, np.maximum(own, 1e-300) ** power, 0.0)
            raised = np.where(own > 0, raised, 0.0)
            self.values.append(values)
            self.codes.append(code)
            self.own.append(own)
            self.target.append(raised * (budget * own.sum() / max(raised.sum(), 1e-300)))
        self.most = [self._filled(t, own) for t, own in zip(self.target, self.own, strict=True)]

    def _filled(self, target: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The target with no value above its own tokens: what is cut off goes to the others in proportion."""
        out, full, goal = target.copy(), np.zeros(len(own), bool), self.budget * own.sum()
        while (over := ~full & (out > own)).any():
            full |= over
            rest = target[~full].sum()
            out = np.where(full, own, target * (max(0.0, goal - own[full].sum()) / rest if rest > 0 else 0.0))
        return out

    def begin(self, blend: float) -> None:
        self.want = [blend * most + (1 - blend) * self.budget * own for most, own in zip(self.most, self.own, strict=True)]
        self.prob = np.full(len(self.tokens), self.budget)

    def _now(self, code: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(code, self.tokens * self.prob, size)

    def sweep(self) -> float:
        for code, want in zip(self.codes, self.want, strict=True):
            now = self._now(code, len(want))
            ratio = np.where(now > 0, want / np.maximum(now, 1e-300), 1.0)
            self.prob = np.minimum(self.prob * ratio[code], 1.0)
        total = max(self.budget * self.tokens.sum(), 1e-300)
        return max((float(np.abs(self._now(code, len(want)) - want).max(initial=0)) / total for code, want in zip(self.codes, self.want, strict=True)), default=0.0)

    def table(self, blend: float) -> pa.Table:
        rows = {f.name: [] for f in CELL}
        n = len(self.tokens)
        cells = {"kind": ["cell"] * n, "tokens": self.tokens, "prob": np.where(self.tokens > 0, self.prob, 1.0), **{m: v[c] for m, v, c in zip(MARGINS, self.values, self.codes, strict=True)}}
        parts = [cells]
        for m, values, own, target, want, code in zip(MARGINS, self.values, self.own, self.target, self.want, self.codes, strict=True):
            parts.append({"kind": [m] * len(values), m: values, "tokens": own, "target": target, "feasible": want, "reached": self._now(code, len(values))})
        for part in parts:
            size = len(part["kind"])
            for name in rows:
                rows[name] += [blend] * size if name == "blend" else list(part.get(name, [None] * size))
        return pa.table({f.name: pa.array(rows[f.name], pa.string() if f.dataType == T.StringType() else pa.float64()) for f in CELL})


class _Frames:
    """The same cells as DataFrames; each sweep is written once and replaces the one before."""

    def __init__(self, cells: DataFrame, powers, budget: float, targets: dict):
        self.budget, self.cells = budget, cells.select(*MARGINS, F.col("tokens").cast("double").alias("tokens"))
        self.total = cells.agg(F.sum("tokens")).first()[0] or 0.0
        self.goal = budget * self.total
        self.margins = {}
        for m, power in zip(MARGINS, powers, strict=True):
            sums = self.cells.groupBy(m).agg(F.sum("tokens").alias("own"))
            if targets.get(m):
                given = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in targets[m].items()], f"{m} string, raised double")
                sums = sums.join(F.broadcast(given), m, "left").fillna(0.0, ["raised"])
            else:
                sums = sums.withColumn("raised", F.pow("own", F.lit(power)))
            sums = materialise(sums.withColumn("raised", F.when(F.col("own") > 0, F.col("raised")).otherwise(0.0)), "margin")
            scale = sums.agg(F.sum("raised")).first()[0] or 1e-300
            target = sums.select(m, "own", (F.col("raised") * (self.goal / scale)).alias("target"))
            self.margins[m] = materialise(self._filled(target), "margin")
            discard(sums)
        self.prob = self.want = None

    def _filled(self, target: DataFrame) -> DataFrame:
        scale = 1.0
        while True:
            over = F.col("target") * scale > F.col("own")
            found = target.agg(F.sum(F.when(over, F.col("own")).otherwise(0.0)).alias("full"), F.sum(F.when(over, 0.0).otherwise(F.col("target"))).alias("rest")).first()
            then = max(0.0, self.goal - (found.full or 0.0)) / found.rest if found.rest else scale
            if not then > scale:
                return target.withColumn("most", F.least(F.col("target") * scale, "own"))
            scale = then

    def begin(self, blend: float) -> None:
        want = blend * F.col("most") + (1 - blend) * self.budget * F.col("own")
        self.want = {m: t.select(m, want.alias("want")) for m, t in self.margins.items()}
        discard(self.prob)
        self.prob = self.cells.withColumn("prob", F.lit(float(self.budget)))

    def _now(self, rows: DataFrame, m: str) -> DataFrame:
        return rows.groupBy(m).agg(F.sum(F.col("tokens") * F.col("prob")).alias("now")).join(self.want[m], m)

    def sweep(self) -> float:
        rows = self.prob
        for m in MARGINS:
            ratio = self._now(rows, m).select(m, F.when(F.col("now") > 0, F.col("want") / F.col("now")).otherwise(1.0).alias("ratio"))
            rows = rows.join(ratio, m).withColumn("prob", F.least(F.col("prob") * F.col("ratio"), F.lit(1.0))).drop("ratio")
        before, self.prob = self.prob, materialise(rows, "raked")
        discard(before)
        off = reduce(DataFrame.unionByName, [self._now(self.prob, m).select(F.abs(F.col("now") - F.col("want")).alias("off")) for m in MARGINS])
        return (off.agg(F.max("off")).first()[0] or 0.0) / max(self.goal, 1e-300)

    def table(self, blend: float) -> DataFrame:
        parts = [self.prob.select(F.lit("cell").alias("kind"), *MARGINS, "tokens", F.when(F.col("tokens") > 0, F.col("prob")).otherwise(1.0).alias("prob"))]
        for m in MARGINS:
            parts.append(self._now(self.prob, m).join(self.margins[m], m).select(F.lit(m).alias("kind"), m, F.col("own").alias("tokens"), "target", F.col("want").alias("feasible"), F.col("now").alias("reached")))
        every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).withColumn("blend", F.lit(float(blend)))
        return every.select(*[F.col(f.name).cast(f.dataType) for f in CELL])


def rake(cells: _Held | _Frames) -> float:
    """Fit the cells' probabilities; returns how much of the targets was kept."""

    def meets(blend: float) -> bool:
        cells.begin(blend)
        mark = math.inf
        for n in range(SWEEPS):
            off = cells.sweep()
            if off < TOLERANCE:
                return True
            if n % STEADY == STEADY - 1:
                if off > mark / 2:
                    return False
                mark = off
        return False

    if meets(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(HALVINGS):
        mid = (low + high) / 2
        low, high = (mid, high) if meets(mid) else (low, mid)
    meets(low)
    return low


def _rake_here(cells: DataFrame, powers, budget: float, targets: dict) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if rows := list(batches):
            held = _Held(pa.Table.from_batches(rows), powers, budget, targets)
            yield from held.table(rake(held)).combine_chunks().to_batches()

    ordered = cells.select(*MARGINS, F.col("tokens").cast("double").alias("tokens")).repartition(1).sortWithinPartitions(*MARGINS)
    return ordered.mapInArrow(run, CELL)


def _rake_frames(cells: DataFrame, powers, budget: float, targets: dict) -> DataFrame:
    frames = _Frames(cells, powers, budget, targets)
    return frames.table(rake(frames))


def mix_and_report(
    docs: DataFrame,
    budget: float = 0.5,
    powers: tuple[float, float, float] = (0.7, 0.7, 0.7),
    targets: dict[str, dict[str, float]] | None = None,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    topic: F.Column | None = None,
    topics: topic_model.Params | None = None,
    local_cells: int = LOCAL_CELLS,
    keep: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``mix`` and the margins: margin, value, tokens, target, feasible, reached (tokens) and blend."""
    targets = targets or {}
    kept = list(dict.fromkeys([*(docs.columns if keep is None else keep), id_col, source_col, lang_col]))
    p = topics or topic_model.Params()
    base = docs if topic is None else docs.withColumn("__given", topic)
    base = topic_model.count(base, p, id_col, text_col, kept + ["__given"] * (topic is not None), "__n")
    model = topic_model.fit(base, p) if topic is None else None
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING))

    def placed(columns: list[str]) -> DataFrame:
        rows = base if topic is not None else topic_model.assign(base, model, p, columns, "__topic")
        return rows.withColumns({"__source": value(f"`{source_col}`"), "__lang": value(f"`{lang_col}`"), "__topic": value("__topic" if topic is None else "__given")})

    cells = placed(list(dict.fromkeys([source_col, lang_col, "__n"]))).groupBy(*[F.col(f"__{m}").alias(m) for m in MARGINS]).agg(F.sum("__n").alias("tokens"))
    cells = materialise(cells, "cells")
    few = cells.limit(local_cells + 1).count() <= local_cells
    raked = materialise((_rake_here if few else _rake_frames)(cells, powers, budget, targets), "probabilities")
    discard(cells)
    found = raked.filter("kind = 'cell'").select(*[F.col(m).alias(f"__{m}") for m in MARGINS], F.col("prob").alias("__p"), F.col("blend").alias("__blend"))
    joined = placed([*kept, "__n"]).join(F.broadcast(found) if few else found, [f"__{m}" for m in MARGINS], "left")
    draw = F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    out = joined.withColumn("__keep", draw < F.col("__p"))
    added = ["n_tokens", "topic", "prob", "weight", "keep", "blend"]
    carried = without(out.select([F.col(f"`{c}`") for c in kept if keep is None or c in keep]), added).columns
    mixed = out.select(
        *[F.col(f"`{c}`") for c in carried], F.col("__n").alias("n_tokens"), F.col("__topic").alias("topic"), F.col("__p").alias("prob"),
        F.when(F.col("__keep"), 1 / F.col("__p")).alias("weight"), F.col("__keep").alias("keep"), F.col("__blend").alias("blend"),
    )
    report = raked.filter("kind <> 'cell'").select(F.col("kind").alias("margin"), F.coalesce(*MARGINS).alias("value"), "tokens", "target", "feasible", "reached", "blend")
    return mixed, report


def mix(docs: DataFrame, *args, **more) -> DataFrame:
    """Add n_tokens, topic, prob, weight (1 / prob of the kept), keep and blend to every document.

    ``powers`` temper the margins' own shares, in the order source, lang, topic: 1 keeps a margin as it is, 0 makes it
    even; ``targets`` gives shares by value instead, for any margin; ``topic`` is a column to take for the topic. ``keep`` names
    the columns to carry.
    """
    return mix_and_report(docs, *args, **more)[0]


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", **more) -> DataFrame:
    """The documents of the sample, with their own columns."""
    own = {c: f"__own_{i}" for i, c in enumerate(docs.columns)}
    source = docs.select([F.col(f"`{c}`").alias(n) for c, n in own.items()])
    mixed = mix(source, id_col=own[id_col], text_col=own[text_col], source_col=own[source_col], lang_col=own[lang_col], **more)
    return mixed.filter("keep").select([F.col(n).alias(c) for c, n in own.items()])
