"""Chunking: one document row to many chunk rows, by interchangeable strategies.

``fixed`` is a column expression. The other strategies run a kernel in one Arrow
pass over whole texts; no strategy shuffles. Kernels are registered by name, so users can add their own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import spans as S
from ..functions import structure as B
from ..functions.embedding import Provider
from ..functions.semantic import THRESHOLDS, explain, semantic_spans
from ..functions.tokens import Tokenizer, token_spans
from ..session import spread

_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "boolean": T.BooleanType()}
CHUNK = T.StructType([
    T.StructField(name, _KINDS[kind])
    for name, kind in (
        ("document_id", "string"), ("chunk_id", "string"), ("chunk_index", "int"), ("text", "string"), ("start", "int"), ("end", "int"),
        ("strategy", "string"), ("parent_id", "string"), ("level", "int"), ("retrievable", "boolean"), ("context_id", "string"), ("section_path", "string"),
    )
])

CONTEXT = T.StructField("context_text", T.StringType())
_FIELDS = [pa.field(f.name, {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[f.dataType.simpleString()]) for f in (*CHUNK, CONTEXT)]

#: Parameters of each strategy as they are configured by default; kernels have defaults of their own.
DEFAULT_PARAMS: dict[str, dict[str, Any]] = {
    "fixed": {"chunk_size": 500, "overlap": 50},
    "sliding_window": {"window_size": 100, "step": 75},
    "sentence": {"max_chars": 500, "overlap_sentences": 1},
    "recursive": {"chunk_size": 500, "overlap": 0},
    "token": {"max_tokens": 128, "overlap_tokens": 16},
    "semantic": {"buffer_size": 1, "threshold_type": "percentile", "breakpoint_threshold": 85.0, "max_chars": 1000, "min_chars": 150, "respect_headings": True, "keep_references": True},
    "structure": {"max_chars": 1000, "min_section_chars": 200},
    "metadata_aware": {},
    "parent_child": {"parent_size": 2000, "child_size": 400, "child_overlap": 0},
    "hierarchical": {"section_max_chars": 3000, "paragraph_max_chars": 1000, "chunk_size": 400, "context_level": "section"},
}
ALIASES = {"markdown": "structure", "fixed_size": "fixed", "parent-child": "parent_child"}

#: Routes by source type, for texts whose metadata decides.
DEFAULT_RULES: list[dict[str, Any]] = [
    {"when": {"source_type": ["csv", "json"]}, "strategy": "recursive", "params": {"chunk_size": 500, "separators": ["line", "word"]}},
    {"when": {"source_type": ["markdown", "html", "docx"]}, "strategy": "structure", "params": {"max_chars": 1000}},
]
DEFAULT_FALLBACK: dict[str, Any] = {"strategy": "recursive", "params": {"chunk_size": 500}}


@dataclass
class Piece:
    """A chunk of one text: its name within the document is ``stem`` and ``number``."""

    stem: str
    number: int
    start: int
    end: int
    lead: str = ""
    path: str | None = None
    level: int | None = None
    parent: str | None = None
    context: str | None = None
    retrievable: bool = True

    @property
    def name(self) -> str:
        return f"{self.stem}_{self.number}"


Kernel = Callable[..., list[Piece]]


@dataclass(frozen=True)
class Strategy:
    kernel: Kernel
    provides_context: bool = False
    needs_provider: bool = False


_registry: dict[str, Strategy] = {}


def register(name: str, provides_context: bool = False, needs_provider: bool = False) -> Callable[[Kernel], Kernel]:
    """Make ``kernel(text, **params) -> list[Piece]`` a strategy."""

    def add(kernel: Kernel) -> Kernel:
        _registry[name] = Strategy(kernel, provides_context, needs_provider)
        return kernel

    return add


def strategies() -> list[str]:
    return sorted({*_registry, "metadata_aware"})


def find(name: str) -> tuple[str, Strategy]:
    name = ALIASES.get(name, name)
    if name not in _registry:
        raise ValueError(f"unknown chunking strategy {name!r}; there are {', '.join(strategies())}")
    return name, _registry[name]


def _positive(**sizes: int) -> None:
    for name, value in sizes.items():
        if value <= 0:
            raise ValueError(f"{name} must be greater than zero")


def _within(overlap: int, size: int, name: str = "chunk_size") -> None:
    if not 0 <= overlap < size:
        raise ValueError(f"the overlap must be at least zero and less than {name}")


def check_params(name: str, params: dict[str, Any]) -> None:
    """Refuse sizes that make no sense before any job starts."""
    p = {**DEFAULT_PARAMS.get(name, {}), **params}
    _positive(**{k: p[k] for k in ("chunk_size", "max_chars", "max_tokens", "window_size", "step", "parent_size", "child_size", "section_max_chars", "paragraph_max_chars", "batch_size") if k in p})
    for overlap, size in (("overlap", "chunk_size"), ("overlap_tokens", "max_tokens"), ("child_overlap", "child_size")):
        if overlap in p and size in p:
            _within(p[overlap], p[size], size)
    if name == "sliding_window" and p["step"] > p["window_size"]:
        raise ValueError("words between two windows would be lost: step must be at most window_size")
    if name == "sentence" and p["overlap_sentences"] < 0:
        raise ValueError("overlap_sentences cannot be negative")
    if name == "parent_child" and p["child_size"] > p["parent_size"]:
        raise ValueError("a child must not be larger than its parent: child_size > parent_size")
    if name == "hierarchical":
        if not p["chunk_size"] <= p["paragraph_max_chars"] <= p["section_max_chars"]:
            raise ValueError("sizes must satisfy chunk_size <= paragraph_max_chars <= section_max_chars")
        if p["context_level"] not in ("section", "paragraph"):
            raise ValueError("context_level must be section or paragraph")
    if name == "semantic":
        if p["threshold_type"] not in THRESHOLDS:
            raise ValueError(f"threshold_type must be one of {', '.join(THRESHOLDS)}")
        if p["buffer_size"] < 0 or p["min_chars"] < 0 or p["min_chars"] > p["max_chars"]:
            raise ValueError("buffer_size and min_chars cannot be negative, nor min_chars exceed max_chars")


def _chunks(spans: list[S.Span]) -> list[Piece]:
    return [Piece("chunk", n, a, b) for n, (a, b) in enumerate(spans)]


@register("fixed")
def fixed(text: str, chunk_size: int = 500, overlap: int = 50) -> list[Piece]:
    _positive(chunk_size=chunk_size)
    _within(overlap, chunk_size)
    last = max(0, -(-(len(text) - chunk_size) // (chunk_size - overlap)))
    return _chunks([(i * (chunk_size - overlap), min(i * (chunk_size - overlap) + chunk_size, len(text))) for i in range(last + 1)])


@register("sliding_window")
def sliding_window(text: str, window_size: int = 100, step: int = 75) -> list[Piece]:
    words = [m.span() for m in re.finditer(r"\S+", text)]
    last = max(0, len(words) - window_size)
    firsts = sorted({*range(0, last + 1, step), last})
    return _chunks([(words[f][0], words[min(f + window_size, len(words)) - 1][1]) for f in firsts])


@register("sentence")
def sentence(text: str, max_chars: int = 500, overlap_sentences: int = 0) -> list[Piece]:
    return _chunks(S.windows_of_sentences(S.fitted_sentences(text, max_chars), max_chars, overlap_sentences))


@register("recursive")
def recursive(text: str, chunk_size: int = 500, overlap: int = 0, separators: list[str] | None = None) -> list[Piece]:
    return _chunks(S.recursive(text, 0, len(text), chunk_size, overlap, separators))


@register("token")
def token(text: str, max_tokens: int = 128, overlap_tokens: int = 16, tokenizer: Tokenizer | None = None) -> list[Piece]:
    return _chunks(token_spans(text, max_tokens, overlap_tokens, tokenizer))


@register("semantic", needs_provider=True)
def semantic(text: str, provider: Provider | None = None, **params: Any) -> list[Piece]:
    if provider is None:
        raise ValueError("the semantic strategy needs an embedding provider")
    return _chunks(semantic_spans(text, provider, **params))


def _lead(path: tuple[str, ...], heading: B.Block | None, start: int) -> str:
    """The heading path before a chunk that doesn't begin with its only heading."""
    alone = heading is not None and start == heading.start and len(path) == 1
    return "" if alone or not path else " > ".join(path) + "\n"


@register("structure")
def structure(text: str, max_chars: int = 1000, min_section_chars: int = 200, include_section_path: bool = True, detect_plain_headings: bool = True) -> list[Piece]:
    found: list[Piece] = []
    outline = B.Outline(text, detect_plain_headings)
    for group in outline.groups(min_section_chars, max_chars):
        path, heading = group[0].path, outline.heading(group[0])
        for a, b in S.pack(outline.pieces(group, max_chars), max_chars):
            found.append(Piece("chunk", len(found), a, b, _lead(path, heading, a) if include_section_path else "", " > ".join(path) or None))
    return found


@register("parent_child", provides_context=True)
def parent_child(text: str, parent_size: int = 2000, child_size: int = 400, child_overlap: int = 0) -> list[Piece]:
    found: list[Piece] = []
    children = 0
    for n, (a, b) in enumerate(S.recursive(text, 0, len(text), parent_size)):
        parent = Piece("parent", n, a, b, level=0, retrievable=False)
        own = S.recursive(text, a, b, child_size, child_overlap)
        found += [parent, *(Piece("chunk", children + k, x, y, level=1, parent=parent.name, context=parent.name) for k, (x, y) in enumerate(own))]
        children += len(own)
    return found


@register("hierarchical", provides_context=True)
def hierarchical(text: str, section_max_chars: int = 3000, paragraph_max_chars: int = 1000, chunk_size: int = 400, min_section_chars: int = 200, context_level: str = "section", include_section_path: bool = True, detect_plain_headings: bool = True) -> list[Piece]:
    count = dict.fromkeys(("document", "section", "paragraph", "chunk"), 0)
    found: list[Piece] = []

    def add(stem: str, start: int, end: int, above: Piece | None, path: str | None, **more: Any) -> Piece:
        level = list(count).index(stem)
        piece = Piece(stem, count[stem], start, end, path=path, level=level, parent=above.name if above else None, retrievable=stem == "chunk", **more)
        count[stem] += 1
        found.append(piece)
        return piece

    def held(spans: list[S.Span], parts: list[S.Span]) -> Iterator[list[S.Span]]:
        for a, b in spans:
            yield [p for p in parts if a <= p[0] and p[1] <= b]

    root = add("document", *S.squeeze(text, 0, len(text)), None, None)
    outline = B.Outline(text, detect_plain_headings)
    for group in outline.groups(min_section_chars, section_max_chars):
        top, heading, path = group[0], outline.heading(group[0]), " > ".join(group[0].path) or None
        units = outline.pieces(group, paragraph_max_chars)
        for part in held(S.pack(units, section_max_chars), units):
            section = add("section", part[0][0], part[-1][1], root, path)
            for body in held(S.pack(part, paragraph_max_chars), part):
                paragraph = add("paragraph", body[0][0], body[-1][1], section, path)
                around = section if context_level == "section" else paragraph
                for a, b in B.in_region(text, paragraph.start, paragraph.end, chunk_size, detect_plain_headings):
                    add("chunk", a, b, paragraph, path, context=around.name, lead=_lead(top.path, heading, a) if include_section_path else "")
    return found


def _is(column: Column, value: Any) -> Column:
    return column.isin(value) if isinstance(value, list) else column == F.lit(value)


def route(rules: list[dict[str, Any]], columns: list[str]) -> Column:
    """The number of the first rule whose every key matches, or -1; a missing key never matches."""
    found = None
    for n, rule in enumerate(rules):
        tests = [(_is(F.col(k), v) if k in columns else F.lit(False)) for k, v in rule["when"].items()]
        every = F.coalesce(_all(tests), F.lit(False))
        found = F.when(every, F.lit(n)) if found is None else found.when(every, F.lit(n))
    return F.lit(-1) if found is None else found.otherwise(F.lit(-1))


def _all(tests: list[Column]) -> Column:
    out = F.lit(True)
    for test in tests:
        out = out & test
    return out


def chunk(docs: DataFrame, strategy: str = "fixed", params: dict[str, Any] | None = None, prefix: Column | None = None, provider: Provider | None = None, carry: list[str] | None = None, context: bool = False) -> DataFrame:
    """Chunk rows of documents (document_id, text, ...).

    ``carry`` names columns of the documents that every chunk gets. With ``context`` only retrievable chunks are returned, with the
    text of their context, which is of the same document.

    Chunk ids are ``<prefix>_<stem>_<number>``; the prefix is the document id unless given. Blank
    texts and null texts have no chunks.
    """
    base = _base(docs, prefix)
    number, plans = _planned(base.columns, strategy, params, provider)
    return _arrow(base.withColumn("__route", number), plans, carry or [], context)


Plan = tuple[str, Kernel, dict[str, Any]]


def _base(docs: DataFrame, prefix: Column | None = None) -> DataFrame:
    return docs.withColumn("__prefix", F.col("document_id") if prefix is None else prefix).filter(F.col("text").rlike(r"(?U)\S"))


def _planned(columns: list[str], strategy: str, params: dict[str, Any] | None, provider: Provider | None) -> tuple[Column, list[Plan]]:
    """Label, kernel and parameters that a strategy may use, and the number of those for a row."""
    name = ALIASES.get(strategy, strategy)
    if name == "metadata_aware":
        return _routed(columns, params or {}, provider)
    params = {**DEFAULT_PARAMS.get(name, {}), **(params or {})}
    check_params(name, params)
    _, found = find(name)
    if found.needs_provider:
        if provider is None:
            raise ValueError("the semantic strategy needs an embedding provider")
        params = {**params, "provider": provider}
    return F.lit(0), [(name, found.kernel, params)]


def _routed(columns: list[str], params: dict[str, Any], provider: Provider | None) -> tuple[Column, list[Plan]]:
    rules, fallback = params.get("rules", DEFAULT_RULES), params.get("fallback", DEFAULT_FALLBACK)
    plans = []
    for rule in [*rules, fallback]:
        inner = ALIASES.get(rule["strategy"], rule["strategy"])
        if inner == "metadata_aware":
            raise ValueError("a rule cannot route to metadata_aware itself")
        _, found = find(inner)
        own = dict(rule.get("params", {}))
        check_params(inner, own)
        plans.append((f"metadata_aware:{inner}", found.kernel, own | ({"provider": provider} if found.needs_provider else {})))
    number = route(rules, columns)
    return F.when(number < 0, F.lit(len(rules))).otherwise(number), plans


def _rows_of(plan: Plan, document: str, prefix: str, text: str) -> Iterator[tuple]:
    """The CHUNK rows of one text."""
    label, kernel, params = plan
    full = lambda name: f"{prefix}_{name}" if name else None
    for p in kernel(text, **params):
        yield document, full(p.name), p.number, p.lead + text[p.start : p.end], p.start, p.end, label, full(p.parent), p.level, p.retrievable, full(p.context), p.path


#: Chunk rows are handed on in batches of about so many characters.
BATCH_CHARS = 1_000_000


def _arrow(base: DataFrame, plans: list[Plan], carry: list[str], context: bool) -> DataFrame:
    """Run the kernels over whole texts."""
    rows = base.select(F.col("document_id").cast("string"), F.col("__prefix").cast("string"), "text", "__route", *carry)
    schema = T.StructType([*CHUNK, *[CONTEXT] * context, *(rows.schema[c] for c in carry)])
    return spread(rows).mapInArrow(lambda batches: cut(batches, plans, context), schema)


def cut(batches: Iterator[pa.RecordBatch], plans: list[Plan], context: bool = False) -> Iterator[pa.RecordBatch]:
    """Chunk rows, one text at a time: beside the incoming batch a worker holds one text and one outgoing batch, whatever comes in."""
    for batch in batches:
        held: list[tuple] = []
        of: list[int] = []  # the documents of the held rows
        size = 0

        def made() -> pa.RecordBatch:
            own = _batch(held, _FIELDS[: len(held[0])])
            carried = batch.columns[4:]
            return pa.RecordBatch.from_arrays([*own.columns, *(c.take(pa.array(of)) for c in carried)], names=[*own.schema.names, *batch.schema.names[4:]])

        for at in range(batch.num_rows):
            document, prefix, text, number = (batch.column(i)[at].as_py() for i in range(4))
            rows = _rows_of(plans[number], document, prefix, text)
            for row in _in_context(rows) if context else rows:
                held.append(row)
                of.append(at)
                size += len(row[3]) + len((row[12] or "") if context else "")
                if size > BATCH_CHARS:
                    yield made()
                    held, of, size = [], [], 0
        if held:
            yield made()


def _in_context(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Retrievable rows of one document with the text of their context."""
    every = list(rows)
    around = {r[1]: r[3] for r in every}
    yield from ((*r, around.get(r[10])) for r in every if r[9])


class Fold(Protocol):
    """What a task makes of its documents' chunks."""

    def add(self, label: str, document: str, text: str, pieces: list[Piece]) -> None: ...

    def done(self) -> Iterator[tuple]: ...


def fold(docs: DataFrame, specs: dict[str, tuple[str, dict[str, Any]]], make: Callable[[], Fold], schema: T.StructType, provider: Provider | None = None) -> DataFrame:
    """The rows that each task's ``make()`` returns after it has seen the pieces of every document under every label: strategy and parameters.

    One pass over the documents for all labels, without a shuffle; chunks leave no task.
    """
    base = _base(docs)
    routes = {label: _planned(base.columns, strategy, params, provider) for label, (strategy, params) in specs.items()}
    plans = [(label, found) for label, (_, found) in routes.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = make()
        for batch in batches:
            for at in range(batch.num_rows):
                document, text, *numbers = (batch.column(i)[at].as_py() for i in range(batch.num_columns))
                for (label, own), number in zip(plans, numbers, strict=True):
                    _, kernel, params = own[number]
                    state.add(label, document, text, kernel(text, **params))
        if rows := list(state.done()):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), to_arrow_schema(schema), strict=True)], names=schema.names)

    rows = base.select(F.col("document_id").cast("string"), "text", *[number.alias(f"__route{n}") for n, (number, _) in enumerate(routes.values())])
    return spread(rows).mapInArrow(run, schema)


def spans_frame(rows: DataFrame, cut: Callable[[str], list[S.Span]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n, start, end: the spans that a kernel finds in each text; null texts have none."""
    schema = T.StructType([T.StructField(id_col, rows.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("n", "start", "end"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = cut(batch.column(1)[i].as_py())
                if found:
                    a, b = zip(*found, strict=True)
                    ids = batch.column(0).take(pa.array([i] * len(found)))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in (range(len(found)), a, b))], names=schema.names)

    return spread(rows.select(id_col, text_col).filter(F.col(text_col).isNotNull())).mapInArrow(run, schema)


def semantic_boundaries(docs: DataFrame, provider: Provider, params: dict[str, Any] | None = None) -> DataFrame:
    """Every sentence with the distance to the next one and whether a cut after it is forced, barred and made."""
    given = {k: v for k, v in {**DEFAULT_PARAMS["semantic"], **(params or {})}.items() if k != "min_chars"}
    kinds = [("idx", T.IntegerType()), ("start", T.IntegerType()), ("end", T.IntegerType()), ("distance", T.DoubleType()), ("threshold", T.DoubleType()), ("forced", T.BooleanType()), ("barred", T.BooleanType()), ("cut", T.BooleanType())]
    schema = T.StructType([T.StructField("document_id", T.StringType()), *(T.StructField(n, k) for n, k in kinds)])
    arrow = [pa.string(), *[pa.int32()] * 3, *[pa.float64()] * 2, *[pa.bool_()] * 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for document, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(document, *r) for r in explain(text, provider, **given)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), arrow, strict=True)], names=schema.names)

    texts = docs.select(F.col("document_id").cast("string"), "text").filter(F.col("text").rlike(r"(?U)\S"))
    return spread(texts).mapInArrow(run, schema)


def _batch(rows: list[tuple], columns: list[pa.Field]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), columns, strict=True)], schema=pa.schema(columns))


def with_context(chunks: DataFrame) -> DataFrame:
    """Retrievable chunks with the text of their context; the context is joined by id, so it is stored once."""
    around = chunks.select(F.col("chunk_id").alias("context_id"), F.col("text").alias("context_text"))
    return chunks.filter("retrievable").join(around, "context_id", "left").select(*chunks.columns, "context_text")


_STEM = re.compile(r"_([a-z]+)_\d+$")
_LETTER = re.compile(r"[^\W_]")  # a letter or a digit
CONTRACT = ("wrong_text", "wrong_number", "uncovered")


class _Contract:
    """Counts, for each label, retrievable chunks that break the contract. A chunk is held against its own document."""

    def __init__(self) -> None:
        self.found: dict[str, list[int]] = {}

    def add(self, label: str, document: str, text: str, pieces: list[Piece]) -> None:
        count = self.found.setdefault(label, [0, 0, 0])
        rows = [r for r in _rows_of((label, lambda _: pieces, {}), document, document, text) if r[9]]
        count[0] += sum(not 0 <= start <= end or text[start:end] != said for _, _, _, said, start, end, *_ in rows)
        seen: Counter = Counter()
        for _, chunk_id, number, *_ in sorted(rows, key=lambda r: (r[4], r[2])):
            stem = m[1] if (m := _STEM.search(chunk_id)) else ""
            count[1] += number != seen[stem]
            seen[stem] += 1
        reach = 0
        for start, end in sorted((r[4], r[5]) for r in rows):
            count[2] += start > reach and _LETTER.search(text, reach, start) is not None
            reach = max(reach, end)

    def done(self) -> Iterator[tuple]:
        yield from ((label, *count) for label, count in self.found.items())


def contract(docs: DataFrame, plans: dict[str, dict[str, Any]], provider: Provider | None = None) -> DataFrame:
    """For each strategy: chunks whose offsets don't give their text, numbers out of order, chunks with words in no chunk before them."""
    schema = T.StructType([T.StructField("strategy", T.StringType()), *(T.StructField(c, T.LongType()) for c in CONTRACT)])
    counted = fold(docs, {name: (name, params) for name, params in plans.items()}, _Contract, schema, provider)
    named = docs.sparkSession.createDataFrame([(name, 0, 0, 0) for name in plans], schema)  # without documents nothing is broken
    return counted.unionByName(named).groupBy("strategy").agg(*[F.sum(c).alias(c) for c in CONTRACT])


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Counts and sizes of retrievable chunks by strategy."""
    size = F.when(F.col("retrievable"), F.length("text"))
    return chunks.groupBy("strategy").agg(
        F.count_if("retrievable").alias("chunks"), F.count_if(~F.col("retrievable")).alias("context_chunks"), F.round(F.avg(size), 6).alias("avg_chars"), F.median(size).alias("median_chars"), F.min(size).alias("min_chars"), F.max(size).alias("max_chars"),
    )
