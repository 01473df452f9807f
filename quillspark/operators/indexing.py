"""Indexing: what to do with each document, versions, retirement, metadata refresh, one commit.

Decisions follow the order of files, since a file indexed earlier in a run counts for a later one. Only manifest
rows (ids and names, no texts) are replayed, for each group of names that share documents; chunking, embedding and
writing are set operations on the outcome.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text as X
from ..functions.embedding import Provider
from ..session import remove, written
from .chunking import chunk
from .embed import embed, embed_cached
from .store import Store

PLAN = T.StructType([
    T.StructField("tenant_id", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("filename", T.StringType()), T.StructField("document_id", T.StringType()), T.StructField("action", T.StringType()),
    T.StructField("version", T.IntegerType()), T.StructField("previous_version", T.StringType()), T.StructField("duplicate_of", T.StringType()), T.StructField("live", T.BooleanType()),
])
#: Fields that describe a document and are refreshed without embedding again.
DOCUMENT_FIELDS = ("title", "author", "date", "department", "category", "file_size", "source_type", "mime_type", "file_hash", "encoding", "page_count", "row_count", "column_count", "page")


def _key(document_id: str) -> str:
    return document_id.rpartition("-")[0] or document_id


class Ledger:
    """What a tenant has stored, as names and ids."""

    def __init__(self) -> None:
        self.names: dict[str, set[str]] = {}  # document id -> file names
        self.versions: dict[str, dict[str, tuple[int, str | None]]] = {}  # file name -> key -> version, previous
        self.held: dict[str, set[str]] = {}  # file name -> document ids

    def add(self, name: str, document: str, version: int, previous: str | None) -> None:
        self.names.setdefault(document, set()).add(name)
        self.held.setdefault(name, set()).add(document)
        self.versions.setdefault(name, {})[_key(document)] = (version, previous)

    def resolve(self, name: str, document: str) -> tuple[int, str | None]:
        known = self.versions.get(name, {})
        if _key(document) in known:
            return known[_key(document)]
        if not known:
            return 1, None
        latest = max(known, key=lambda k: known[k][0])
        return known[latest][0] + 1, latest

    def retire(self, name: str, document: str) -> set[str]:
        """Drop the name's documents of other contents; returns them."""
        gone = {d for d in self.held.get(name, ()) if _key(d) != _key(document)}
        for d in gone:
            self.held[name].discard(d)
            self.names[d].discard(name)
            if not self.names[d]:
                del self.names[d]
            self.versions[name].pop(_key(d), None)
        return gone


def replay(stored: list[tuple], arrivals: list[tuple]) -> list[tuple]:
    """(seq, name, document, action, version, previous, duplicate_of, live) of each arrival and, for what is dropped, of stored rows."""
    ledger, out, at = Ledger(), [], {}
    for name, document, version, previous in stored:
        ledger.add(name, document, version, previous)
    for seq, name, document in arrivals:
        if names := ledger.names.get(document):
            own = name in names
            version = ledger.resolve(name, document) if own else (None, None)
            out.append([seq, name, document, "refresh" if own else "duplicate", *version, None if own else min(names), True])
            continue
        version = ledger.resolve(name, document)
        ledger.add(name, document, *version)
        at[name, document] = len(out)
        out.append([seq, name, document, "index", *version, None, True])
        for gone in sorted(ledger.retire(name, document)):
            if (name, gone) in at:
                out[at.pop((name, gone))][7] = False  # indexed and retired in one run
            else:
                out.append([seq, name, gone, "retire", None, None, None, False])
    return [tuple(row) for row in out]


def plan(stored: DataFrame, arrivals: DataFrame) -> DataFrame:
    """PLAN rows for arrivals (tenant_id, seq, filename, document_id) against a store's records, as a table of ids and names.

    Records without a tenant count for every tenant that arrives.
    """
    known = stored.select("tenant_id", X.legacy_filename(F.col("filename"), F.lit(None).cast("string")).alias("filename"), X.legacy_document_id(F.col("document_id"), F.col("chunk_id")).alias("document_id"), F.coalesce("version", F.lit(1)).alias("version"), "previous_version")
    known = known.groupBy("tenant_id", "filename", "document_id").agg(F.max("version").alias("version"), F.max("previous_version").alias("previous_version"))
    tenants = arrivals.select("tenant_id").distinct()
    known = known.filter("tenant_id IS NOT NULL").unionByName(known.filter("tenant_id IS NULL").drop("tenant_id").crossJoin(tenants))  # few: rows from before tenants existed
    lines = known.withColumn("seq", F.lit(-1).cast("long")).unionByName(arrivals.select("tenant_id", "seq", "filename", "document_id").withColumns({"version": F.lit(0), "previous_version": F.lit(None).cast("string")}))

    named = lines.withColumn("__name", F.coalesce("filename", F.lit("\u0000")))
    groups, path = _entangled(named)
    last = lambda name: F.col(name).asc_nulls_last()
    ordered = named.join(groups, ["tenant_id", "__name"]).repartition("tenant_id", "__group").sortWithinPartitions("tenant_id", "__group", "seq", last("filename"), last("document_id"))
    done, _ = written(ordered.select("tenant_id", "__group", "seq", "filename", "document_id", "version", "previous_version").mapInArrow(replayed, PLAN))
    remove(stored.sparkSession, path)
    return done


def replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PLAN rows of manifest rows that come group by group, each in order; most groups are one row, so they leave many at a time."""
    arrow = to_arrow_schema(PLAN)
    lines = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    out: list[tuple] = []
    for (tenant, _), group in groupby(lines, key=lambda r: r[:2]):
        stored, arrivals = [], []
        for _, _, seq, name, document, version, previous in group:
            if seq < 0:
                stored.append((name, document, version, previous))
            else:
                arrivals.append((seq, name, document))
        out += [(tenant, *row) for row in replay(stored, arrivals)]
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)


def _entangled(lines: DataFrame) -> tuple[DataFrame, str]:
    """A table of tenant_id, __name, __group, and its path: names are of one group if they share a document, directly or through others.

    Only such names bear on each other, so groups are replayed apart; most are one file. Each round gives every name the least
    name of its documents' groups.
    """
    edges, own = written(lines.select("tenant_id", "__name", "document_id").distinct())
    found, last = written(edges.select("tenant_id", "__name").distinct().withColumn("__group", F.col("__name")))
    while True:
        least = edges.join(found, ["tenant_id", "__name"]).groupBy("tenant_id", "document_id").agg(F.min("__group").alias("__g"))
        then = edges.join(least, ["tenant_id", "document_id"]).groupBy("tenant_id", "__name").agg(F.min("__g").alias("__g"))
        step, path = written(found.join(then, ["tenant_id", "__name"]).select("tenant_id", "__name", F.col("__group").alias("__before"), F.col("__g").alias("__group")))
        settled = step.filter("__before <> __group").isEmpty()
        remove(lines.sparkSession, last)
        found, last = step.drop("__before"), path
        if settled:
            remove(lines.sparkSession, own)
            return found, path


def version_history(arrivals: DataFrame) -> DataFrame:
    """Version and previous content of every change: tenant_id, filename, seq, file_key, version, previous_version."""
    order = Window.partitionBy("tenant_id", "filename").orderBy("seq")
    keyed = arrivals.withColumn("file_key", X.file_key(F.col("document_id"))).withColumn("__before", F.lag("file_key").over(order))
    changed = keyed.filter(~F.col("__before").eqNullSafe(F.col("file_key")))
    return changed.select("tenant_id", "filename", "seq", "file_key", F.row_number().over(order).alias("version"), F.lag("file_key").over(order).alias("previous_version"))


def _arriving(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with their tenant, and a table of tenant_id, source, document_id, filename, seq: their order of arrival."""
    named = documents.withColumn("tenant_id", X.tenant(F.col("tenant_id")))
    order = Window.partitionBy("tenant_id").orderBy("source", F.regexp_extract("document_id", r"-(\d+)$", 1).cast("int"))
    return named, written(named.select("tenant_id", "source", "document_id", "filename").withColumn("seq", F.row_number().over(order).cast("long")))[0]


def index(store: Store, documents: DataFrame, provider: Provider, strategy: str = "fixed", params: dict[str, Any] | None = None, cache: str | None = None) -> DataFrame:
    """Bring a store up to date with documents in one commit; returns the plan that was carried out.

    With ``cache``, a folder, texts that were embedded before aren't sent again. Texts meet their plan in one join; chunks carry what
    describes their document and the text of their context.
    """
    old = store.rows()
    named, order = _arriving(documents)
    done = plan(old, order)
    doing = lambda test: named.join(order.join(done.filter(test).select("tenant_id", "seq", "version", "previous_version"), ["tenant_id", "seq"]).drop("seq", "filename"), ["tenant_id", "source", "document_id"])
    about = ["document_id", "tenant_id", "filename", "version", "previous_version", *[c for c in DOCUMENT_FIELDS if c in documents.columns]]
    keyed = doing("action = 'index' AND live").select(F.concat("tenant_id", F.lit(":"), "document_id").alias("doc_key"), *about, *[c for c in documents.columns if c not in about])
    told = keyed.withColumns({f"__{c}": F.col(c) for c in about}).withColumn("document_id", F.col("doc_key"))
    pieces = chunk(told, strategy, params, provider=provider, carry=[f"__{c}" for c in about], context=True)
    pieces = pieces.select(
        "chunk_id", "text", F.col("strategy").alias("chunk_strategy"), F.col("start").alias("chunk_start"), F.col("end").alias("chunk_end"), F.col("level").alias("chunk_level"), "parent_id", "context_id", "context_text", "section_path",
        *[F.col(f"__{c}").alias(c) for c in about],
    )
    added = embed_cached(pieces, provider, cache)[0] if cache else embed(pieces, provider)
    gone = done.filter("action = 'retire'").select("tenant_id", "filename", "document_id").distinct()
    match = (F.coalesce(old["tenant_id"], gone["tenant_id"]) == gone["tenant_id"]) & (old["filename"] == gone["filename"]) & (old["document_id"] == gone["document_id"])
    again = doing("action = 'refresh'")
    changed = refreshed(old.join(gone, match, "left_anti"), again).filter("__changed").drop("__changed")
    dropped = old.join(gone, match, "left_semi").select("chunk_id").unionByName(changed.select("chunk_id"))
    new = not done.filter("action = 'index' AND live").isEmpty()
    if new or not dropped.isEmpty():
        store.apply(changed.unionByName(added, allowMissingColumns=True) if new else changed, dropped)
    return done


def refreshed(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Stored rows with the documents' present metadata; ``__changed`` marks those that differ. Chunk bookkeeping stays."""
    fields = [c for c in DOCUMENT_FIELDS if c in documents.columns]
    new = documents.select("tenant_id", "filename", "document_id", F.lit(True).alias("__found"), *[F.col(c).alias(f"__{c}") for c in fields])
    joined = rows.join(new.withColumnsRenamed({k: f"__n_{k}" for k in ("tenant_id", "filename", "document_id")}), _on(rows), "left")
    differs = F.lit(False)
    for c in fields:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"__{c}").cast(rows.schema[c].dataType))
    found = F.coalesce("__found", F.lit(False))
    changed = found & (differs | F.col("tenant_id").isNull())
    out = {c: F.when(found, F.col(f"__{c}").cast(rows.schema[c].dataType)).otherwise(F.col(c)) for c in fields} | {"tenant_id": F.coalesce("tenant_id", "__n_tenant_id")}
    return joined.withColumn("__changed", changed).withColumns(out).select(*rows.columns, "__changed")


def _on(rows: DataFrame) -> F.Column:
    return (F.col("document_id") == F.col("__n_document_id")) & (F.col("filename") == F.col("__n_filename")) & (F.coalesce(F.col("tenant_id"), F.col("__n_tenant_id")) == F.col("__n_tenant_id"))


def duplicates(rows: DataFrame) -> DataFrame:
    """tenant_id, document_id, filename and duplicate_of: the least other name of the same content, null for it itself."""
    names = rows.select("tenant_id", "document_id", "filename").distinct()
    least = names.groupBy("tenant_id", "document_id").agg(F.min("filename").alias("first"), F.count("*").alias("n")).filter("n > 1")
    return names.join(least, ["tenant_id", "document_id"]).select("tenant_id", "document_id", "filename", F.when(F.col("filename") != F.col("first"), F.col("first")).alias("duplicate_of"))


def log_lines(done: DataFrame) -> Iterator[str]:
    """What a run did, line by line, for a console."""
    for r in done.orderBy("tenant_id", "seq", "action").toLocalIterator():
        if r.action == "index":
            yield f"{r.filename} ({r.document_id}): indexed as version {r.version}"
        elif r.action == "refresh":
            yield f"{r.filename} ({r.document_id}): already indexed"
        elif r.action == "duplicate":
            yield f"{r.filename} ({r.document_id}): same content as {r.duplicate_of}"
