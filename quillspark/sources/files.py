"""Scanning folders of files to documents: listing, checks, types, sidecars, parsing, cleaning.

One lazy plan: Spark's binaryFile source (file name and length are tested before any content is read), one Arrow pass that
parses, then native cleaning and identities. A file that can't be read is a row with an error, never
a failed job.
"""

from __future__ import annotations

import atexit
import uuid
import zipfile
from collections.abc import Iterator
from io import BytesIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..session import hadoop_path, read_bytes, remove, shared_dir
from .parsers import Parser, parsers

# Types by extension and by MIME type, and what a sidecar may say.
EXTENSIONS = {
    ".pdf": "pdf", ".docx": "docx", ".txt": "txt", ".text": "txt", ".md": "markdown", ".markdown": "markdown",
    ".html": "html", ".htm": "html", ".csv": "csv", ".json": "json",
}
MIME_OF = {
    "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "txt": "text/plain",
    "markdown": "text/markdown", "html": "text/html", "csv": "text/csv", "json": "application/json",
}
OTHER_MIMES = {"text/x-markdown": "markdown", "application/xhtml+xml": "html", "application/csv": "csv", "text/json": "json"}
SIDECAR_FIELDS = ("department", "category", "date", "author", "tenant_id", "title")
SIDECAR = ".meta.json"
MAX_BYTES = 50 * 1024 * 1024
SNIFF = 8192
COPY_BYTES = 64 * 1024 * 1024
_MB = 1_048_576

META = T.StructType([T.StructField(n, k) for n, k in (("title", T.StringType()), ("author", T.StringType()), ("date", T.StringType()), ("encoding", T.StringType()), ("page_count", T.IntegerType()), ("row_count", T.IntegerType()), ("column_count", T.IntegerType()))])
HELD = T.StructType([T.StructField("path", T.StringType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
PARSED = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("sections", T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("page_number", T.IntegerType())]))),
    T.StructField("format", META), T.StructField("error", T.StringType()),
])


def supported_extensions() -> list[str]:
    return sorted(EXTENSIONS)


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    """The last suffix in lower case; names that only begin with a dot have none."""
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def file_type(name: Column, mime: Column | None = None) -> Column:
    """By extension, else by the given MIME type without its parameters; null if neither is known."""
    by_name = F.try_element_at(F.create_map(*[F.lit(x) for p in EXTENSIONS.items() for x in p]), extension(name))
    if mime is None:
        return by_name
    known = {m: t for t, m in MIME_OF.items()} | OTHER_MIMES
    return F.coalesce(by_name, _lookup(F.lower(F.trim(F.split_part(mime, F.lit(";"), F.lit(1)))), known))


def canonical_mime(kind: Column) -> Column:
    return _lookup(kind, MIME_OF)


def size_error(name: Column, length: Column, limit: int = MAX_BYTES) -> Column:
    """Why a file of this size isn't read, or null."""
    def mb(n: Column) -> Column:
        """With one digit as C prints it: halves go to the even digit. Tenths are counted in whole numbers, so none is rounded twice."""
        n = n.cast("decimal(20,0)") * 10
        whole, rest = F.floor(n / _MB).cast("long"), (n % _MB).cast("long")
        tenths = whole + F.when((rest * 2 > _MB) | ((rest * 2 == _MB) & (whole % 2 == 1)), 1).otherwise(0)
        return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))

    return F.when(length == 0, F.concat(name, F.lit(" is empty."))).when(length > limit, F.concat(name, F.lit(" is "), mb(length), F.lit(" MB; the limit is "), mb(F.lit(limit)), F.lit(" MB.")))


def signature_error(name: str, kind: str, data: bytes) -> str | None:
    """Why the content isn't of its type, or None."""
    if kind == "pdf" and b"%PDF-" not in data[:1024]:
        return f"{name} is not a valid PDF file."
    if kind == "docx":
        whole = zipfile.is_zipfile(BytesIO(data))
        if not whole or "word/document.xml" not in zipfile.ZipFile(BytesIO(data)).namelist():
            return f"{name} is not a valid DOCX file."
    elif kind != "pdf" and b"\x00" in data[:SNIFF] and data[:2] not in (b"\xff\xfe", b"\xfe\xff"):
        return f"{name} looks like a binary file, not {kind} text."
    return None


def held(spark: SparkSession, folder: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """path, length and content of a folder's own files that aren't empty, whatever their names begin with.

    Spark's source leaves out names that begin with an underscore. Where there are such, the driver copies them, in blocks of
    bounded size, to a table in the shared folder; those above ``max_bytes`` without content.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path", "length", "content")
    fs, where = hadoop_path(spark, folder)
    hidden = [(str(s.getPath()), s.getLen()) for s in fs.listStatus(where) if s.isFile() and s.getLen() > 0 and s.getPath().getName().startswith("_")]
    if not hidden:
        return found
    copy = f"{shared_dir(spark)}/quillspark-files-{uuid.uuid4().hex[:8]}"
    atexit.register(remove, spark, copy)
    block: list[tuple] = []
    size = 0
    for n, (path, length) in enumerate(hidden, 1):
        if length <= max_bytes:
            block.append((path, length, read_bytes(spark, path)))
            size += length
        else:
            block.append((path, length, None))
        if n == len(hidden) or size >= COPY_BYTES:
            spark.createDataFrame(block, HELD).write.mode("append").parquet(copy)
            block, size = [], 0
    return found.unionByName(spark.read.schema(HELD).parquet(copy))


def scan(spark: SparkSession, folder: str, found: DataFrame | None = None) -> DataFrame:
    """path, name, length and content of a folder's own files, without dot-files and sidecars."""
    found = held(spark, folder) if found is None else found
    name = file_name(F.col("path"))
    rows = found.select("path", name.alias("name"), "length", "content")
    return rows.filter(~F.col("name").startswith(".") & ~F.lower("name").endswith(SIDECAR))


def empty_files(spark: SparkSession, folder: str) -> DataFrame:
    """path and name of the folder's files without content, which Spark's source leaves out."""
    fs, where = hadoop_path(spark, folder)
    found = [(str(s.getPath()), s.getPath().getName()) for s in fs.listStatus(where) if s.isFile() and s.getLen() == 0]
    rows = [r for r in found if not r[1].startswith(".") and not r[1].lower().endswith(SIDECAR)]
    return spark.createDataFrame(rows, "path string, name string")


def sidecars(spark: SparkSession, folder: str, found: DataFrame | None = None) -> DataFrame:
    """stem (path without suffix), side (the fields) and side_error of each sidecar file."""
    found = (held(spark, folder) if found is None else found).filter(F.lower(file_name(F.col("path"))).endswith(SIDECAR))
    text = F.col("content").cast("string")
    value = F.try_parse_json(text)
    kind = F.schema_of_variant(value)
    fields = F.json_object_keys(text)
    strange = F.array_except(fields, F.array(*[F.lit(f) for f in SIDECAR_FIELDS]))
    loaded = F.from_json(text, T.MapType(T.StringType(), T.StringType()))
    wrong = F.filter(F.array(*[F.lit(f) for f in SIDECAR_FIELDS]), lambda f: F.array_contains(fields, f) & ~F.coalesce(F.get_json_object(text, "$").isNotNull() & (F.variant_get(value, "$", "map<string,variant>")[f].isNotNull()) & F.schema_of_variant(F.variant_get(value, "$", "map<string,variant>")[f]).eqNullSafe("STRING"), F.lit(False)))
    name = file_name(F.col("path"))
    error = (
        F.when(value.isNull(), F.concat(name, F.lit(" is not valid JSON.")))
        .when(~kind.startswith("OBJECT"), F.concat(name, F.lit(" must contain a JSON object.")))
        .when(F.size(strange) > 0, F.concat(name, F.lit(" has unsupported fields: "), F.array_join(F.array_sort(strange), ", ")))
        .when(F.size(wrong) > 0, F.concat(name, F.lit(": "), F.element_at(wrong, 1), F.lit(" must be a string.")))
    )
    stem = F.regexp_replace("path", r"(?i)\.meta\.json$", "")
    return found.select(stem.alias("stem"), F.when(error.isNull(), loaded).alias("side"), error.alias("side_error"))


def parse_files(files: DataFrame, registry: dict[str, Parser] | None = None) -> DataFrame:
    """path, sections, format (metadata) and error of files (path, name, kind, content)."""
    registry = parsers() if registry is None else registry
    arrow = pa.schema([
        ("path", pa.string()), ("sections", pa.list_(pa.struct([("text", pa.string()), ("page_number", pa.int32())]))),
        ("format", pa.struct([(f.name, pa.int32() if f.dataType == T.IntegerType() else pa.string()) for f in META])), ("error", pa.string()),
    ])

    def one(path: str, name: str, kind: str, data: bytes) -> dict:
        try:
            if kind not in registry:
                return {"path": path, "error": f"no parser for {kind}"}
            if wrong := signature_error(name, kind, data):
                return {"path": path, "error": wrong}
            sections, meta = registry[kind](data)
        except Exception as error:  # a bad file is a row, not a failed job
            return {"path": path, "error": f"Could not read {name} as {kind}: {error}"}
        return {"path": path, "sections": [{"text": t, "page_number": n} for t, n in sections], "format": {f.name: meta.get(f.name) for f in META}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_pylist([one(*(batch.column(c)[i].as_py() for c in range(4)))], schema=arrow)

    return files.select("path", "name", "kind", "content").mapInArrow(run, PARSED)


def ingest(spark: SparkSession, folder: str, max_bytes: int = MAX_BYTES, registry: dict[str, Parser] | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents, and a log with one row per file: path, name, source_type, file_hash, documents, error."""
    found = held(spark, folder, max_bytes)
    files = scan(spark, folder, found).withColumn("kind", file_type(F.col("name")))
    unknown = F.concat(F.lit("Unsupported file type for "), F.col("name"), F.lit(f". Supported extensions: {', '.join(supported_extensions())}."))
    early = F.coalesce(size_error(F.col("name"), F.col("length"), max_bytes), F.when(F.col("kind").isNull(), unknown))
    checked = files.withColumn("early", early)
    good = checked.filter("early IS NULL").withColumn("file_hash", F.sha2("content", 256))
    facts = good.select("path", "name", "length", "kind", "file_hash")
    parsed = facts.join(parse_files(good, registry), "path").withColumn("stem", F.regexp_replace("path", r"\.[^./]*$", ""))
    side = sidecars(spark, folder, found)
    whole = parsed.join(side, "stem", "left").withColumn("error", F.coalesce("error", "side_error"))
    said = lambda key: F.col("side")[key]
    rows = whole.filter("error IS NULL").select("*", F.posexplode("sections").alias("at", "section"))
    documents = rows.select(
        X.document_id(F.col("file_hash"), F.col("at") + 1).alias("document_id"), F.col("path").alias("source"), F.col("name").alias("filename"), F.col("section.page_number").alias("page"), X.clean_text(F.col("section.text")).alias("text"),
        F.col("length").alias("file_size"), F.col("kind").alias("source_type"), canonical_mime(F.col("kind")).alias("mime_type"), "file_hash",
        *[F.coalesce(said(k), F.col(f"format.{k}")).alias(k) for k in ("title", "author", "date")], *[said(k).alias(k) for k in ("department", "category", "tenant_id")],
        *[F.col(f"format.{k}").alias(k) for k in ("encoding", "page_count", "row_count", "column_count")],
    ).filter("text <> ''")
    counts = documents.groupBy(F.col("source").alias("path")).agg(F.count("*").alias("n"))
    read = whole.join(counts, "path", "left").select("path", "name", F.col("kind").alias("source_type"), "file_hash", F.when(F.col("error").isNull(), F.coalesce("n", F.lit(0))).alias("documents"), "error")
    failed = checked.filter("early IS NOT NULL").select("path", "name", F.col("kind").alias("source_type"), F.lit(None).cast("string").alias("file_hash"), F.lit(None).cast("long").alias("documents"), F.col("early").alias("error"))
    none = empty_files(spark, folder)
    empty = none.select("path", "name", file_type(F.col("name")).alias("source_type"), F.lit(None).cast("string").alias("file_hash"), F.lit(None).cast("long").alias("documents"), size_error(F.col("name"), F.lit(0)).alias("error"))
    return documents, read.unionByName(failed).unionByName(empty)


def render_rows(table: DataFrame) -> Column:
    """A row as ``name: value | ...`` without empty cells, as CSV files are rendered."""
    cells = [F.when(F.trim(F.col(f"`{c}`").cast("string")) != "", F.concat(F.lit(f"{c}: "), F.trim(F.col(f"`{c}`").cast("string")))) for c in table.columns]
    return F.concat_ws(" | ", *cells)


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """question_id, question, filename, position and passage of a file of gold questions."""
    found = spark.read.option("multiLine", True).json(path).select(F.explode("questions").alias("q")).select("q.*")
    repeated = found.groupBy("id").count().filter("count > 1").limit(5).collect()
    if repeated:
        raise ValueError(f"question ids occur twice: {', '.join(sorted(r.id for r in repeated))}")
    if found.filter((F.size("evidence") <= 0) | F.col("evidence").isNull()).limit(1).collect():
        raise ValueError("a question has no evidence")
    return found.select(F.col("id").alias("question_id"), "question", F.col("document").alias("filename"), F.posexplode("evidence").alias("position", "passage"))
