"""Plumbing shared by the training-data operators: text mapping, scratch tables, published files.

Nothing here decides results. Everything that a later job reads again is written as Parquet under
the folder named by ``spark.checkpoint.dir``, which survives the loss of an executor.
"""

from __future__ import annotations

import atexit
import hashlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import hadoop_path, shared_dir, write_bytes

#: Texts are handed to a kernel in runs of about this many characters, so memory doesn't follow the batch.
CHUNK_CHARS = 4_000_000

_scratch: dict[str, str] = {}
_open_paths: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        fs, where = hadoop_path(spark, path)
        fs.delete(where, True)
    except Exception:  # the session is gone; the cluster's own clean-up of the folder remains
        pass


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, removed when the interpreter ends."""
    path = f"{shared_dir(spark)}/quillspark-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    _open_paths.add(path)
    return path


#: Spark then deletes a job's shuffle files when it has ended; a lost executor's are made again while it runs.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write a frame once and read it back: lineage is cut, columns can be pruned, and no shuffle file stays."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Delete the files of frames that ``materialise`` returned and that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "__dict__", {}).get("_scratch_path"):
            _remove(df.sparkSession, path)
            _open_paths.discard(path)


def scratch_mark() -> set[str]:
    """The scratch paths of now, for ``discard_since``."""
    return set(_open_paths)


def discard_since(spark: SparkSession, mark: set[str], keep: DataFrame) -> None:
    """Delete what was written since the mark, but for one frame."""
    for path in _open_paths - mark - {keep.__dict__.get("_scratch_path")}:
        if "/published-" not in path:
            _remove(spark, path)
            _open_paths.discard(path)


def _marked(rows: DataFrame, on: str, keys: DataFrame, slots: int) -> DataFrame:
    """The rows with ``__maybe``: false only if ``on`` isn't in the one column of ``keys``.

    A bitmap of 64 x ``slots`` hashes goes out by broadcast, so its size is bound by ``slots`` rows whatever the number of
    keys. As it fills, it is true for more rows; it is true for all the keys' rows.
    """
    (name,) = keys.columns
    h = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(slots * 64))
    told = keys.select(h(f"`{name}`").alias("__h")).groupBy(F.shiftright("__h", 6).alias("__slot")).agg(F.expr("bit_or(shiftleft(1L, cast(__h & 63 as int)))").alias("__bits"))
    found = rows.withColumn("__h", h(f"`{on}`")).withColumn("__slot", F.shiftright("__h", 6)).join(F.broadcast(told), "__slot", "left")
    return found.withColumn("__maybe", F.expr("coalesce(bit_get(__bits, cast(__h & 63 as int)) = 1, false)")).drop("__h", "__slot", "__bits")


def among(rows: DataFrame, on: str, keys: DataFrame, slots: int = 1 << 19) -> DataFrame:
    """The rows whose ``on`` may be among the keys, and few others: what a join then needn't shuffle."""
    return _marked(rows, on, keys, slots).filter("__maybe").drop("__maybe")


def remove(rows: DataFrame, on: str, keys: DataFrame, slots: int = 1 << 19) -> DataFrame:
    """The rows whose ``on`` isn't among the keys; only those that may be are shuffled."""
    marked = _marked(rows, on, keys, slots)
    rest = marked.filter("__maybe").drop("__maybe").join(keys.toDF(on), on, "left_anti")
    return marked.filter("NOT __maybe").drop("__maybe").unionByName(rest.select(rows.columns))


def publish(spark: SparkSession, data: bytes, suffix: str) -> str:
    """Give every present and later executor a local copy of a small file; returns its SparkFiles name."""
    name = f"{hashlib.sha256(data).hexdigest()[:24]}{suffix}"
    key = f"{spark.sparkContext.applicationId}/{name}"
    if key not in _scratch:
        path = f"{scratch_path(spark, 'published')}/{name}"
        write_bytes(spark, path, data)
        spark.sparkContext.addFile(path)
        _scratch[key] = path
    return name


def spans_by_size(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows of about ``limit`` characters; one long text is a range of its own."""
    start = size = 0
    for at, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, at
            start, size = at, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop columns that an operator is about to add; Spark compares names without regard to case."""
    clash = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in clash])


def map_text(
    df: DataFrame,
    kernel: Callable[[], Callable[[list[str]], list[pa.Array]]],
    fields: list[T.StructField],
    text_col: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """Append ``fields`` computed from whole texts, in one pass without a shuffle.

    ``kernel()`` is built once for each task; it takes texts (null is given as "") and returns one
    Arrow array per field. ``keep`` names the columns to carry along, all but clashing ones by default.
    """
    added = [f.name for f in fields]
    lower = {a.lower() for a in added}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in lower]
    texts_at = kept.index(text_col) if text_col in kept else len(kept)
    source = df.select([F.col(f"`{c}`") for c in kept] + ([F.col(f"`{text_col}`").alias("__text")] if texts_at == len(kept) else []))
    carry = range(len(kept))
    schema = T.StructType([source.schema[c] for c in kept] + fields)
    arrow = pa.schema([pa.field(f.name, _arrow_type(f.dataType)) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = kernel()
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(texts_at).to_pylist()]
            carried = batch.select(carry)
            for lo, hi in spans_by_size(texts):
                made = apply(texts[lo:hi])
                columns = [carried.column(i).slice(lo, hi - lo) for i in range(carried.num_columns)]
                yield pa.RecordBatch.from_arrays(
                    columns + [a.cast(f.type) for a, f in zip(made, arrow, strict=True)],
                    schema=pa.schema([*carried.schema, *arrow]),
                )

    return source.mapInArrow(run, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    plain = {
        "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
        "boolean": pa.bool_(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()),
    }
    return plain[kind.simpleString()]
