"""Sessions, and getting this package to the Python workers."""

from __future__ import annotations

import atexit
import hashlib
import io
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from itertools import islice
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession

_local: dict[str, str] = {}
_shipped: set[str] = set()


def session(app: str = "quillspark", **conf: str) -> SparkSession:
    """A session with the settings this engine is written for; a cluster's own settings win over them."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; only a local session without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _local.get("dir") or _local.setdefault("dir", f"file://{tempfile.mkdtemp(prefix='quillspark-')}")


def hadoop_path(spark: SparkSession, path: str):
    """The file system that holds a path, and the path, as Hadoop knows them."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def spread(rows: DataFrame) -> DataFrame:
    """Rows over all cores if they come from fewer files than there are cores; large inputs stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    files = len(rows._jdf.inputFiles())
    return rows.repartition(cores) if 0 < files < cores else rows


def in_blocks(rows: DataFrame, size: int) -> Iterator[list[Row]]:
    """All rows, in lists of at most ``size``; the driver fetches one partition at a time."""
    fetched = rows.toLocalIterator()
    while block := list(islice(fetched, size)):
        yield block


def write_bytes(spark: SparkSession, path: str, data: bytes, overwrite: bool = True) -> None:
    fs, where = hadoop_path(spark, path)
    out = fs.create(where, overwrite)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A small file, whole."""
    fs, where = hadoop_path(spark, path)
    stream = fs.open(where)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder."""
    try:
        fs, where = hadoop_path(spark, path)
        fs.delete(where, True)
    except Exception:  # the session is gone; the cluster's own clean-up of the folder remains
        pass


def written(rows: DataFrame) -> tuple[DataFrame, str]:
    """Rows as a table in the shared folder, which cuts their lineage, and its path; it goes with ``remove`` or at exit."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/quillspark-rows-{uuid.uuid4().hex[:8]}"
    atexit.register(remove, spark, path)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path), path


def ship(spark: SparkSession) -> None:
    """Send this package to the workers once per application, for clusters where it isn't installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    image = io.BytesIO()
    with zipfile.ZipFile(image, "w", zipfile.ZIP_DEFLATED) as packed:
        for path in sorted(top.rglob("*.py")):
            packed.write(path, str(path.relative_to(top.parent)))
    name = hashlib.sha256(image.getvalue()).hexdigest()[:16]
    folder = f"{shared_dir(spark)}/quillspark-code-{uuid.uuid4().hex[:8]}"
    path = f"{folder}/quillspark-{name}.zip"
    write_bytes(spark, path, image.getvalue())
    atexit.register(remove, spark, folder)
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
