"""WARC (6): archives written natively, read by boundary-chain verification.

Writing: a record per page, as text files of a shared folder. Of pages with equal payloads of
at least ``min_bytes`` the one with the largest id is a response, the others are revisits that refer to it.

Reading: each file is cut into byte ranges. A task looks for the record magic anywhere in its range and
emits, for each place, where the record there would end: a candidate and its successor. Most are
records, but a payload may hold the magic too. Inside a range the chains are followed at once; across ranges,
pointer jumping from the start of each file doubles the steps until nothing new is reached.
Only places on the chain that begins at offset 0 are records. Payloads are then cut out of the files by their offsets. A header may
have any length. A file's bytes pass through one task, so files are written with about ``FILE_BYTES`` at most (a file holds one
record at least); files of others are read alike, below 2 GiB.

A broken chain is an error: a record that is reached but can't be read, or one whose successor is no candidate, raises.

Edge cases: null html is an empty payload; null urls leave out the target; a null page_id is written as "null" and comes back null;
rows that repeat the largest id with the same payload are all responses; empty tables give empty archives; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialise, scratch_path

MAGIC = b"WARC/1.0\r\n"
BLANK = b"\r\n\r\n"
#: Bytes of a range; a task holds a file and its ranges.
RANGE = 1 << 20
#: Bytes after a range that are read with it, for the header and block that begin in it.
OVERLAP = 1 << 16
#: Records of a written file, and about its bytes.
PER_FILE = 1000
FILE_BYTES = 64 << 20
# RFC 4648.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
NAME = "urn:page:"
# Fixed value: WARC 1.0, revisits of an identical payload.
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def base32_sha1(payload: F.Column) -> F.Column:
    """160 bits as 32 letters, from eight groups of five hexadecimal digits."""

    def groups(digits: F.Column) -> F.Column:
        return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(digits, i * 5 + 1, F.lit(5)), 16, 10).cast("int"))

    def letter(v: F.Column, shift: int) -> F.Column:
        return F.substring(F.lit(BASE32), F.shiftright(v, shift).bitwiseAND(31) + 1, F.lit(1))

    # as a lambda's variable the hash is computed once
    return F.transform(F.array(F.sha1(payload)), lambda d: F.array_join(F.transform(groups(d), lambda v: F.concat(*[letter(v, s) for s in (15, 10, 5, 0)])), ""))[0]


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write one record per page to WARC files under ``path``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    mean = rows.agg(F.avg(F.octet_length("payload") + F.coalesce(F.octet_length("url"), F.lit(0)))).first()[0] or 0
    rows = rows.withColumn("digest", base32_sha1(F.col("payload").cast("binary"))).withColumn("bytes", F.octet_length("payload"))
    same = rows.filter(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("m")).filter("m > 1")
    rows = rows.join(materialise(same.select("digest", "first"), "same"), "digest", "left")
    revisit = F.coalesce((F.col("page_id") != F.col("first")) | (F.col("page_id").isNull() & F.col("first").isNotNull()), F.lit(False)) & (F.col("bytes") >= min_bytes)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("bytes").cast("string")), F.lit("\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    record = F.concat(
        F.lit(MAGIC.decode()), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit(f"<{NAME}"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(">"))), F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\n"),
        F.coalesce(line("WARC-Target-URI", F.translate("url", "\r\n", "")), F.lit("")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\n"), line("WARC-Refers-To", F.concat(F.lit(f"<{NAME}"), F.col("first").cast("string"), F.lit(">"))))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block, F.lit("\r\n"),
    )
    each = max(1, min(PER_FILE, int(FILE_BYTES / (mean + 500))))
    rows.select(record.alias("value")).write.option("lineSep", "\r\n").option("maxRecordsPerFile", each).text(path)


def _fields(lines: bytes) -> dict[str, str] | None:
    """The fields of a header; None if this is none."""
    fields = {}
    for text in lines.split(b"\r\n"):
        name, colon, value = text.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return fields if fields.get("content-length", "").isdigit() else None


CANDIDATE = T.StructType([T.StructField("file", T.StringType()), T.StructField("part", T.LongType()), T.StructField("at", T.LongType()), T.StructField("next", T.LongType()), T.StructField("leaves", T.LongType()), T.StructField("block", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("record_id", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("refers_to", T.StringType()), T.StructField("n", T.LongType()), T.StructField("sha", T.StringType())])


def _payload(kind: str | None, digest: str | None, block: bytes) -> tuple[int | None, str | None]:
    """Size and digest of the payload of a whole block; a revisit records those of the payload that it leaves out."""
    head, blank, payload = block.partition(b"\r\n\r\n")
    if kind == "response":
        return len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    size = re.search(rb"(?i)content-length: *([0-9]+)", head)
    return int(size[1]) if size else None, (digest or "").removeprefix("sha1:")


def follow(at: np.ndarray, following: np.ndarray, end: int) -> np.ndarray:
    """For each candidate of a range where its chain leaves the range, or -1 if it ends at no candidate.

    Pointer jumping: each step replaces a pointer by its target's pointer, so steps double.
    """
    n = len(at)
    where = np.searchsorted(at, following)
    inside = (where < n) & (following < end)
    inside[inside] = at[where[inside]] == following[inside]
    jump = np.where(inside, where, np.arange(n))
    for _ in range(max(1, int(n).bit_length())):
        jump = jump[jump]
    last = following[jump]
    return np.where(last >= end, last, -1)


def _read_ranges(files: DataFrame, overlap: int) -> DataFrame:
    """Every place of the magic in the ranges ``parts`` of files; one whose header doesn't end within ``overlap`` bytes has no successor."""
    cut = F.transform("parts", lambda i: F.struct(i.alias("part"), F.substring(F.col("content"), (i * RANGE + 1).cast("int"), F.lit(RANGE + overlap)).alias("data")))
    ranges = files.select("file", "length", F.explode(cut).alias("r")).select("file", "length", "r.part", "r.data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, total, part, data = (batch.column(k)[i].as_py() for k in range(4))
                base, end = part * RANGE, min((part + 1) * RANGE, total)
                found, at = [], data.find(MAGIC)
                while 0 <= at < end - base:
                    close = data.find(BLANK, at)
                    if close < 0 and base + len(data) < total:
                        found.append((base + at, None, None, None, None, None, None, None, None))
                    elif close >= 0 and (fields := _fields(data[at + len(MAGIC) : close])) is not None:
                        block = close + len(BLANK)
                        stop = block + int(fields["content-length"])
                        kind, digest = fields.get("warc-type"), fields.get("warc-payload-digest")
                        # a block that reaches beyond this range's bytes is read later
                        size, sha = _payload(kind, digest, data[block:stop]) if stop <= len(data) else (None, None)
                        found.append((base + at, base + stop + 4, base + block, kind, fields.get("warc-record-id"), digest, fields.get("warc-refers-to"), size, sha))
                    at = data.find(MAGIC, at + 1)
                if not found:
                    continue
                at, following, block, *rest = zip(*found, strict=True)
                leaves = follow(np.array(at), np.array([-1 if f is None else f for f in following]), end)
                n = len(found)
                columns = [[name] * n, [part] * n, at, following, leaves, block, *rest]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if f.dataType == T.StringType() else pa.int64()) for c, f in zip(columns, CANDIDATE, strict=True)], names=CANDIDATE.names)

    return ranges.mapInArrow(run, CANDIDATE)


def candidates(files: DataFrame) -> DataFrame:
    """Every place of the magic in every range, with its successor and where its chain leaves the range; written.

    Ranges in which a header doesn't end are read again with more bytes after them, until all headers have ended.
    """
    size = F.col("length")
    whole = files.filter(size > 0).withColumn("parts", F.sequence(F.lit(0).cast("long"), F.ceil(size / RANGE).cast("long") - 1))
    overlap = OVERLAP
    found = materialise(_read_ranges(whole, overlap), "candidates")
    while not (unended := found.filter("next IS NULL")).isEmpty():
        overlap *= 16
        parts = materialise(unended.select("file", "part").distinct(), "parts")
        again = _read_ranges(files.join(parts.groupBy("file").agg(F.collect_set("part").alias("parts")), "file"), overlap)
        before, found = found, materialise(found.join(parts, ["file", "part"], "left_anti").unionByName(again), "candidates")
        discard(before, parts)
    return found


def _reached(found: DataFrame, files: DataFrame, most_parts: int) -> DataFrame:
    """(file, at): the chain's first record in each range that it enters, by pointer jumping over ranges."""
    jump = found.filter("leaves >= 0").select("file", "at", F.col("leaves").alias("to"))
    reached = files.select("file", F.lit(0).cast("long").alias("at"))
    for _ in range(max(1, int(most_parts).bit_length())):
        step = reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))
        reached = materialise(reached.unionByName(step).distinct(), "reached")
        then = jump.select("file", F.col("at").alias("to"), F.col("to").alias("on"))
        jump = materialise(jump.join(then, ["file", "to"], "left").select("file", "at", F.coalesce("on", "to").alias("to")), "jump")
    return reached


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and payload (null for revisits) of every record.

    Without payloads only records that reach far over a range are cut out of their files again.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select(F.col("path").alias("file"), "length", "content")
    sizes = materialise(files.filter("length > 0").select("file", "length"), "files")
    found = candidates(files)
    most = sizes.agg(F.max("length")).first()[0] or 0
    entries = _reached(found, sizes, -(-most // RANGE) + 1)

    # From the entries the chains are followed inside each range: a few numbers a range.
    entry = entries.select("file", F.col("at").alias("entry")).withColumn("part", F.floor(F.col("entry") / RANGE).cast("long"))
    lists = found.groupBy("file", "part").agg(F.sort_array(F.collect_list(F.struct("at", "next"))).alias("c"))
    lists = entry.join(sizes, "file").filter(F.col("entry") < F.col("length")).join(materialise(lists, "lists"), ["file", "part"], "left")
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("at", T.LongType())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                following = {c["at"]: c["next"] for c in row["c"] or []}
                at, end, chain = row["entry"], min((row["part"] + 1) * RANGE, row["length"]), []
                while at < end:
                    if at not in following:
                        raise ValueError(f"{row['file']}: no record at {at}, where one is due")
                    chain.append(at)
                    at = following[at]
                if at > row["length"]:
                    raise ValueError(f"{row['file']}: the record at {chain[-1]} is cut off")
                yield pa.RecordBatch.from_arrays([pa.array([row["file"]] * len(chain), pa.string()), pa.array(chain, pa.int64())], names=["file", "at"])

    records = found.join(lists.select("file", "part", "entry", "length", "c").mapInArrow(walk, schema), ["file", "at"])
    records = materialise(records.drop("part", "leaves"), "records")
    number = lambda c: F.regexp_extract(c, rf"<{NAME}(-?\d+)>", 1).try_cast("bigint")
    ids = [number("record_id").alias("page_id"), F.col("kind").alias("record_type"), number("refers_to").alias("refers_to")]
    order = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    near = records.filter("n IS NOT NULL").select(*ids, F.col("n").alias("payload_bytes"), F.col("sha").alias("payload_digest"), F.lit(None).cast("binary").alias("payload")).select(order)
    rest = records if with_payload else records.filter("n IS NULL")
    if not with_payload and rest.isEmpty():
        return near
    per_file = rest.groupBy("file").agg(F.collect_list(F.struct("block", "next", "kind", "record_id", "digest", "refers_to")).alias("r"))
    # The block's own header ends at the first blank line; what follows is the payload.
    whole = files.join(materialise(per_file, "per_file"), "file").select(F.explode(F.transform("r", lambda r: F.struct(r.alias("r"), F.substring(F.col("content"), (r["block"] + 1).cast("int"), (r["next"] - 4 - r["block"]).cast("int")).alias("b")))).alias("x")).select("x.r.*", F.col("x.b").alias("b"))
    blank = F.position(F.lit(b"\r\n\r\n"), F.col("b")).cast("int")
    head = F.decode(F.substring(F.col("b"), F.lit(1), blank), "ISO-8859-1")
    payload = F.when(F.col("kind") == "response", F.substring(F.col("b"), blank + 4, F.octet_length("b")))
    far = whole.withColumn("payload", payload).select(
        *ids, F.coalesce(F.octet_length("payload").cast("long"), F.regexp_extract(head, r"Content-Length: ([0-9]+)", 1).cast("long")).alias("payload_bytes"),
        F.when(F.col("payload").isNotNull(), base32_sha1(F.col("payload"))).otherwise(F.regexp_replace("digest", "^sha1:", "")).alias("payload_digest"), "payload",
    ).select(order)
    return far if with_payload else near.unionByName(far)


def roundtrip(pages: DataFrame, min_bytes: int = 0, with_payload: bool = True) -> DataFrame:
    """Write the pages' archives to the shared folder and read them back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, min_bytes)
    return read_archives(spark, path, with_payload)
