"""Text functions as native column expressions: cleaning, identities, labels, windows, vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words as Python's ``\\w+`` finds them.
WORD = r"([\p{L}\p{N}_]+)"
DEFAULT_TENANT = "default"


def clean_text(text: Column) -> Column:
    """Line ends, no-break spaces, private-use and control characters, blank runs, blank lines, ends."""
    steps = [
        (r"\r\n?", "\n"), (r"\u00A0", " "), (r"[\uE000-\uF8FF]", ""), (r"[\x00-\x08\x0B-\x1F\x7F]", ""),
        (r"[ \t]+", " "), (r" +\n", "\n"), (r"\n{3,}", "\n\n"), (r"(?U)^\s+|\s+$", ""),
    ]
    return reduce(lambda t, s: F.regexp_replace(t, *s), steps, text)


def content_hash(data: Column) -> Column:
    return F.sha2(data.cast("binary"), 256)


def document_id(digest: Column, section: Column) -> Column:
    """The first 16 digits of the file's hash, and the section's number from 1."""
    return F.concat(F.substring(digest, 1, 16), F.lit("-"), section.cast("string"))


def file_key(doc_id: Column) -> Column:
    """A document id without its section number."""
    return F.regexp_replace(doc_id, "-[^-]*$", "")


def document_label(filename: Column, page: Column) -> Column:
    return F.coalesce(F.concat(F.lit("page "), page.cast("string")), filename)


def tenant(tenant_id: Column) -> Column:
    return F.coalesce(tenant_id, F.lit(DEFAULT_TENANT))


def legacy_filename(filename: Column, source: Column) -> Column:
    return F.coalesce(filename, source)


def legacy_document_id(doc_id: Column, chunk_id: Column) -> Column:
    """The recorded id, else what stands before the last ``_chunk_``."""
    found = F.regexp_extract(chunk_id, "^(?s)(.*)_chunk_", 1)
    return F.coalesce(doc_id, F.when(chunk_id.contains("_chunk_"), found).otherwise(chunk_id))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null for vectors of different length and for zero vectors."""
    return F.when((F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b)))


def hash_bucket(word: Column, size: int) -> Column:
    """The first four bytes of the word's MD5, as a little-endian number, modulo ``size``."""
    h = F.md5(word.cast("binary"))
    turned = F.concat(*[F.substring(h, at, 2) for at in (7, 5, 3, 1)])
    return (F.conv(turned, 16, 10).cast("long") % size).cast("int")


def hash_buckets(text: Column, size: int) -> Column:
    """The bucket of every word of the text."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(1)), lambda w: hash_bucket(w, size))


def run_lengths(ordered: Column) -> Column:
    """value and n of each run of equal values of a sorted array; null for an empty one."""
    first = F.filter(F.transform(ordered, lambda x, i: F.when((i == 0) | (F.get(ordered, i - 1) != x), i)), lambda i: i.isNotNull())
    ends = F.concat(F.slice(first, 2, F.greatest(F.size(first), F.lit(1))), F.array(F.size(ordered)))
    return F.when(F.size(ordered) > 0, F.zip_with(first, ends, lambda a, z: F.struct(F.get(ordered, a).alias("value"), (z - a).cast("long").alias("n"))))
