"""Evaluation: gold passages against retrieved spans, as joins, windows and aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import in_blocks, spread

#: A span is relevant if it holds this share of a passage, or the passage this share of it.
RELEVANT = 0.5
#: A passage is found if this share of it was delivered.
FOUND = 0.8
METRICS = ("precision", "hit", "reciprocal_rank", "evidence_recall", "completeness", "complete_answer", "context_chars")


def locate(evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """question_id, position, document_id, e_start, e_end of passages, in the first document of their file that holds them.

    ``documents`` needs document_id, filename, text and section (their order in the file).
    """
    found = evidence.join(documents, "filename").withColumn("at", F.instr(F.col("text"), F.col("passage"))).filter("at > 0")
    first = found.groupBy("question_id", "position").agg(F.min_by(F.struct("document_id", "at", F.length("passage").alias("n")), "section").alias("f"))
    return first.select("question_id", "position", "f.document_id", (F.col("f.at") - 1).alias("e_start"), (F.col("f.at") - 1 + F.col("f.n")).alias("e_end"))


def locate_anywhere(passages: DataFrame, documents: DataFrame, limit: int = 10_000) -> DataFrame:
    """question_id, position 0, document_id, e_start, e_end: the first place of each passage in every document that holds it.

    Passages (question_id, passage) that are null or empty are in no document. The others go to all tasks in
    blocks of ``limit``; documents are read once for each block and not shuffled.
    """
    asked = passages.select("question_id", "passage").filter(F.length("passage") > 0)
    schema = T.StructType([T.StructField("question_id", passages.schema["question_id"].dataType), T.StructField("document_id", T.StringType()), T.StructField("e_start", T.IntegerType()), T.StructField("e_end", T.IntegerType())])
    texts, arrow = spread(documents.select(F.col("document_id").cast("string"), "text")), to_arrow_schema(schema)

    def finder(held: list[tuple]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        shared = documents.sparkSession.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], names=schema.names)
            for batch in batches:
                found = []
                for i in range(batch.num_rows):  # one text at a time
                    text = batch.column(1)[i].as_py() or ""
                    at_hand = batch.column(0)[i].as_py()
                    found += [(q, at_hand, at, at + len(p)) for q, p in shared.value if (at := text.find(p)) >= 0]
                    if len(found) >= 10_000:
                        yield batch_of(found)
                        found = []
                if found:
                    yield batch_of(found)

        return run

    parts = [texts.mapInArrow(finder([tuple(r) for r in block]), schema) for block in in_blocks(asked, limit)]
    rows = reduce(DataFrame.unionByName, parts) if parts else documents.sparkSession.createDataFrame([], schema)
    return rows.select("question_id", F.lit(0).alias("position"), "document_id", "e_start", "e_end")


def holding(documents: DataFrame, evidence: DataFrame, slots: int = 1 << 19) -> DataFrame:
    """The documents that hold a passage: others have no chunk that shares characters with one, so they needn't be cut.

    A bitmap of at most ``slots`` 64-bit slots goes out by broadcast, so of the other documents hardly any is shuffled; the join
    after it is exact. ``evidence`` is read twice, so it should be a table.
    """
    place = F.pmod(F.xxhash64("document_id"), F.lit(slots * 64))
    ids = evidence.select("document_id").distinct()
    bits = ids.select(place.alias("__h")).groupBy(F.shiftright("__h", 6).alias("__slot")).agg(F.expr("bit_or(shiftleft(1L, cast(__h & 63 as int)))").alias("__bits"))
    marked = documents.withColumn("__h", place).withColumn("__slot", F.shiftright("__h", 6)).join(F.broadcast(bits), "__slot")
    return marked.filter("bit_get(__bits, cast(__h & 63 as int)) = 1").join(ids, "document_id", "left_semi").select(documents.columns)


def overlaps(spans: DataFrame, evidence: DataFrame, by: list[str]) -> DataFrame:
    """Spans joined to the passages they share characters with, and how many."""
    keys = [k for k in (*by, "document_id") if k in evidence.columns]
    joined = spans.join(evidence, keys).filter((F.col("start") < F.col("e_end")) & (F.col("e_start") < F.col("end")))
    return joined.withColumn("shared", F.least("end", "e_end") - F.greatest("start", "e_start"))


def relevant() -> Column:
    shared = F.col("shared")
    return (shared >= RELEVANT * (F.col("e_end") - F.col("e_start"))) | (shared >= RELEVANT * (F.col("end") - F.col("start")))


def covered(spans: DataFrame, evidence: DataFrame, by: list[str]) -> DataFrame:
    """Characters of each passage inside the union of the spans: (by..., position, covered)."""
    clipped = overlaps(spans.select(*by, "document_id", "start", "end").distinct(), evidence, by).withColumns({"a": F.greatest("start", "e_start"), "b": F.least("end", "e_end")})
    before = Window.partitionBy(*by, "position").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.col("b") - F.greatest("a", F.coalesce(F.max("b").over(before), F.col("a"))), F.lit(0))
    return clipped.withColumn("fresh", fresh).groupBy(*by, "position").agg(F.sum("fresh").alias("covered"))


def question_metrics(rankings: DataFrame, delivered: DataFrame, evidence: DataFrame, ks: list[int], by: list[str] | None = None) -> DataFrame:
    """The seven metrics for every question and k.

    ``rankings`` and ``delivered`` hold by..., question_id, rank, document_id, start, end; ``evidence``
    question_id, position, document_id, e_start, e_end. A ranking is made once; each k takes its first rows.
    """
    by = by or []
    keys = [*by, "question_id", "k"]
    cut = lambda rows: rows.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter("rank <= k")
    own = [*by, "question_id"]
    hits = overlaps(rankings, evidence, own).filter(relevant()).select(*own, "rank").distinct().withColumn("rel", F.lit(1))
    judged = cut(rankings.join(hits, [*own, "rank"], "left"))
    ranked = judged.groupBy(*keys).agg((F.coalesce(F.sum("rel"), F.lit(0)) / F.count("*")).alias("precision"), F.coalesce(F.max("rel"), F.lit(0)).cast("double").alias("hit"), F.coalesce(1 / F.min(F.when(F.col("rel") == 1, F.col("rank"))), F.lit(0.0)).alias("reciprocal_rank"))
    given = cut(delivered)
    chars = given.select(*keys, "document_id", "start", "end").distinct().groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("context_chars"))
    asked = (rankings.select(*by).distinct().crossJoin(evidence) if by else evidence).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    reach = covered(given, evidence, keys)
    passages = asked.join(reach, [*keys, "position"], "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    length = F.col("e_end") - F.col("e_start")
    found = (F.col("covered") >= FOUND * length).cast("int")
    told = passages.groupBy(*keys).agg(F.avg(found).alias("evidence_recall"), (F.sum("covered") / F.sum(length)).alias("completeness"), F.min(found).cast("double").alias("complete_answer"))
    out = told.join(ranked, keys, "left").join(chars, keys, "left")
    return out.select(*keys, *[F.coalesce(m, F.lit(0)).alias(m) if m in ("precision", "hit", "reciprocal_rank", "context_chars") else F.col(m) for m in METRICS])


def averages(metrics: DataFrame, by: list[str]) -> DataFrame:
    return metrics.groupBy(*by).agg(*[F.avg(m).alias(m) for m in METRICS])


def best(means: DataFrame, metric: str, among: list[str]) -> DataFrame:
    """``is_best`` marks the highest value of a metric within each group; ties are all best."""
    return means.withColumn("is_best", F.col(metric) == F.max(metric).over(Window.partitionBy(*among)))


def holders(chunks: DataFrame, evidence: DataFrame, rankings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Chunks that share characters with each passage, whether one holds it whole, and their rank, null if not retrieved."""
    by = by or []
    rows = overlaps(chunks.filter("retrievable"), evidence, by)
    whole = (F.col("start") <= F.col("e_start")) & (F.col("e_end") <= F.col("end"))
    return rows.withColumn("whole", whole).join(rankings.select(*by, "question_id", "chunk_id", "rank"), [*by, "question_id", "chunk_id"], "left")


def boundaries_near(analysis: DataFrame, evidence: DataFrame, reach: int = 2) -> DataFrame:
    """Sentences (document_id, idx, start, end, distance, cut) within ``reach`` of those that touch a passage."""
    touched = overlaps(analysis, evidence, []).groupBy("question_id", "position", "document_id").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    return analysis.join(touched, "document_id").filter((F.col("idx") >= F.col("lo") - reach) & (F.col("idx") <= F.col("hi") + reach))
