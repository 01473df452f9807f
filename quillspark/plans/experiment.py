"""Experiments: many chunking configurations over one corpus and one question set, as frames keyed by label."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.embedding import HashProvider, Provider
from ..operators import evaluation as V
from ..operators.chunking import DEFAULT_PARAMS, chunk, semantic_boundaries
from ..operators.embed import embed
from ..operators.store import top_k_batch
from ..session import write_bytes
from ..sources.files import ingest, load_questions
from .report import render


@dataclass(frozen=True)
class Spec:
    label: str
    strategy: str
    params: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Config:
    name: str
    corpus_dir: str
    questions: str
    output_dir: str
    specs: list[Spec]
    top_k: int = 3
    ks: tuple[int, ...] = (1, 3, 5)
    expand_context: bool = True
    embedding_model: str = "hash-512"

    def __post_init__(self) -> None:
        if len({s.label for s in self.specs}) < len(self.specs):
            raise ValueError("labels repeat")
        object.__setattr__(self, "ks", tuple(sorted({*self.ks, self.top_k})))

    @staticmethod
    def read(path: str) -> Config:
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        specs = [Spec(label, s["strategy"], s.get("params", {})) for label, s in raw["strategies"].items()]
        more = {k: raw[k] for k in ("top_k", "expand_context", "embedding_model") if k in raw}
        return Config(raw["name"], raw["corpus_dir"], raw["questions"], raw["output_dir"], specs, ks=tuple(raw.get("ks", (1, 3, 5))), **more)

    def only(self, labels: list[str]) -> Config:
        unknown = set(labels) - {s.label for s in self.specs}
        if unknown:
            raise ValueError(f"no such labels: {', '.join(sorted(unknown))}")
        return Config(self.name, self.corpus_dir, self.questions, self.output_dir, [s for s in self.specs if s.label in labels], self.top_k, self.ks, self.expand_context, self.embedding_model)


def chunks_by_label(documents: DataFrame, specs: list[Spec], provider: Provider) -> DataFrame:
    """All configurations' chunks in one frame."""
    return reduce(DataFrame.unionByName, [chunk(documents, s.strategy, s.params, provider=provider).withColumn("label", F.lit(s.label)) for s in specs])


def rankings(chunks: DataFrame, questions: DataFrame, provider: Provider, k: int) -> DataFrame:
    """The k nearest retrievable chunks of every question under every label."""
    asked = embed(questions.select("question_id", "question").distinct(), provider, "question", name="query").select(F.col("question_id").alias("query_id"), "query")
    out = []
    for label in [r.label for r in chunks.select("label").distinct().orderBy("label").collect()]:  # labels of the configuration
        rows = embed(chunks.filter((F.col("label") == label) & F.col("retrievable")), provider)
        found = top_k_batch(rows, asked, k)
        out.append(found.withColumnRenamed("query_id", "question_id").withColumn("label", F.lit(label)))
    return reduce(DataFrame.unionByName, out)


def delivered(ranked: DataFrame, chunks: DataFrame, expand: bool) -> DataFrame:
    """The spans handed to a reader: the chunks', or those of their contexts."""
    spans = ranked.join(chunks.select("label", "chunk_id", "document_id", "start", "end", "context_id"), ["label", "chunk_id"])
    if not expand:
        return spans
    around = chunks.select("label", F.col("chunk_id").alias("context_id"), F.col("start").alias("cs"), F.col("end").alias("ce"))
    joined = spans.join(around, ["label", "context_id"], "left")
    return joined.withColumns({"start": F.coalesce("cs", "start"), "end": F.coalesce("ce", "end")}).drop("cs", "ce")


def run(spark: SparkSession, config: Config, provider: Provider | None = None) -> dict[str, DataFrame]:
    """Chunk, retrieve, measure and write; returns the frames that were written."""
    provider = provider or HashProvider(512)
    documents, log = ingest(spark, config.corpus_dir)
    failed = log.filter("error IS NOT NULL").limit(1).collect()
    if failed:
        raise ValueError(failed[0].error)
    documents = documents.persist()
    questions = load_questions(spark, config.questions)
    section = F.regexp_extract("document_id", r"-(\d+)$", 1).cast("int")
    gold = V.locate(questions, documents.withColumn("section", section)).persist()
    lost = questions.join(gold, ["question_id", "position"], "left_anti").select("question_id").distinct().limit(5).collect()
    if lost:
        raise ValueError(f"passages aren't in their documents: {', '.join(sorted(r.question_id for r in lost))}")
    chunks = chunks_by_label(documents, config.specs, provider).persist()
    ranked = rankings(chunks, questions, provider, max(config.ks)).persist()
    plain = ranked.join(chunks.select("label", "chunk_id", "document_id", "start", "end"), ["label", "chunk_id"])
    measured = V.question_metrics(plain, delivered(ranked, chunks, config.expand_context), gold, list(config.ks), ["label"]).persist()
    named = measured.join(questions.select("question_id", "filename").distinct(), "question_id")
    frames = {
        "chunks": chunks, "retrieval": plain, "metrics": measured, "summary": V.averages(measured, ["label", "k"]),
        "by_document": V.averages(named.filter(F.col("k") == config.top_k), ["label", "filename"]), "stats": chunks.groupBy("label").agg(F.count_if("retrievable").alias("chunks"), F.round(F.avg(F.when(F.col("retrievable"), F.length("text"))), 2).alias("avg_chars")),
        "cases": V.overlaps(chunks.filter("retrievable"), gold, []).join(plain.select("label", "question_id", "chunk_id", "rank"), ["label", "question_id", "chunk_id"], "left"),
    }
    frames["chunks_by_document"] = chunks.filter("retrievable").groupBy("label", "document_id").agg(F.count("*").alias("chunks"))
    frames["questions_by_document"] = questions.groupBy("filename").agg(F.countDistinct("question_id").alias("questions"), F.count("*").alias("passages"))
    near = [V.boundaries_near(semantic_boundaries(documents, provider, s.params), gold).withColumn("label", F.lit(s.label)) for s in config.specs if s.strategy == "semantic"]
    if near:
        frames["boundaries"] = reduce(DataFrame.unionByName, near)
    used = {s.label: {"strategy": s.strategy, "params": {**DEFAULT_PARAMS.get(s.strategy, {}), **s.params}} for s in config.specs}
    write_bytes(spark, f"{config.output_dir}/config.json", json.dumps({"name": config.name, "corpus_dir": config.corpus_dir, "questions": config.questions, "top_k": config.top_k, "ks": config.ks, "expand_context": config.expand_context, "embedding_model": provider.name, "strategies": used}, default=str).encode())
    for name, frame in frames.items():
        (frame.write.partitionBy("label") if name in ("chunks", "retrieval") else frame.coalesce(1).write).mode("overwrite").json(f"{config.output_dir}/{name}")
    write_bytes(spark, f"{config.output_dir}/report.md", render(config.name, config.top_k, frames, provider.name).encode())
    for held in (documents, gold, chunks, ranked, measured):
        held.unpersist()
    return {name: spark.read.schema(frame.schema).json(f"{config.output_dir}/{name}") for name, frame in frames.items()}

