"""Retrieval and answers: embed, search, expand to context, prompt, generate."""

from __future__ import annotations

import json
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.embedding import Provider
from .store import CHUNK_KEYS, Store

NO_CONTEXT = "No matching documents were found for this question."
#: Left out of prompts: bookkeeping, and text that is there already.
UNSAID = frozenset(CHUNK_KEYS) - {"section_path"} | {"matched_text", "embedding", "text", "chunk_id", "score", "rank", "extra"}
INSTRUCTION = (
    "Answer the question from the passages below and from nothing else. Where they don't hold the answer, reply that the "
    "passages don't say. After every statement name the source, and the page if one is given."
)


class LLM(Protocol):
    def generate(self, prompt: str) -> str: ...


class RemoteLLM:
    """A hosted chat model, one call per prompt. The client is made in the process that uses it."""

    def __init__(self, model: str, client=None):
        self.model, self._client = model, client

    def generate(self, prompt: str) -> str:
        if self._client is None:
            from openai import OpenAI

            self._client = OpenAI()
        answer = self._client.chat.completions.create(model=self.model, messages=[{"role": "user", "content": prompt}], temperature=0)
        return (answer.choices[0].message.content or "").strip()


def generate_all(prompts: DataFrame, llm: LLM, prompt_col: str = "prompt", name: str = "answer") -> DataFrame:
    """Add the model's answer to every prompt, on the executors; a null prompt has a null answer."""
    kept = [c for c in prompts.columns if c.lower() != name.lower()]
    at = kept.index(prompt_col)
    schema = T.StructType([prompts.schema[c] for c in kept] + [T.StructField(name, T.StringType())])

    def run(batches):
        for batch in batches:
            said = [None if p is None else llm.generate(p) for p in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.string())], names=[*kept, name])

    return prompts.select(kept).mapInArrow(run, schema)


def expand_to_context(ranked: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Each result with its context's text; one result per context, at its best rank.

    Needs rank, text, chunk_id, context_id and context_text; ``by`` names the question's columns.
    Results without context pass through. ``matched_text`` keeps the matched chunk's own text.
    """
    by = by or []
    has = F.coalesce(F.length("context_text"), F.lit(0)) > 0
    key = F.when(has, F.coalesce("context_id", "chunk_id"))
    first = F.row_number().over(Window.partitionBy(*by, "__key").orderBy("rank"))
    rows = ranked.withColumn("__key", F.coalesce(key, F.concat(F.lit("\u0000"), F.col("chunk_id")))).withColumn("__nth", first).filter((F.col("__nth") == 1) | ~has)
    return rows.withColumn("matched_text", F.when(has, F.col("text"))).withColumn("text", F.when(has, F.col("context_text")).otherwise(F.col("text"))).drop("__key", "__nth", "context_text")


def source_line(chunk_id: Column, filename: Column, page: Column, document_id: Column) -> Column:
    """Where a chunk comes from; null if nothing is known."""
    said = [F.concat(F.lit("Source: "), F.nullif(filename, F.lit(""))), F.concat(F.lit("Page: "), page.cast("string")), F.concat(F.lit("Document: "), F.nullif(document_id, F.lit("")))]
    known = F.coalesce(*said).isNotNull()
    return F.when(known, F.concat_ws(" | ", chunk_id, *said))


def prompt(question: str, results: list[dict[str, Any]]) -> str:
    """The text for the model, from ranked results."""
    told = []
    for r in results:
        meta = {k: v for k, v in r.items() if k not in UNSAID and v is not None}
        parts = [f"{name}: {r[key]}" for name, key in (("Source", "filename"), ("Page", "page"), ("Document", "document_id")) if r.get(key) not in (None, "")]
        line = [" | ".join([r["chunk_id"], *parts])] if parts else []
        told.append("\n".join([f"Chunk ID: {r['chunk_id']}", f"Similarity score: {r['score']:.6f}", *line, f"Metadata: {json.dumps(meta, sort_keys=True)}", "Text:", r["text"]]))
    context = "\n\n".join(told) or "No context was retrieved."
    return f"System Instructions:\n{INSTRUCTION}\n\nContext:\n{context}\n\nQuestion:\n{question}\n\nAnswer:\n"


def prompts(ranked: DataFrame, by: list[str], question_col: str = "question") -> DataFrame:
    """by... and the prompt of every question, from its ranked results: one row each, with rank, chunk_id, score and text.

    A question has as many results as the search returned, so a group is k rows. Other columns are named as metadata.
    """
    said = [c for c in ranked.columns if c not in (*by, question_col, "rank")]
    grouped = ranked.groupBy(*by, question_col).agg(F.sort_array(F.collect_list(F.struct("rank", *said))).alias("__results"))
    schema = T.StructType([ranked.schema[c] for c in by] + [T.StructField("prompt", T.StringType())])

    def run(batches):
        for batch in batches:
            texts = [prompt(q or "", results) for q, results in zip(batch.column(len(by)).to_pylist(), batch.column(len(by) + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(by)], pa.array(texts, pa.string())], names=[*by, "prompt"])

    return grouped.select(*by, question_col, "__results").mapInArrow(run, schema)


class Retriever:
    def __init__(self, store: Store, provider: Provider, k: int = 5, expand: bool = False):
        self.store, self.provider, self.k, self.expand = store, provider, k, expand

    def retrieve(self, question: str, k: int | None = None, filters: dict[str, Any] | None = None) -> DataFrame:
        if not question.strip():
            raise ValueError("the question must not be empty")
        found = self.store.search(self.provider.embed_batch([question])[0].tolist(), self.k if k is None else k, filters)
        return expand_to_context(found) if self.expand else found


class Answerer:
    def __init__(self, retriever: Retriever, llm: LLM):
        self.retriever, self.llm = retriever, llm

    def answer(self, question: str, k: int | None = None, filters: dict[str, Any] | None = None) -> tuple[str, list[dict[str, Any]]]:
        """The answer and the results it rests on; without results the model isn't asked."""
        results = [r.asDict() for r in self.retriever.retrieve(question, k, filters).drop("embedding").orderBy("rank").collect()]  # k rows at most
        if not results:
            return NO_CONTEXT, results
        said = (self.llm.generate(prompt(question, results)) or "").strip()
        if not said:
            raise ValueError("the model gave no answer")
        return said, results
