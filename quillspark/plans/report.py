"""The Markdown report of an experiment, from its small summaries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = (("precision", "Precision"), ("hit", "Hit"), ("reciprocal_rank", "MRR"), ("evidence_recall", "Evidence recall"), ("completeness", "Completeness"), ("complete_answer", "Complete answers"))


MEANINGS = (
    ("Precision", "the share of the first k chunks that are relevant: they hold half of a passage, or a passage holds half of them"),
    ("Hit", "1 if any of them is relevant"),
    ("MRR", "one divided by the rank of the first relevant chunk, 0 without one"),
    ("Evidence recall", "the share of passages of which at least four fifths were delivered"),
    ("Completeness", "the share of all passages' characters that were delivered"),
    ("Complete answers", "1 if every passage was found"),
    ("Context chars", "how much text was delivered"),
)
#: Lines of the report on semantic cuts; the whole table is written beside it.
MOST_CUTS = 200


def clip(text: str, size: int) -> str:
    """One line of a table cell: blanks squeezed, bars escaped, the end cut."""
    text = re.sub(r"\s+", " ", text).strip().replace("|", "\\|")
    return text if len(text) <= size else text[: size - 1].rstrip() + "…"


def clip_left(text: str, size: int) -> str:
    text = re.sub(r"\s+", " ", text).strip().replace("|", "\\|")
    return text if len(text) <= size else "…" + text[len(text) - size + 1 :].lstrip()


def bold(text: str, yes: bool) -> str:
    return f"**{text}**" if yes else text


def table(head: list[str], rows: list[list[str]]) -> str:
    return "\n".join("| " + " | ".join(r) + " |" for r in [head, ["---"] * len(head), *rows])


def render(name: str, k: int, frames: dict[str, DataFrame], model: str = "") -> str:
    """Setup, results at k, at every k, by document and by question with the best value in bold, cuts near answers, and what the metrics mean."""
    summary = frames["summary"].orderBy("label", "k").collect()  # labels times ks
    stats = {r.label: r for r in frames["stats"].collect()}
    at_k = [[r.label, str(stats[r.label].chunks), f"{stats[r.label].avg_chars:.0f}", *(f"{r[m]:.2f}" for m, _ in COLUMNS), f"{r.context_chars:.0f}"] for r in summary if r.k == k]
    every = [[r.label, str(r.k), f"{r.completeness:.2f}", f"{r.reciprocal_rank:.2f}"] for r in summary]
    rows = frames["by_document"].collect()  # labels times files of a gold set
    labels = sorted({r.label for r in rows})
    best = {f: max(r.completeness for r in rows if r.filename == f) for f in {r.filename for r in rows}}
    value = {(r.filename, r.label): r.completeness for r in rows}
    by_file = [[f, *(bold(f"{value[f, x]:.2f}", value[f, x] == best[f]) if (f, x) in value else "" for x in labels)] for f in sorted(best)]
    asked = frames["questions_by_document"].orderBy("filename").collect()
    setup = [f"- Embeddings: {model}", f"- Questions: {sum(r.questions for r in asked)}, passages: {sum(r.passages for r in asked)}", f"- Configurations: {len(labels)}"]
    each = {(r.question_id, r.label): r.completeness for r in frames["metrics"].filter(F.col("k") == k).collect()}  # questions times labels
    by_question = []
    for q in sorted({q for q, _ in each}):
        most = max(v for (p, _), v in each.items() if p == q)
        by_question.append([clip(str(q), 40), *(bold(f"{each[q, x]:.2f}", each[q, x] == most) if (q, x) in each else "" for x in labels)])
    parts = [
        f"# {name}", "## Setup", "\n".join(setup), table(["Document", "Questions", "Passages"], [[r.filename, str(r.questions), str(r.passages)] for r in asked]),
        f"## Results at k = {k}", table(["Configuration", "Chunks", "Avg chars", *(t for _, t in COLUMNS), "Context chars"], at_k), "## All k", table(["Configuration", "k", "Completeness", "MRR"], every),
        f"## Completeness by document at k = {k}", table(["Document", *labels], by_file), f"## Completeness by question at k = {k}", table(["Question", *labels], by_question),
    ]
    if "boundaries" in frames:
        rows = frames["boundaries"].orderBy("label", "question_id", "position", "document_id", "idx").limit(MOST_CUTS).collect()
        state = lambda r: "forced" if r.forced else "cut" if r.cut else "barred" if r.barred else ""
        parts += ["## Semantic cuts near answers", table(["Configuration", "Question", "Document", "Sentence", "Distance", "Cut"], [[r.label, str(r.question_id), r.document_id, str(r.idx), "" if r.distance is None else f"{r.distance:.3f}", state(r)] for r in rows])]
    parts += ["## What the metrics mean", "\n".join(f"- {title}: {text}" for title, text in MEANINGS)]
    return "\n\n".join(parts) + "\n"
