"""The command line: index a folder, then answer questions; or run an experiment.

    python -m quillspark.plans.app index FOLDER STORE [--strategy NAME] [--settings FILE] [--offline]
    python -m quillspark.plans.app ask STORE [--strategy NAME] [--settings FILE] [--offline]
    python -m quillspark.plans.app experiment CONFIG [--only LABEL ...] [--settings FILE] [--offline]

Settings name the embedding provider, its cache and the chat model (see ``quillspark.settings``); ``--offline`` uses none that needs a network.
"""

from __future__ import annotations

import argparse
import sys

from ..functions.embedding import HashProvider, Provider, RemoteProvider
from ..operators.chunking import DEFAULT_PARAMS
from ..operators.indexing import index, log_lines
from ..operators.retrieval import LLM, Answerer, RemoteLLM, Retriever
from ..operators.store import Store, store_name
from ..session import session
from ..settings import Settings
from ..sources.files import ingest
from . import experiment


class Quote:
    """Stands in for a model: gives back the best passage's text."""

    def generate(self, prompt: str) -> str:
        return prompt.split("Text:\n", 1)[-1].split("\n\n", 1)[0]


def models(settings: Settings, offline: bool = False) -> tuple[Provider, LLM]:
    """The provider and the language model that the settings name, or those that need no network."""
    remote = settings.provider == "remote" and not offline
    provider = RemoteProvider(settings.embedding_model, settings.embedding_size) if remote else HashProvider(512)
    return provider, RemoteLLM(settings.chat_model) if settings.chat_model and not offline else Quote()


def build(spark, root: str, strategy: str = "fixed", provider: Provider | None = None, llm: LLM | None = None, top_k: int = 5, params: dict | None = None) -> tuple[Store, Answerer]:
    """A store named after strategy and parameters, and an answerer over it; context is expanded where the strategy has it."""
    if strategy not in DEFAULT_PARAMS:
        raise ValueError(f"no parameters for {strategy!r}")
    store = Store(spark, f"{root}/{store_name(strategy, {**DEFAULT_PARAMS[strategy], **(params or {})})}")
    expand = strategy in ("parent_child", "hierarchical", "metadata_aware")
    return store, Answerer(Retriever(store, provider or HashProvider(512), top_k, expand), llm or Quote())


def index_folder(spark, folder: str, store: Store, provider: Provider, strategy: str, params: dict | None = None, cache: str | None = None) -> list[str]:
    documents, log = ingest(spark, folder)
    said = [f"{r.name}: {r.error}" for r in log.filter("error IS NOT NULL").orderBy("path").toLocalIterator()]
    return said + list(log_lines(index(store, documents, provider, strategy, params, cache)))


def question_loop(answerer: Answerer, lines=sys.stdin, out=print) -> None:
    for line in lines:
        question = line.strip()
        if question.lower() in ("exit", "quit"):
            return
        if not question:
            continue
        try:
            answer, results = answerer.answer(question)
            out(answer)
            for r in results:
                out(" | ".join([r["chunk_id"], *(f"{n}: {r[k]}" for n, k in (("Source", "filename"), ("Page", "page"), ("Document", "document_id")) if r.get(k) not in (None, ""))]))
        except Exception as error:  # one bad question doesn't end the loop
            out(f"error: {error}")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillspark")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("index")
    one.add_argument("folder")
    one.add_argument("store")
    one.add_argument("--strategy")
    two = commands.add_parser("ask")
    two.add_argument("store")
    two.add_argument("--strategy")
    three = commands.add_parser("experiment")
    three.add_argument("config")
    three.add_argument("--only", nargs="*")
    for command in (one, two, three):
        command.add_argument("--settings")
        command.add_argument("--offline", action="store_true")
    args = parser.parse_args(argv)
    sys.stdout.reconfigure(encoding="utf-8")
    try:
        settings = Settings.read(args.settings)
        provider, llm = models(settings, args.offline)
        spark = session()
        if args.command == "experiment":
            config = experiment.Config.read(args.config)
            experiment.run(spark, config.only(args.only) if args.only else config, provider)
            return 0
        strategy = args.strategy or settings.strategy
        store, answerer = build(spark, args.store, strategy, provider, llm, settings.top_k, settings.params)
        if args.command == "index":
            for line in index_folder(spark, args.folder, store, provider, strategy, settings.params, settings.cache or None):
                print(line)
        else:
            question_loop(answerer)
    except Exception as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
