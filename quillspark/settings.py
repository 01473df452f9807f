"""Settings of a run: defaults, over them a JSON file, over that environment variables QUILLSPARK_<NAME>."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields
from typing import Any


@dataclass(frozen=True)
class Settings:
    strategy: str = "fixed"
    params: dict[str, Any] = field(default_factory=dict)
    top_k: int = 5
    provider: str = "hash"
    embedding_model: str = "text-embedding-3-small"
    embedding_size: int = 1536
    chat_model: str = ""
    cache: str = ""

    def __post_init__(self) -> None:
        if self.top_k <= 0 or self.embedding_size <= 0:
            raise ValueError("top_k and embedding_size must be greater than zero")
        if self.provider not in ("hash", "remote"):
            raise ValueError("provider must be hash or remote")

    @staticmethod
    def read(path: str | None = None, environment: dict[str, str] | None = None) -> Settings:
        """Unknown names in the file are errors; structured values in the environment are JSON."""
        given: dict[str, Any] = {}
        if path:
            with open(path, encoding="utf-8") as f:
                given = json.load(f)
        kinds = {f.name: f.type for f in fields(Settings)}
        if unknown := sorted(set(given) - set(kinds)):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        environment = dict(os.environ) if environment is None else environment
        for name, kind in kinds.items():
            if (value := environment.get(f"QUILLSPARK_{name.upper()}")) is not None:
                given[name] = value if kind == "str" else json.loads(value)
        return Settings(**given)

    def record(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)
