"""Settings of the engine: a frozen record on the driver, passed to operators, never global."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    chunk_chars: int = 1800
    chunk_overlap: int = 250
    top_k: int = 5
    hybrid: bool = True
    alpha: float = 0.7
    per_doc: int = 2
    context_chars: int = 12_000
    page_chars: int = 60_000
    least_page_chars: int = 500
    fallback: bool = True
    fallback_score: float = 0.45
    fallback_results: int = 3
    provider: str = "hash"
    embed_model: str = "hash-64"
    chat_model: str = "extract"
    judge_model: str = ""
    base_url: str = ""
    api_key: str = ""
    temperature: float = 0.0
    embed_batch: int = 16
    timeout_s: int = 120
    corpus_dir: str = "data/corpus"
    store: str = "local"
    server_url: str = "http://localhost:6333"
    collection: str = "chunks"
    server_batch: int = 256
    wikis: str = "marvel=https://marvel.fandom.com,dc=https://dc.fandom.com"
    pages_file: str = ""
    delay_s: float = 0.5
    retries: int = 3
    index_dir: str = "data/index"
    log_level: str = "INFO"
    log_file: str = ""

    @property
    def effective_judge(self) -> str:
        return self.judge_model or self.chat_model

    @property
    def wiki_urls(self) -> dict[str, str]:
        """The base URL of each wiki."""
        return dict(x.strip().split("=", 1) for x in self.wikis.split(",") if "=" in x)

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, prefix: str = "SKERRY_") -> Settings:
        """Settings from environment variables; an empty or unset number keeps its default, true is 1, true, yes or on."""
        env = os.environ if env is None else env
        given = {}
        for item in fields(cls):
            raw = env.get(prefix + item.name.upper())
            if raw is None or (raw.strip() == "" and item.type in ("int", "float")):
                continue
            read = {"int": int, "float": float, "bool": lambda x: x.strip().lower() in ("1", "true", "yes", "on")}.get(item.type, str)
            given[item.name] = read(raw)
        return cls(**given)
