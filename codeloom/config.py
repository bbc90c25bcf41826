"""Settings of ingestion and retrieval, from arguments or the environment, validated."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields

from codeloom.operators.manifest import EXTENSIONS


@dataclass(frozen=True)
class Settings:
    max_repo_bytes: int = 500 * 1024 * 1024
    clone_depth: int = 1
    chunk_max_tokens: int = 512
    vector_top_k: int = 20
    bm25_top_k: int = 20
    rerank_top_k: int = 10
    rrf_k: int = 60
    rate_limit_per_minute: int = 60
    enable_graph: bool = True
    enable_reranker: bool = True
    enable_planner: bool = True
    environment: str = "development"
    secret_key: str = field(default="change-me", repr=False)
    languages: tuple[str, ...] = ("python", "javascript", "typescript")
    extensions: dict[str, str] = field(default_factory=lambda: dict(EXTENSIONS))

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if isinstance(value, int) and not isinstance(value, bool) and value <= 0:
                raise ValueError(f"{f.name} must be positive, not {value}")
        unknown = set(self.languages) - set(self.extensions.values())
        if not self.languages or unknown:
            raise ValueError(f"unknown languages: {sorted(unknown)}" if unknown else "no language is given")

        if self.environment == "production" and (len(self.secret_key) < 32 or self.secret_key in ("change-me", "secret") or len(set(self.secret_key)) < 8):
            raise ValueError("secret_key must be set to at least 32 varied characters in production")

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, prefix: str = "CODELOOM_") -> Settings:
        env = os.environ if env is None else env
        given: dict[str, object] = {}
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper())
            if raw is None or f.name == "extensions":
                continue
            if f.name == "languages":
                given[f.name] = tuple(x.strip().lower() for x in raw.split(",") if x.strip())
            elif isinstance(f.default, str) or f.name == "secret_key":
                given[f.name] = raw
            elif isinstance(f.default, bool):
                if raw.lower() not in ("1", "0", "true", "false", "yes", "no"):
                    raise ValueError(f"{f.name}: not a yes or no: {raw}")
                given[f.name] = raw.lower() in ("1", "true", "yes")
            else:
                given[f.name] = int(raw)
        return cls(**given)
