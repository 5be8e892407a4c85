"""Settings with their defaults; each can be overridden by ``STRATALOOM_<NAME>``."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    chunk_size: int = 500
    chunk_overlap: int = 100
    top_k: int = 5
    fetch_k: int = 20
    rrf_k: int = 60
    vector_weight: float = 0.7
    lexical_weight: float = 0.3
    clusters: int = 8
    representatives: int = 5
    link_top_k: int = 5
    link_threshold: float = 0.75
    page_threshold: float = 0.70
    reranker: str = "none"
    store: str = "strataloom-store"

    @staticmethod
    def from_env() -> Config:
        given = {}
        for f in fields(Config):
            if (raw := os.environ.get(f"STRATALOOM_{f.name.upper()}")) is not None:
                given[f.name] = type(f.default)(raw)
        return Config(**given)

    def changed(self, other: Config) -> list[str]:
        return [f.name for f in fields(Config) if getattr(self, f.name) != getattr(other, f.name)]
