"""Settings from the environment, checked once, with defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    """Field names in upper case with the prefix FACTWEAVE_ are the environment variables."""

    store: str = "factweave-store"
    model: str = "rules"
    embedding_dims: int = 64
    max_requests_per_minute: int = 15
    max_embedded_texts_per_minute: int = 85
    min_fetch_interval_ms: int = 3000
    top_k: int = 12
    min_similarity: float = 0.72

    def __post_init__(self):
        for name in ("embedding_dims", "max_requests_per_minute", "max_embedded_texts_per_minute", "top_k"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")
        if self.min_fetch_interval_ms < 3000:
            raise ValueError("min_fetch_interval_ms must be 3000 at least")


def load(env: dict[str, str] | None = None) -> Config:
    env = dict(os.environ) if env is None else env
    found, wrong = {}, []
    for f in fields(Config):
        raw = env.get(f"FACTWEAVE_{f.name.upper()}")
        if raw is None:
            continue
        try:
            found[f.name] = type(f.default)(raw)
        except ValueError:
            wrong.append(f"FACTWEAVE_{f.name.upper()}: {raw!r} is no {type(f.default).__name__}")
    if wrong:
        raise ValueError("; ".join(wrong))
    return Config(**found)
