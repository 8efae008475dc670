"""Settings of retrieval, context and judging, with overrides from environment variables."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    dense_top_k: int = 30
    final_top_k: int = 20
    reranker_top_k: int = 20
    rrf_k: int = 60
    dense_weight: float = 1.0
    lexical_weight: float = 1.0
    company_cap: int = 4
    chunk_size: int = 1200
    chunk_overlap: int = 150
    embed_batch: int = 64
    context_tokens: int = 6000
    judge_retries: int = 2
    use_reranker: bool = True


def load(prefix: str = "LOOMWORK_", env: dict[str, str] | None = None) -> Settings:
    """Defaults with whatever PREFIX_NAME sets; blank values don't count, flags are true for 1, true, yes and on."""
    env, base, new = os.environ if env is None else env, Settings(), {}
    for f in fields(base):
        raw = (env.get(prefix + f.name.upper()) or "").strip()
        if raw:
            kind = type(getattr(base, f.name))
            new[f.name] = raw.lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw)
    return replace(base, **new)
