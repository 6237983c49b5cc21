"""Settings of the engine; defaults are the fixed values that results have to agree with."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    max_upload_mb: int = 25
    min_upload_bytes: int = 1024
    max_pages: int = 50
    max_payload_chars: int = 25_000
    chunk_chars: int = 15_000
    max_chunks: int = 10
    overlap_lines: int = 5
    balance_tolerance: float = 1.0
    tokens_per_minute: int = 30_000
    tokens_per_month: int = 14_400_000
    call_tokens: int = 3_000
    retention_days: int = 31
    fuzzy_ratio: float = 0.9

    @classmethod
    def from_env(cls, prefix: str = "LEDGERLOOM_") -> Settings:
        """Settings with those overridden that the environment names, as PREFIX + upper-case field."""
        given = {f.name: os.environ[prefix + f.name.upper()] for f in fields(cls) if prefix + f.name.upper() in os.environ}
        kinds = {"int": int, "float": float}
        return cls(**{k: kinds[str(cls.__annotations__[k])](v) for k, v in given.items()})


def api_keys(many: str | None, single: str | None) -> list[str]:
    """The comma-separated keys, trimmed, without empty ones; else the single key."""
    keys = [k.strip() for k in (many or "").split(",") if k.strip()]
    return keys or ([single.strip()] if single and single.strip() else [])


DEFAULTS = Settings()
