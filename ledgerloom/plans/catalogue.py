"""Registered queries of the core library and their oracle SQL."""

from __future__ import annotations

from . import q_ledger, q_pipeline, q_text, q_usage  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
