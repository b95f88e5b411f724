"""All registered queries."""

from __future__ import annotations

from opsframe.plans import cluster, logs, metrics, scoring, sessions, sources, streaming, traces  # noqa: F401
from opsframe.plans.registry import CATALOG, Build


def builds() -> dict[str, Build]:
    return {name: entry.build for name, entry in CATALOG.items()}


def counterparts() -> dict[str, str]:
    return {name: entry.sql for name, entry in CATALOG.items() if entry.sql}


def coverage() -> dict[str, list[str]]:
    """Operator id -> queries that exercise it."""
    out: dict[str, list[str]] = {}
    for name, entry in CATALOG.items():
        for operator in entry.covers:
            out.setdefault(operator, []).append(name)
    return out
