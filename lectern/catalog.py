"""Registry of the package's own queries and their SQL (the llm subpackage keeps its own)."""

from __future__ import annotations

from lectern.plans import cards, context, keeping, library, pages, records, status, streams, structure, texts, versions

_PLANS = (cards, context, keeping, library, pages, records, status, streams, structure, texts, versions)


def queries() -> dict:
    return {name: f for plan in _PLANS for name, f in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in _PLANS for name, sql in plan.ORACLES.items()}
