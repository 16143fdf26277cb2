"""All queries of this subpackage, by name, with their SQL where SQL can express them."""

from __future__ import annotations

from . import q_body, q_lines, q_lookalike, q_places, q_quality, q_survivor, q_tokens

MODULES = [q_places, q_lookalike, q_survivor, q_body, q_lines, q_tokens, q_quality]


def queries() -> dict:
    """Name -> callable(spark, sf_dir)."""
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Name -> DuckDB SQL."""
    return {name: sql for m in MODULES for name, sql in getattr(m, "SQL", {}).items()}
