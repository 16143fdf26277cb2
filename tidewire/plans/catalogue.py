"""All queries of the core, by name, with their SQL where SQL can express them."""

from __future__ import annotations

from . import analytics, articles, cleaning, core_training, matching, places, scans, serving, stages, streams, topics

FLAGSHIP = "country_hotspots"

MODULES = [core_training, serving, articles, cleaning, analytics, matching, places, scans, stages, topics, streams]


def queries() -> dict:
    """Name -> callable(spark, sf_dir)."""
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Name -> DuckDB SQL."""
    return {name: sql for m in MODULES for name, sql in getattr(m, "SQL", {}).items()}
