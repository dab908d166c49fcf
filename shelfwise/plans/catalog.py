"""Imports every query module, so the registry is complete."""

from shelfwise.plans import (  # noqa: F401
    enrichment,
    evaluate,
    ingest,
    launch,
    models,
    panel,
    price,
    transfer,
    windows,
)
from shelfwise.plans.registry import oracle_sql, queries, run

__all__ = ["oracle_sql", "queries", "run"]
