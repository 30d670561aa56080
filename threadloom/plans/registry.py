"""All core queries and their SQL twins."""

from __future__ import annotations

from threadloom.plans import compositions, core_problems, graphs, readers, reports, retrieval, set_algebra, store_analytics, store_changes, streams, texts, upkeep

MODULES = (core_problems, retrieval, set_algebra, graphs, store_analytics, store_changes, texts, compositions, streams, readers, upkeep, reports)
FLAGSHIP = "content_rank_lead"


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
