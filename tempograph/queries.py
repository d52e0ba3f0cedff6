"""Registry of the queries and their SQL: each module of plans adds its own."""

from __future__ import annotations

from .plans import conversations, enrichment, history, retrieval, texts
from .plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "conversations", "enrichment", "history", "retrieval", "texts"]
