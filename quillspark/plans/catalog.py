"""Collects the query modules of this package."""

from __future__ import annotations

from quillspark.plans import page_queries, pipeline_state, search_queries, text_queries  # noqa: F401
from quillspark.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def sql() -> dict[str, str]:
    return dict(SQL)
