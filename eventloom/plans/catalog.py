"""All registered queries."""

from __future__ import annotations

from . import group_queries, model_queries, shape_queries, source_queries  # noqa: F401
from .registry import ORACLE, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)
