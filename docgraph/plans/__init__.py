"""Registered queries over the engine's operators."""

from __future__ import annotations

from . import graphs, ingest, markdown, notes, ranking, search, serving, specs, stores, texts  # noqa: F401
from .registry import QUERIES, SQL
from .search import flagship  # noqa: F401


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
