"""Queries over the driver's tables, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from . import events, graph, metrics, models, neighbors, partition, sources, state, targets, temporal, views
from .base import QUERIES, SQL

_AREAS = (sources, temporal, neighbors, graph, partition, targets, metrics, state, models, views, events)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
