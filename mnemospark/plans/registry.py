"""Queries by name, each with the SQL that should give the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *views: str, name: str | None = None):
    """Register a function of (spark, sf_dir) under its name; ``sql`` runs on the fixture ``views`` and the tables."""

    def add(f):
        key = name or f.__name__
        assert key not in QUERIES, key
        QUERIES[key] = f
        if sql:
            ORACLES[key] = with_views(sql, *views) if views else sql
        return f

    return add
