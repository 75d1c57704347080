"""Queries over the test tables: fixtures, the queries, and the SQL that checks them."""

from . import search_queries, store_queries, text_queries, write_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
