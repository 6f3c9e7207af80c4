"""Queries over the given tables, one for each operator."""

from . import catalog_queries, document_queries, import_queries, ledger_queries, stream_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
