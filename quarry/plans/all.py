"""Imports every module that registers queries."""

from . import report_queries, stat_queries, text_queries, vector_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
