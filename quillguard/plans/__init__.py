"""Registered queries: importing this package fills catalog.QUERIES and catalog.ORACLES."""

from . import catalog, files_queries, rule_queries  # noqa: F401
