"""Registered queries with their SQL."""

from . import registry, symptom_queries, retrieval_queries  # noqa: F401, I001  each adds to the first's tables
