"""Imports every query module so that the registry is complete."""

from convhist.plans import assembly_queries, beats_queries, catalog_queries, corpus_queries, evidence_queries, graph_queries, incremental_queries, source_queries, tools_queries, transfer_queries  # noqa: F401
from convhist.plans.registry import CHECK_SQL, QUERIES  # noqa: F401
