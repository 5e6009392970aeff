"""All registered queries: importing this module loads the modules that register them."""

from __future__ import annotations

from lexiflume.registered import ORACLE, QUERIES, query

from lexiflume.plans import embedding_queries, evaluation_queries, function_queries, graph_queries, relation_queries, retrieval_queries, service_queries, source_queries  # noqa: F401

__all__ = ["ORACLE", "QUERIES", "query"]
