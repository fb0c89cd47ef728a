"""All queries of the core library and the SQL that checks them."""

from __future__ import annotations

from tessera.plans import corpus_queries, graph_queries, question_queries, term_queries, vector_queries

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _module in (corpus_queries, graph_queries, term_queries, vector_queries, question_queries):
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
