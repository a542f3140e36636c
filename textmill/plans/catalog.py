"""Registered queries and their SQL."""

from textmill.plans import corpus_queries, search_queries

_PARTS = [search_queries.R, corpus_queries.R]
QUERIES = {name: f for part in _PARTS for name, f in part.queries.items()}
ORACLE = {name: text for part in _PARTS for name, text in part.sql.items()}


def flagship(spark, sf_dir):
    return QUERIES["sort_relevance"](spark, sf_dir)
