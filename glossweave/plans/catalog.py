"""All named queries of the engine and their SQL."""

from __future__ import annotations

from . import assess_queries, facts_queries, grammar_queries, morph_queries, stats_queries, text_queries

_PARTS = [stats_queries, text_queries, assess_queries, facts_queries, grammar_queries, morph_queries]
QUERIES = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
SQL = {k: v for p in _PARTS for k, v in p.SQL.items()}


def describe(spark):
    """(query, family, oracle) of every query: the surface that a client can ask for."""
    rows = [(n, p.__name__.rsplit(".", 1)[-1].removesuffix("_queries"), n in p.SQL) for p in _PARTS for n in p.QUERIES]
    return spark.createDataFrame(rows, "query string, family string, oracle boolean")
