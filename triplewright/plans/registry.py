"""Every query of the graph part, and its DuckDB equivalent."""

from __future__ import annotations

from triplewright.plans import corpus_queries, model_queries, raw_queries, training_queries


def queries() -> dict:
    return corpus_queries.QUERIES | model_queries.QUERIES | raw_queries.QUERIES | training_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return corpus_queries.ORACLES | model_queries.ORACLES | raw_queries.ORACLES | training_queries.ORACLES
