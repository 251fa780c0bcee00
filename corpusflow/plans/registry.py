"""All registered queries and SQL twins."""

from __future__ import annotations

from functools import wraps

from corpusflow.plans import q_corpus, q_more, q_recommend, q_retrieval, q_store, q_streams, q_tables, q_text, q_turns
from corpusflow.session import ship_package

FLAGSHIP = "vs3_search_all_exact"
_MODULES = (q_retrieval, q_tables, q_text, q_corpus, q_turns, q_recommend, q_streams, q_store, q_more)


def _shipped(query):
    @wraps(query)
    def run(spark, sf):
        ship_package(spark)
        return query(spark, sf)

    return run


QUERIES = {name: _shipped(query) for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
