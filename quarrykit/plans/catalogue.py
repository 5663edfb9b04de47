"""Named queries of the library and the SQL they are held against."""

from __future__ import annotations

from quarrykit.plans import evaluation_queries, graph_queries, retrieval_queries, table_queries

_MODULES = (retrieval_queries, graph_queries, evaluation_queries, table_queries)


def _queries(module) -> dict:
    return {n: f for n, f in vars(module).items() if callable(f) and not n.startswith("_") and getattr(f, "__module__", "") == module.__name__}


QUERIES: dict = {n: f for m in _MODULES for n, f in _queries(m).items()}
SQL: dict = {n: s for m in _MODULES for n, s in m.SQL.items()}
