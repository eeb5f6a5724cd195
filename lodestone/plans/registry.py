"""All queries of the core library with their SQL twins."""

from __future__ import annotations

from lodestone.plans import details, lifecycle, measures, retrieval, texts

_MODULES = (retrieval, texts, measures, lifecycle, details)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
flagship = retrieval.q_hybrid
