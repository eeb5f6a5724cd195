"""The queries of this package, with production parameters, and their SQL twins."""

from __future__ import annotations

from lodestone.llm.queries import op1, op2, op3, op4, op5, op6, op7, op8, op9, op10, pipeline

_MODULES = (op1, op2, op3, op4, op5, op6, op7, op8, op9, op10, pipeline)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
