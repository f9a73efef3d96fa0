"""All registered queries. The llm subpackage joins only if it is there."""

from __future__ import annotations

import importlib
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrata.plans import fact_queries, problem_queries, relation_queries, scalar_queries, whole_flow_queries

Query = Callable[[SparkSession, str], DataFrame]
_CORE = (problem_queries, scalar_queries, relation_queries, fact_queries, whole_flow_queries)


def _modules() -> list:
    try:
        return [*_CORE, importlib.import_module("lodestrata.llm.queries")]
    except ImportError as missing:
        if not (missing.name or "").startswith("lodestrata.llm"):
            warnings.warn(f"queries on training text are left out: {missing}", stacklevel=2)
        return [*_CORE]


def queries() -> dict[str, Query]:
    return {name: q for m in _modules() for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.ORACLE.items()}
