"""Registered queries and the SQL that must give the same rows."""

from __future__ import annotations

import importlib

_QUERIES: dict = {}
_SQL: dict[str, str] = {}
_PLANS = ["scalar_plans", "source_plans", "evidence_plans", "graph_plans", "feature_plans", "compact_plans", "label_plans", "path_plans", "claim_plans", "evaluation_plans", "stream_plans"]


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under a name, with its DuckDB SQL."""

    def put(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def _load() -> None:
    for p in _PLANS:
        importlib.import_module(f"auditloom.plans.{p}")


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark, sf_dir: str):
    _load()
    return _QUERIES["g15_episodes"](spark, sf_dir)
