"""All registered queries (one per SURVEY §2 key) and their DuckDB oracles."""

from __future__ import annotations

import importlib

_QUERY_MODULES = [
    "concourse.plans.registry_sources",
    "concourse.plans.registry_pages",
    "concourse.plans.registry_serving",
    "concourse.plans.registry_text",
    "concourse.plans.registry_streaming",
]
_ORACLE_MODULES = [
    "concourse.oracle.sources",
    "concourse.oracle.pages",
    "concourse.oracle.serving",
    "concourse.oracle.text",
    "concourse.oracle.streaming",
]


def _load(names, attr):
    out = {}
    for n in names:
        try:
            mod = importlib.import_module(n)
        except ModuleNotFoundError as e:
            if e.name == n:
                continue
            raise
        out.update(getattr(mod, attr))
    return out


def all_queries():
    """name -> callable(spark, sf_dir)."""
    return _load(_QUERY_MODULES, "QUERIES")


def all_oracle_sql():
    return _load(_ORACLE_MODULES, "ORACLE")
