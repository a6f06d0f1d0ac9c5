"""Query key → Spark builder and oracle SQL.

Each builder takes ``(spark, sf_dir)`` and returns a DataFrame over the
whole driver tables. The oracle is DuckDB SQL over views with the table
names; it is omitted where only a rows-only check is meaningful.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}

_SUITES = (
    "tessera.plans.suite_apps",
    "tessera.plans.suite_sources",
    "tessera.plans.suite_sinks",
    "tessera.plans.suite_rows",
    "tessera.plans.suite_layout",
    "tessera.plans.suite_joins",
    "tessera.plans.suite_agg",
    "tessera.plans.suite_keyed",
    "tessera.plans.suite_order",
    "tessera.plans.suite_sampling",
    "tessera.plans.suite_position",
)


def register(key: str, oracle: str | None = None):
    def deco(fn: Builder) -> Builder:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLE[key] = oracle.strip()
        return fn

    return deco


def load_all() -> None:
    for mod in _SUITES:
        importlib.import_module(mod)


def queries() -> dict[str, Builder]:
    load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load_all()
    return dict(ORACLE)
