"""Query catalogue: name -> Spark job ``(spark, sf_dir) -> DataFrame`` and its DuckDB oracle SQL.

Query modules register themselves with :func:`query`; ``__spark_entry__`` and
``bench.py`` read :data:`QUERIES` / :data:`ORACLES` after :func:`load_all`.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

_MODULES = (
    "kanon.plans.company",
    "kanon.plans.normalise",
    "kanon.plans.quality",
    "kanon.plans.monitoring",
    "kanon.plans.landing",
    "kanon.plans.matching",
    "kanon.plans.aggregates",
    "kanon.plans.billing",
    "kanon.plans.streams",
    "kanon.plans.roundtrips",
)


def query(name: str, oracle: str | None = None):
    """Register a query under ``name`` with an optional oracle SQL string."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


def load_all() -> tuple[dict[str, QueryFn], dict[str, str]]:
    for m in _MODULES:
        importlib.import_module(m)
    return QUERIES, ORACLES
