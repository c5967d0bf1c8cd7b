"""All named queries."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from neraca.plans import registry

_MODULES = [
    "recon_queries", "scalar_queries", "ledger_queries", "statement_queries", "activity_queries", "stream_queries",
    "document_queries",
]


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"neraca.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: registry.runner(plan) for name, plan in registry.PLANS.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return registry.twins()
