"""Registry of named queries: a Spark plan and, where SQL can say it, a DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from neraca.plans.oracle import with_views
from neraca.sources.views import Views

Plan = Callable[[Views], DataFrame]

PLANS: dict[str, Plan] = {}
ORACLES: dict[str, tuple[str, dict[str, str] | None]] = {}


def query(name: str, sql: str | None = None, extra: dict[str, str] | None = None):
    """Register a plan over the domain views under ``name``."""

    def register(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query {name} registered twice")
        PLANS[name] = plan
        if sql is not None:
            ORACLES[name] = (sql, extra)
        return plan

    return register


def twins() -> dict[str, str]:
    """Every twin with the views it names, which any module may have added."""
    return {name: with_views(sql, extra) for name, (sql, extra) in ORACLES.items()}


def plain(df: DataFrame) -> DataFrame:
    """Report types: integers as bigint, money and shares as double."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double").alias(field.name)
        elif isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            column = column.cast("long").alias(field.name)
        columns.append(column)
    return df.select(*columns)


def runner(plan: Plan) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return plain(plan(Views(spark, folder)))

    return run
