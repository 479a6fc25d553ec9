"""Registry of runnable queries, each with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from loomgraph.fixtures import Tables, oracle_ctes


@dataclass
class Plan:
    name: str
    covers: str
    run: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.run(Tables(spark, folder))


PLANS: dict[str, Plan] = {}


def query(name: str, covers: str, tables: str = "", sql: str | None = None):
    """Register ``fn(tables)``; ``sql`` sees the named derived tables as CTEs."""
    def add(fn):
        full = sql
        if sql is not None and tables:
            full = f"WITH {oracle_ctes(tables.split())}\nSELECT * FROM (\n{sql}\n) q"
        PLANS[name] = Plan(name, covers, fn, full)
        return fn

    return add
