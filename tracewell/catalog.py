"""Registry of named queries: a callable (spark, data_dir) -> DataFrame and, where SQL can say the same, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tracewell.session import ship

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Catalog:
    queries: dict[str, Query] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")

            @wraps(fn)
            def run(spark: SparkSession, data_dir: str) -> DataFrame:
                ship(spark)
                return fn(spark, data_dir)

            self.queries[name] = run
            if sql is not None:
                self.sql[name] = sql
            return fn

        return register


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{data_dir}/{name}.parquet")
