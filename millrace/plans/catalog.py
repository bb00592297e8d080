"""Registry of queries: each has a builder over (spark, sf_dir) and, where SQL can say it, an oracle written from the definition."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.views import oracle, tables

QUERIES: dict[str, Query] = {}


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


def query(*names: str, sql: str | None = None):
    """Registers a function of {table: DataFrame} under its name."""

    def put(f):
        QUERIES[f.__name__] = Query(lambda spark, sf_dir: f(tables(spark, sf_dir, *names)), oracle(sql, *names) if sql else None)
        return f

    return put


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})
