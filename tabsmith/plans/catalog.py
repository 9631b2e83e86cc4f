"""Registered queries: one Spark plan per operator of the survey, plus its DuckDB oracle.

Each entry maps an operator id to ``(spark_fn(spark, sf_dir) -> DataFrame,
oracle_sql or None)``.  Both sides round doubles the same way and alias every
computed column to the same name; counts are bigint on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}

DIGITS = 6


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = (fn, sql)
        return fn

    return deco


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double/float column (the oracle rounds the same way)."""
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`"), digits).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def sql_rounded(inner: str, doubles: list[str], others: list[str], digits: int = DIGITS) -> str:
    cols = [f'round("{c}", {digits}) AS "{c}"' for c in doubles] + [f'"{c}"' for c in others]
    return f"SELECT {', '.join(cols)} FROM ({inner}) _r"
