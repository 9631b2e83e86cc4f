"""Registry of the queries of this subpackage: name -> (spark function, DuckDB text or None)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, tuple[QueryFn, str | None]] = {}

_MODULES = ["url_filter", "jaccard_join", "toxicity", "substring_dedup", "packing", "pii", "neighbours", "host_quality", "licenses", "bpe", "periodic_runs", "merkle", "pivot_index"]


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = (fn, sql)
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_all() -> dict[str, tuple[QueryFn, str | None]]:
    for m in _MODULES:
        importlib.import_module(f"{__package__}.{m}")
    return QUERIES
