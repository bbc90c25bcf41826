"""All queries of the core and the SQL that they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeloom.plans import answers, code, search, streams

_MODULES = [search, code, answers, streams]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25_topk(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
