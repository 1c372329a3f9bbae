"""Registered queries of the verification engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import q_metrics, q_more, q_products, q_regrid, q_runs, q_series, q_vector_runs, q_wider

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (q_metrics, q_series, q_runs, q_more, q_wider, q_vector_runs, q_regrid, q_products)


def queries() -> dict[str, Query]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQLS.items()}
