"""Every registered query and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temporal window fusion over all rankings."""
    return QUERIES["r03_window_fusion"](spark, sf_dir)


from . import catalog_evidence, catalog_more, catalog_ranking, catalog_reports, catalog_service  # noqa: E402,F401
