"""Named queries over the driver's tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.plans import alignment, detectors, evaluation, roundtrips, signals, tables, workflow

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return evaluation.QUERIES | alignment.QUERIES | tables.QUERIES | signals.QUERIES | roundtrips.QUERIES | detectors.QUERIES | workflow.QUERIES


def oracle_sql() -> dict[str, str]:
    return evaluation.SQL | alignment.SQL | tables.SQL | signals.SQL | roundtrips.SQL | detectors.SQL | workflow.SQL
