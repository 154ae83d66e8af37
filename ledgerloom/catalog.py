"""All registered queries of the core library and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.plans import base, rows, summaries, timelines

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (rows, summaries, timelines)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.QUERIES[timelines.FLAGSHIP](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v.replace("as string", "as varchar") for k, v in base.SQL.items()}
