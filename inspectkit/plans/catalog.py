"""Registered queries: ``(spark, sf_dir) -> DataFrame`` plus DuckDB twins.

Each query reads the driver's parquet tables in full (through the fact
mapping) and calls the library operators.  Double outputs are rounded on
both sides (6 places; money 4) so that summation order, which differs
between engines in the last bits, does not change the value hash.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inspectkit.plans.oracle import with_fact
from inspectkit.session import prepare
from inspectkit.sources.tables import load_fact


@dataclass(frozen=True)
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    survey_key: str


REGISTRY: dict[str, Query] = {}


def register(name: str, survey_key: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, sql, survey_key)
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6, money: tuple[str, ...] = (), money_digits: int = 4) -> DataFrame:
    """Round every double column (money columns to ``money_digits``)."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, money_digits if f.name in money else digits).alias(f.name)
        out.append(c)
    return df.select(*out)


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return load_fact(spark, sf_dir)


def all_queries() -> dict[str, Query]:
    # importing the query modules fills REGISTRY
    from inspectkit.plans import (  # noqa: F401
        q_analytics,
        q_basic,
        q_ml,
        q_report,
        q_stored,
        q_stream,
        q_timeseries,
    )
    return dict(REGISTRY)


__all__ = ["Query", "REGISTRY", "register", "rounded", "fact", "all_queries", "with_fact"]
