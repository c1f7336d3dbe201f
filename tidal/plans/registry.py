"""Registry of named queries: a Spark plan and, where one exists, its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: add ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name!r}")
        QUERIES[name] = fn
        if sql is not None:
            text = sql.strip()
            if text.upper().startswith("WITH ") and not text.upper().startswith("WITH RECURSIVE"):
                text = "WITH RECURSIVE " + text[5:]
            ORACLE[name] = text
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (sums differ in the last bits with partitioning)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(f.name)
            finite = ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
            cols.append(F.when(finite, F.round(c, digits)).otherwise(c).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def load_all() -> None:
    """Import every query module so its ``register`` calls run."""
    from tidal.plans import (  # noqa: F401
        q_series, q_clean, q_eval, q_forecast, q_risk, q_text, q_retrieve, q_ml, q_sink, q_job,
    )
