"""Registry of queries and their independent SQL checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register a (spark, folder) -> DataFrame function; ``sql`` must give the same rows."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Result types that compare across engines: rounded doubles, BIGINT, dates as timestamps."""

    def cast(name, dtype):
        if dtype in ("double", "float"):
            # adding 0.0 turns a rounded -0.0 into 0.0
            return (F.round(F.col(name).cast("double"), digits) + F.lit(0.0)).alias(name)
        if dtype in ("int", "smallint", "tinyint"):
            return F.col(name).cast("bigint").alias(name)
        if dtype == "date":
            return F.col(name).cast("timestamp_ntz").alias(name)
        return F.col(name)

    return df.select(*[cast(n, t) for n, t in df.dtypes])
