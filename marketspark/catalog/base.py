"""Registry of runnable queries and of the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def edge(df: DataFrame) -> DataFrame:
    """Timestamps without zone at the edge, as the SQL side has them."""
    zoned = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned}) if zoned else df


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL twin where SQL can say it."""

    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: edge(build(spark, sf_dir))
        if sql:
            ORACLE[name] = sql
        return build

    return register


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Round the named columns: sums of doubles differ in the last bits from run to run."""
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})
