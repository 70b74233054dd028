"""Every query the library offers over the given tables."""

from marketspark.catalog import alerts, candles, flows, indicators, patterns, sentiment  # noqa: F401  (importing registers the queries)
from marketspark.catalog.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
