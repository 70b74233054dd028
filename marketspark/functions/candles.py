"""Derived candle columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def price_change(close: str = "close", open_: str = "open") -> Column:
    return F.col(close) - F.col(open_)


def percent_of(part: Column, base: Column) -> Column:
    """``part`` as a percentage of ``base`` to 4 decimals; 0 where the base is 0."""
    return F.when(base != 0, F.round(part / base * 100, 4)).otherwise(F.lit(0.0))


def price_change_pct() -> Column:
    return percent_of(F.col("close") - F.col("open"), F.col("open"))


def high_low_spread() -> Column:
    return F.col("high") - F.col("low")


def high_low_spread_pct(denominator: str = "low") -> Column:
    """Spread as a percentage of ``low`` (live feed) or ``open`` (historical report)."""
    if denominator not in ("low", "open"):
        raise ValueError("denominator must be 'low' or 'open'")
    return percent_of(F.col("high") - F.col("low"), F.col(denominator))


def ms_to_timestamp(name: str) -> Column:
    return F.timestamp_millis(F.col(name))


def iso_ms(ts: Column) -> Column:
    """ISO-8601 UTC text with milliseconds; needs a UTC session."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'")


def direction() -> Column:
    return F.when(F.col("close") > F.col("open"), "up").otherwise("down")


def is_valid() -> Column:
    """high >= low and low <= close <= high; a missing price is not valid."""
    ok = (F.col("high") >= F.col("low")) & (F.col("close") <= F.col("high")) & (F.col("close") >= F.col("low"))
    return F.coalesce(ok, F.lit(False))


def normal_symbol(name: str = "symbol") -> Column:
    """``btc/usdt`` and ``BTCUSDT`` are the same instrument."""
    return F.upper(F.replace(F.col(name), F.lit("/"), F.lit("")))


def with_derived(df: DataFrame, denominator: str = "low") -> DataFrame:
    """All derived columns of a streamed candle except the ingest time."""
    return df.withColumns(
        {
            "open_datetime": ms_to_timestamp("open_time"),
            "close_datetime": ms_to_timestamp("close_time"),
            "price_change": price_change(),
            "price_change_pct": price_change_pct(),
            "high_low_spread": high_low_spread(),
            "high_low_spread_pct": high_low_spread_pct(denominator),
        }
    )


def ohlcv_result(df: DataFrame, interval: str = "15m") -> DataFrame:
    """Range-query result rows; optional columns that the table lacks come back null."""
    optional = {
        "quote_volume": "double",
        "num_trades": "bigint",
        "taker_base_volume": "double",
        "taker_quote_volume": "double",
    }
    return df.select(
        "symbol",
        ms_to_timestamp("open_time").alias("open_datetime"),
        ms_to_timestamp("close_time").alias("close_datetime"),
        "open",
        "high",
        "low",
        "close",
        "volume",
        *[(F.col(c) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in optional.items()],
        F.lit(interval).alias("interval"),
    )


def live_result(df: DataFrame) -> DataFrame:
    return df.select("symbol", "close", "close_datetime")
