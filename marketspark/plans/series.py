"""The data behind each chart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.functions import candles as C
from marketspark.functions.parse import decode_live, display_time, explode_live, parse_time
from marketspark.operators.candles import chart_rows, keep_one
from marketspark.operators.indicators import EMA_SPANS, atr, close_emas


def line_series(df: DataFrame, symbol: str | None = None, date_range: Sequence | None = None) -> DataFrame:
    """Close with its four EMAs, in time order."""
    rows = close_emas(chart_rows(df, symbol, date_range, sort=False))
    return rows.select("symbol", "close_datetime", "close", *[f"ema_{s}" for s in EMA_SPANS]).orderBy(
        "close_datetime", "symbol"
    )


def candlestick_series(df: DataFrame, symbol: str | None = None, date_range: Sequence | None = None) -> DataFrame:
    rows = chart_rows(df, symbol, date_range, sort=False)
    return rows.select("symbol", "close_datetime", "open", "high", "low", "close").orderBy("close_datetime", "symbol")


def volume_series(df: DataFrame, symbol: str | None = None, date_range: Sequence | None = None) -> DataFrame:
    """Volume split by candle direction, with the mean of the whole selection on every row."""
    rows = chart_rows(df, symbol, date_range, sort=False)
    mean = rows.agg(F.avg("volume")).scalar()
    up = C.direction() == "up"
    return (
        rows.select(
            "symbol",
            "close_datetime",
            F.when(up, F.col("volume")).alias("volume_up"),
            F.when(~up, F.col("volume")).alias("volume_down"),
            mean.alias("mean_volume"),
        )
        .orderBy("close_datetime", "symbol")
    )


def volatility_series(df: DataFrame, symbols: Sequence[str] | None = None, period: int = 14) -> DataFrame:
    """ATR of several symbols in one pass; symbols without rows simply do not show up."""
    rows = df.filter(F.col("symbol").isin(*symbols)) if symbols else df
    return atr(rows, period).select("symbol", "close_datetime", "atr").orderBy("close_datetime", "symbol")


def unusable_live(messages: DataFrame) -> DataFrame:
    """(seq, pos, status) of everything that ``live_series`` cannot show: whole payloads (no pos) and single rows."""
    decoded = decode_live(messages)
    whole = decoded.filter(F.col("records").isNull()).select("seq", F.lit(None).cast("int").alias("pos"), "status")
    rows = explode_live(decoded)
    bad_time = parse_time(F.col("close_datetime")).isNull()
    status = F.when(bad_time, "row without a readable close time").when(F.coalesce(F.length("symbol"), F.lit(0)) == 0, "row without a symbol")
    return whole.unionByName(rows.select("seq", "pos", status.alias("status")).filter("status IS NOT NULL"))


def live_series(messages: DataFrame, zone: str = "Europe/Berlin") -> DataFrame:
    """Live line: decode payloads, drop unreadable times, let the last row of a close time win.

    ``messages`` has ``seq`` (arrival order) and ``data`` (payload text).
    """
    rows = explode_live(decode_live(messages))
    rows = rows.withColumn("close_datetime", parse_time(F.col("close_datetime")))
    rows = rows.dropna(subset=["close_datetime"]).filter(F.length("symbol") > 0)
    rows = keep_one(rows, ["symbol", "close_datetime"], ["seq", "pos"])
    rows = rows.withColumn("close_datetime", display_time(F.col("close_datetime"), zone))
    return C.live_result(rows).orderBy("close_datetime", "symbol")
