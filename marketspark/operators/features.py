"""The 18 statistical and technical features of a price window."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.operators.candles import last_bars
from marketspark.operators.ordered import DAY_MS, chunk_window, ordered, own_rows, slot_of_ms, with_margin

# Order of the feature vector.
FEATURES = [
    "mean_close",
    "std_close",
    "skew_close",
    "kurtosis_close",
    "mean_return",
    "std_return",
    "skew_return",
    "kurtosis_return",
    "high_low_ratio",
    "close_open_ratio",
    "volatility",
    "mean_volume",
    "volume_volatility",
    "momentum",
    "max_drawdown",
    "linear_trend",
    "rsi",
    "macd",
]
# Least rows for features, for RSI, and the two MACD spans; the year for volatility; the window.
MIN_ROWS, RSI_ROWS, MACD_FAST, MACD_SLOW = 10, 15, 12, 26
TRADING_DAYS = 252
WINDOW = 30
# Chunks stay short enough for the inverse powers that a sliding EMA needs.
FEATURE_CHUNK = 512


def _vector(price: dict[str, Column], n: Column, macd: Column, rsi: Column) -> dict[str, Column]:
    """Feature columns from the aggregates a caller computed over its window or group."""
    first, last = price["first"], price["last"]
    ratio = F.when(first > 0, last / first).otherwise(F.lit(1.0))
    return {
        **{name: price[name] for name in FEATURES[:8]},
        "high_low_ratio": F.when(price["min_low"] > 0, price["max_high"] / price["min_low"]).otherwise(F.lit(1.0)),
        "close_open_ratio": ratio,
        "volatility": price["std_return"] * math.sqrt(TRADING_DAYS),
        "mean_volume": price["mean_volume"],
        "volume_volatility": price["volume_volatility"],
        "momentum": F.when(first > 0, last / first - 1).otherwise(F.lit(0.0)),
        "max_drawdown": F.when(price["max_close"] > 0, (price["max_close"] - price["min_close"]) / price["max_close"]).otherwise(F.lit(0.0)),
        "linear_trend": price["linear_trend"],
        "rsi": F.when(n < RSI_ROWS, F.lit(50.0)).otherwise(rsi),
        "macd": F.when(n < MACD_SLOW, F.lit(0.0)).otherwise(macd),
    }


def _strength(gain: Column, loss: Column) -> Column:
    """Relative strength from the mean gain and mean loss; no gains count as 0, no losses as 1."""
    return 100 - 100 / (1 + F.coalesce(gain, F.lit(0.0)) / F.coalesce(loss, F.lit(1.0)))


def rolling_features(
    df: DataFrame,
    window: int = WINDOW,
    keys: Sequence[str] = ("symbol",),
    slot_ms: int = DAY_MS,
    size: int = FEATURE_CHUNK,
) -> DataFrame:
    """Features of the ``window`` bars before each bar, for every bar that has so many before it."""
    if window < MIN_ROWS:
        raise ValueError(f"a window needs at least {MIN_ROWS} rows")
    bars = ordered(df, keys, ["open_time"], slot_of_ms("open_time", slot_ms), previous=["close"])
    bars = bars.select(*keys, "open_time", "row_index", "high", "low", "close", "volume", "prev_close")
    bars = bars.withColumns(
        {"_ret": F.ln("close") - F.ln("prev_close"), "_delta": F.col("close") - F.col("prev_close")}
    )
    bars = with_margin(bars, size, back=window).withColumn("_place", F.col("row_index") - F.col("_chunk") * size)
    ordering = chunk_window(keys)
    frame = ordering.rowsBetween(-window, -1)
    inner = ordering.rowsBetween(1 - window, -1)  # changes inside the window: one fewer than its rows

    def ema_at_end(span: int) -> Column:
        # sum of alpha*r^age*close over the frame, plus the seed's extra weight on the first close
        alpha, r = 2 / (span + 1), 1 - 2 / (span + 1)
        scaled = F.sum(F.col("close") * F.pow(F.lit(r), -F.col("_place"))).over(frame)
        first = F.first("close").over(frame)
        return alpha * F.pow(F.lit(r), F.col("_place") - 1) * scaled + first * (r**window)

    gain = F.avg(F.when(F.col("_delta") > 0, F.col("_delta"))).over(inner)
    loss = F.avg(F.when(F.col("_delta") < 0, -F.col("_delta"))).over(inner)
    price = {
        "mean_close": F.avg("close").over(frame),
        "std_close": F.stddev_pop("close").over(frame),
        "skew_close": F.skewness("close").over(frame),
        "kurtosis_close": F.kurtosis("close").over(frame),
        "mean_return": F.avg("_ret").over(inner),
        "std_return": F.stddev_pop("_ret").over(inner),
        "skew_return": F.skewness("_ret").over(inner),
        "kurtosis_return": F.kurtosis("_ret").over(inner),
        "min_low": F.min("low").over(frame),
        "max_high": F.max("high").over(frame),
        "min_close": F.min("close").over(frame),
        "max_close": F.max("close").over(frame),
        "first": F.first("close").over(frame),
        "last": F.last("close").over(frame),
        "mean_volume": F.avg("volume").over(frame),
        "volume_volatility": F.stddev_pop("volume").over(frame),
        "linear_trend": F.regr_slope("close", F.col("_place").cast("double")).over(frame),
    }
    columns = _vector(price, F.lit(window), ema_at_end(MACD_FAST) - ema_at_end(MACD_SLOW), _strength(gain, loss))
    out = bars.withColumns({**columns, "_n": F.count(F.lit(1)).over(frame)})
    return own_rows(out).filter(F.col("_n") == window).select(*keys, "open_time", *FEATURES)


def newest_features(
    df: DataFrame, keys: Sequence[str] = ("exchange", "symbol"), bars: int = 60, time: str = "open_time"
) -> DataFrame:
    """Features of the newest ``bars`` bars per key; keys with fewer than 10 bars get null features.

    Spark prunes to ``bars`` rows per key and task before the shuffle, so groups are tiny.
    """
    rows = last_bars(df, keys, bars, time)
    series = Window.partitionBy(*keys).orderBy(time)  # at most ``bars`` rows per key by now
    rows = rows.withColumns(
        {
            "_i": (F.row_number().over(series) - 1).cast("double"),
            "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys)),
            "_prev": F.lag("close").over(series),
        }
    ).withColumns({"_ret": F.ln("close") - F.ln("_prev"), "_delta": F.col("close") - F.col("_prev")})

    def ema_at_end(span: int) -> Column:
        alpha, r = 2 / (span + 1), 1 - 2 / (span + 1)
        age = F.col("_n") - 1 - F.col("_i")
        weight = F.when(F.col("_i") == 0, F.lit(1.0)).otherwise(F.lit(alpha)) * F.pow(F.lit(r), age)
        return F.sum(F.col("close") * weight)

    gain = F.avg(F.when(F.col("_delta") > 0, F.col("_delta")))
    loss = F.avg(F.when(F.col("_delta") < 0, -F.col("_delta")))
    price = {
        "mean_close": F.avg("close"),
        "std_close": F.stddev_pop("close"),
        "skew_close": F.skewness("close"),
        "kurtosis_close": F.kurtosis("close"),
        "mean_return": F.avg("_ret"),
        "std_return": F.stddev_pop("_ret"),
        "skew_return": F.skewness("_ret"),
        "kurtosis_return": F.kurtosis("_ret"),
        "min_low": F.min("low"),
        "max_high": F.max("high"),
        "min_close": F.min("close"),
        "max_close": F.max("close"),
        "first": F.min_by("close", "_i"),
        "last": F.max_by("close", "_i"),
        "mean_volume": F.avg("volume"),
        "volume_volatility": F.stddev_pop("volume"),
        "linear_trend": F.regr_slope("close", "_i"),
    }
    n = F.max("_n")
    columns = _vector(price, n, ema_at_end(MACD_FAST) - ema_at_end(MACD_SLOW), _strength(gain, loss))
    enough = n >= MIN_ROWS
    return rows.groupBy(*keys).agg(
        n.alias("bars"), *[F.when(enough, c).alias(name) for name, c in columns.items()]
    )
