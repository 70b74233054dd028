"""Technical indicators over candle series, as chunked scans (see ``ordered``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.operators.joins import join_small
from marketspark.operators.ordered import (
    CHUNK_ROWS,
    DAY_MS,
    chunk_window,
    ema,
    ordered,
    own_rows,
    slot_of_ms,
    with_margin,
)
from marketspark.session import settle

# Spans of the chart's moving averages.
EMA_SPANS = (9, 21, 50, 200)
KEYS = ("symbol",)


def in_order(df: DataFrame, previous: Sequence[str] = (), slot_ms: int = DAY_MS) -> DataFrame:
    """Candles with a dense row index per symbol and, if asked, values of the bar before."""
    return ordered(df, KEYS, ["open_time"], slot_of_ms("open_time", slot_ms), previous)


def close_emas(df: DataFrame, spans: Sequence[int] = EMA_SPANS, slot_ms: int = DAY_MS, size: int | None = None) -> DataFrame:
    """``ema_<span>`` of the close; null until a span is filled."""
    outputs = {f"ema_{s}": ("close", s, True) for s in spans}
    return ema(in_order(df, slot_ms=slot_ms), KEYS, outputs, size=size).drop("row_index")


def true_range_of(prev_close: str = "prev_close") -> Column:
    """Widest of the bar's own range and its reach from the close before; the first bar has only the former."""
    high, low, prev = F.col("high"), F.col("low"), F.col(prev_close)
    return F.greatest(high - low, F.abs(high - prev), F.abs(low - prev))


def true_range(df: DataFrame, slot_ms: int = DAY_MS) -> DataFrame:
    return in_order(df, ["close"], slot_ms).withColumn("true_range", true_range_of()).drop("prev_close")


def atr(df: DataFrame, period: int = 14, slot_ms: int = DAY_MS, size: int | None = None) -> DataFrame:
    """Average true range: EMA of the true range from the first bar on."""
    ranged = true_range(df, slot_ms)
    return ema(ranged, KEYS, {"atr": ("true_range", period, False)}, size=size).drop("row_index")


def carried_schema(spans: Sequence[int] = EMA_SPANS) -> str:
    """What ``carry_on`` needs to know of the bars before: one row per symbol."""
    return ", ".join(["symbol string", "open_time bigint", "close double", "n bigint", "atr double", *[f"ema_{s} double" for s in spans]])


def carry_on(df: DataFrame, state: DataFrame, spans: Sequence[int] = EMA_SPANS, period: int = 14, slot_ms: int = DAY_MS) -> tuple[DataFrame, DataFrame]:
    """(rows, new state): ``ema_<span>`` of the close and ``atr`` of bars that go on where ``state`` ends.

    The state has, per symbol, the last bar's time and close, how many bars there were, and each average as it
    stood. It takes part as a bar of its own before the new ones whose values are those averages: the recurrence
    from there on is the whole one, so any cut of a history into batches gives the averages of one pass. Bars must be
    newer than their symbol's state. Averages are null until their span is filled, counted over all batches.
    """
    names = [f"ema_{s}" for s in spans]
    seeds = settle(state)
    rows = df.withColumns({**{f"_v_{n}": F.col("close") for n in names}, "_carried": F.lit(False)})
    before = seeds.select("symbol", "open_time", "close", *[F.col(n).alias(f"_v_{n}") for n in names], F.col("atr").alias("_atr"), F.lit(True).alias("_carried"))
    both = in_order(rows.unionByName(before, allowMissingColumns=True), ["close"], slot_ms)
    both = both.withColumn("_range", F.when(F.col("_carried"), F.col("_atr")).otherwise(true_range_of()))
    outputs = {n: (f"_v_{n}", s, False) for n, s in zip(names, spans, strict=True)} | {"atr": ("_range", period, False)}
    made = ema(both, KEYS, outputs).filter(~F.col("_carried"))
    made = join_small(made, seeds.select("symbol", F.col("n").alias("_n")), ["symbol"], "left")
    made = settle(made.withColumn("n", F.col("row_index") + F.coalesce(F.col("_n"), F.lit(1))))
    facts = ["open_time", "close", "n", "atr", *names]
    ends = made.groupBy("symbol").agg(*[F.max_by(c, "row_index").alias(c) for c in facts])
    state = seeds.join(ends.select("symbol"), "symbol", "left_anti").unionByName(ends)
    filled = {n: F.when(F.col("n") >= s, F.col(n)) for n, s in zip(names, spans, strict=True)}
    return made.withColumns(filled).select(*df.columns, *names, "atr"), state


def moving_averages(
    df: DataFrame, keys: Sequence[str], columns: dict[str, tuple[str, int]], size: int = CHUNK_ROWS
) -> DataFrame:
    """Simple moving averages over an indexed frame: ``columns`` maps a new name to (value, rows).

    Null until the window is full or while it holds a null.
    """
    widest = max(n for _, n in columns.values())
    out = with_margin(df, max(size, widest), back=widest - 1)
    window = chunk_window(keys)
    for name, (value, n) in columns.items():
        frame = window.rowsBetween(1 - n, 0)
        full = F.count(value).over(frame) == n
        out = out.withColumn(name, F.when(full, F.avg(value).over(frame)))
    return own_rows(out)


def simple_returns(df: DataFrame, slot_ms: int = DAY_MS) -> DataFrame:
    """``close / previous close - 1``; 0 on the first bar."""
    rows = in_order(df, ["close"], slot_ms)
    change = F.try_divide(F.col("close"), F.col("prev_close")) - 1
    return rows.withColumn("ret", F.coalesce(change, F.lit(0.0))).drop("prev_close", "row_index")


def log_returns(df: DataFrame, slot_ms: int = DAY_MS) -> DataFrame:
    rows = in_order(df, ["close"], slot_ms)
    return rows.withColumn("log_return", F.ln("close") - F.ln("prev_close")).drop("prev_close", "row_index")
