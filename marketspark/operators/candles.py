"""Candle queries: building, filtering, ordering, de-duplication, quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.functions import candles as C
from marketspark.functions.parse import parse_time
from marketspark.operators.ordered import DAY_MS, ordered, slot_of_ms, sort_key

PRICES = ["open", "high", "low", "close"]


def build_candles(ticks: DataFrame, keys: Sequence[str], seconds: int) -> DataFrame:
    """Tumbling candles from ticks (``ts``, ``seq``, ``price``, ``volume``); partial aggregation before the shuffle."""
    when = "_when"  # a column of its own, so that it is computed once per tick
    return (
        ticks.withColumn(when, sort_key(ticks, ["ts", "seq"]))
        .groupBy(*keys, F.window("ts", f"{seconds} seconds").alias("_w"))
        .agg(
            F.min_by("price", when).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", when).alias("close"),
            F.sum("volume").alias("volume"),
            F.count(F.lit(1)).alias("num_trades"),
        )
        .select(*keys, F.col("_w.start").alias("ts"), *PRICES, "volume", "num_trades")
    )


def roll_up(bars: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Bars (``symbol``, ``ts``, ``num_trades``) of several widths in seconds from the narrowest, in one pass.

    Each bar is handed to every width, and partial sums shrink them before the one shuffle.
    """
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("interval"), F.lit(s).cast("bigint").alias("s")) for n, s in widths.items()]))
    rows = bars.select("symbol", "ts", "num_trades", each.alias("_w"))
    start = F.timestamp_seconds(F.expr("unix_seconds(ts) div _w.s * _w.s"))
    return rows.groupBy(F.col("_w.interval").alias("interval"), "symbol", start.alias("ts")).agg(F.sum("num_trades").alias("num_trades"))


# ---- filters -------------------------------------------------------------------------------


def for_symbol(df: DataFrame, symbol: str | None) -> DataFrame:
    return df.filter(F.col("symbol") == symbol.upper()) if symbol else df


def in_open_range(df: DataFrame, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Closed range on ``open_time``; prunes ``open_date`` partitions where the table has them."""
    for bound, keep in ((start_ms, "__ge__"), (end_ms, "__le__")):
        if bound is None:
            continue
        df = df.filter(getattr(F.col("open_time"), keep)(F.lit(bound)))
        if "open_date" in df.columns:
            day = F.timestamp_millis(F.lit(bound)).cast("date")
            df = df.filter(getattr(F.col("open_date"), keep)(day))
    return df


def last_minutes(df: DataFrame, now: Column, minutes: int = 60, time: str = "close_datetime") -> DataFrame:
    return df.filter((F.col(time) >= now - F.make_dt_interval(mins=F.lit(minutes))) & (F.col(time) <= now))


def in_seconds_range(df: DataFrame, date_range: Sequence | None, time: str = "open_datetime") -> DataFrame:
    """Closed range given as epoch seconds; anything but a pair of numbers leaves the rows alone."""
    if not date_range or len(date_range) != 2:
        return df
    try:
        low, high = (float(b) for b in date_range)
    except (TypeError, ValueError):
        return df
    if low != low or high != high:
        return df
    return df.filter(F.col(time).between(F.timestamp_seconds(F.lit(low)), F.timestamp_seconds(F.lit(high))))


def whitelist(df: DataFrame, symbols: Sequence[str]) -> DataFrame:
    return df.filter(F.col("symbol").isin(*symbols))


def chart_rows(
    df: DataFrame, symbol: str | None = None, date_range: Sequence | None = None, sort: bool = True
) -> DataFrame:
    """Typed times, then symbol, then range, then time order."""
    times = {}
    for name in ("open_datetime", "close_datetime"):
        if name in df.columns and dict(df.dtypes)[name] == "string":
            times[name] = parse_time(F.col(name))
    out = df.withColumns(times) if times else df
    if symbol:
        out = out.filter(F.col("symbol") == symbol)
    time = "open_datetime" if "open_datetime" in out.columns else "close_datetime"
    out = in_seconds_range(out, date_range, time)
    tie = [c for c in ("symbol", "seq") if c in out.columns]
    return out.orderBy(time, *tie) if sort else out


# ---- order and limit -----------------------------------------------------------------------


def newest(df: DataFrame, limit: int | None = None) -> DataFrame:
    """The newest ``limit`` rows by open time, oldest first; symbol breaks ties."""
    if limit:
        df = df.orderBy(F.desc("open_time"), F.desc("symbol")).limit(limit)
    return df.orderBy("open_time", "symbol")


def scan_for_chart(
    df: DataFrame,
    symbol: str | None = None,
    start_ms: int | None = None,
    end_ms: int | None = None,
    limit: int | None = None,
    interval: str = "15m",
) -> DataFrame:
    """The chart's table scan: filters reach the files, then newest rows, typed."""
    return C.ohlcv_result(newest(in_open_range(for_symbol(df, symbol), start_ms, end_ms), limit), interval)


def last_bars(
    df: DataFrame, keys: Sequence[str], n: int = 60, time: str | Sequence[str] = "open_time", rank: str | None = None
) -> DataFrame:
    """The newest ``n`` bars per key, 1 = newest in ``rank`` if asked.

    Spark keeps at most n rows per key and task before the shuffle.
    """
    times = [time] if isinstance(time, str) else time
    newest_first = Window.partitionBy(*keys).orderBy(*[F.desc(t) for t in times])
    out = df.withColumn("_newest", F.row_number().over(newest_first)).filter(F.col("_newest") <= n)
    return out.withColumnRenamed("_newest", rank) if rank else out.drop("_newest")


def training_rows(df: DataFrame, symbol: str | None = None, limit: int | None = None) -> DataFrame:
    """Bars for model training, oldest first: of one instrument or of all, all bars or the newest ``limit``."""
    time = F.coalesce(*[F.col(c) for c in ("timestamp", "open_time") if c in df.columns])
    chosen = df.filter(C.normal_symbol() == symbol.upper().replace("/", "")) if symbol else df
    chosen = chosen.withColumn("timestamp", F.timestamp_millis(time) if "timestamp" not in df.columns else time).dropna(subset=["timestamp"])
    rows = chosen.select("symbol", "timestamp", "open", "high", "low", "close", "volume")
    if limit is not None:
        rows = rows.orderBy(F.desc("timestamp"), F.desc("symbol")).limit(limit)
    rows = rows.orderBy("timestamp", "symbol")
    return rows.drop("symbol") if symbol else rows


# ---- de-duplication ------------------------------------------------------------------------


def keep_one(df: DataFrame, keys: Sequence[str], arrival: Sequence[str], last: bool = True) -> DataFrame:
    """One row per key: the last (or first) to arrive.

    An aggregate rather than a ranking window, so copies of a hot key shrink to one row
    per task before the shuffle. Where all other columns have a fixed width and the arrival
    is one number, each column is picked by that number, which Spark does by hash; all picks
    of a group choose the same row, as they compare the same numbers in the same order.
    Otherwise whole rows are picked, which sorts.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    kinds = dict(df.dtypes)
    fixed = ("bigint", "int", "smallint", "tinyint", "double", "float", "boolean", "timestamp", "timestamp_ntz", "date")
    if all(kinds[c] in fixed for c in rest) and len(arrival) == 1:
        held = df.withColumn("_when", F.col(arrival[0]))
        return held.groupBy(*keys).agg(*[pick(c, "_when").alias(c) for c in rest]).select(*df.columns)
    return (
        df.groupBy(*keys)
        .agg(pick(F.struct(*rest), F.struct(*arrival)).alias("_row"))
        .select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in df.columns])
    )


# ---- aggregates ----------------------------------------------------------------------------


def date_range(df: DataFrame, now: Column) -> DataFrame:
    """Earliest and latest open time; the week before ``now`` for an empty table."""
    return df.agg(F.min("open_time").alias("a"), F.max("open_time").alias("b")).select(
        F.coalesce(F.timestamp_millis("a"), now - F.make_dt_interval(days=F.lit(7))).alias("min_date"),
        F.coalesce(F.timestamp_millis("b"), now).alias("max_date"),
    )


def mean_volume(df: DataFrame) -> DataFrame:
    return df.agg(F.avg("volume").alias("mean_volume"))


def summary(df: DataFrame, columns: Sequence[str] = (*PRICES, "volume")) -> DataFrame:
    """Count, mean, sample deviation, min and max: one row per column, one pass."""
    stats = {"count": F.count, "mean": F.avg, "stddev": F.stddev_samp, "min": F.min, "max": F.max}
    wide = df.agg(*[fn(c).alias(f"{c}_{s}") for c in columns for s, fn in stats.items()])
    rows = F.array(
        *[F.struct(F.lit(c).alias("column"), *[F.col(f"{c}_{s}").alias(s) for s in stats]) for c in columns]
    )
    return wide.select(F.inline(rows))


def direction_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("symbol").agg(
        F.count_if(F.col("close") > F.col("open")).alias("up_bars"),
        F.count_if(F.col("close") < F.col("open")).alias("down_bars"),
    )


def completeness(df: DataFrame, step_ms: int) -> DataFrame:
    """Expected bars between first and last, actual bars, and the difference."""
    return (
        df.groupBy("symbol")
        .agg(F.min("open_time").alias("a"), F.max("open_time").alias("b"), F.count(F.lit(1)).alias("actual"))
        .select(
            "symbol",
            (F.round((F.col("b") - F.col("a")) / step_ms).cast("bigint") + 1).alias("expected"),
            "actual",
        )
        .withColumn("difference", F.col("expected") - F.col("actual"))
    )


def duplicate_keys(df: DataFrame) -> DataFrame:
    """Number of (symbol, open time) keys stored more than once, per symbol."""
    return (
        df.groupBy("symbol", "open_time")
        .count()
        .groupBy("symbol")
        .agg(F.count_if(F.col("count") > 1).alias("duplicates"))
    )


def symbol_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"),
        F.timestamp_millis(F.min("open_time")).alias("earliest"),
        F.timestamp_millis(F.max("open_time")).alias("latest"),
    )


def quality_report(df: DataFrame) -> DataFrame:
    """All data-quality counts in one pass and one row."""
    needed = ["symbol", *PRICES, "volume"]
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in needed],
        *[F.count_if(F.col(c) < 0).alias(f"negative_{c}") for c in needed[1:]],
        F.count_if(F.col("high") < F.col("low")).alias("high_below_low"),
        F.count_if((F.col("close") < F.col("low")) | (F.col("close") > F.col("high"))).alias("close_outside"),
        F.count_if(F.col("volume") <= 0).alias("volume_not_positive"),
    )


def newest_open_time(df: DataFrame) -> DataFrame:
    return df.groupBy("symbol").agg(F.max("open_time").alias("last_open_time"))


def best_interval(df: DataFrame, intervals: Sequence[str], target: int = 3000) -> DataFrame:
    """Rows of the first listed interval that reaches ``target`` rows, else of the fullest one."""
    place = F.array_position(F.array(*[F.lit(i) for i in intervals]), F.col("interval"))
    counts = df.groupBy("interval").count().withColumn("_place", place).filter(F.col("_place") > 0)
    enough = F.col("count") >= target
    chosen = counts.agg(
        F.coalesce(
            F.min_by(F.when(enough, F.col("interval")), F.when(enough, F.col("_place"))),
            F.max_by("interval", F.struct("count", -F.col("_place"))),
        ).alias("interval")
    )
    return df.join(F.broadcast(chosen), "interval", "left_semi")  # the right side is one row


# ---- bars against their neighbours ---------------------------------------------------------


def gaps(df: DataFrame, step_ms: int) -> DataFrame:
    """Bars that follow their predecessor by more than one step."""
    rows = ordered(df, ["symbol"], ["open_time"], slot_of_ms("open_time", DAY_MS), previous=["open_time"])
    return rows.select(
        "symbol",
        "open_time",
        F.col("prev_open_time").alias("previous_open_time"),
        (F.expr(f"(open_time - prev_open_time) div {step_ms}L") - 1).alias("missing_bars"),
    ).filter(F.col("open_time") - F.col("previous_open_time") > step_ms)


def new_rows(incoming: DataFrame, stored: DataFrame, now_ms: int, lookback_ms: int = 900_000) -> DataFrame:
    """Incoming candles newer than the stored maximum of their symbol.

    A symbol that is not stored yet starts ``lookback_ms`` before now.
    """
    from marketspark.operators.joins import join_small

    known = newest_open_time(stored)
    floor = F.coalesce(F.col("last_open_time"), F.lit(now_ms - lookback_ms))
    fresh = join_small(incoming, known, ["symbol"], "left").filter(F.col("open_time") > floor).drop("last_open_time")
    # The last copy stays: by arrival where it is known, then by the copies' own values, so that repeats agree.
    rest = sorted((c for c in fresh.columns if c not in ("symbol", "open_time")), key=lambda c: (c != "seq", c != "close_time", c))
    return keep_one(fresh, ["symbol", "open_time"], rest) if rest else fresh.distinct()
