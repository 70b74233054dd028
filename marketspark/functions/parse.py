"""Tolerant parsing of loosely typed input, and decoding of wire messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.schemas import KLINE_MSG_DDL

# Status text of a live payload per kind of failure.
STATUS = {
    "missing": "WebSocket payload missing data field",
    "unreadable": "Invalid WebSocket payload",
    "no_object": "Unexpected WebSocket payload format",
    "error": "WebSocket error: ",
    "no_list": "Invalid WebSocket data format",
    "empty": "No realtime data received",
    "good": "WebSocket connected",
}

ROW_DDL = (
    "symbol string, close_datetime string, close double, volume double, open double, high double, low double"
)


def parse_time(text: Column) -> Column:
    """Timestamp, or null where the text is no time."""
    return F.try_to_timestamp(text)


def parse_number(text: Column) -> Column:
    return text.try_cast("double")


def display_time(ts: Column, zone: str = "Europe/Berlin") -> Column:
    """Wall-clock time in the display zone."""
    return F.from_utc_timestamp(ts, zone)


def coerce(df: DataFrame, times: list[str], numbers: list[str], drop_bad_times: bool = False) -> DataFrame:
    """Parse text columns in place; bad values become null, or their rows go where asked."""
    out = df.withColumns({**{c: parse_time(F.col(c)) for c in times}, **{c: parse_number(F.col(c)) for c in numbers}})
    return out.dropna(subset=times) if drop_bad_times else out


def decode_candle(df: DataFrame, value: str = "value") -> DataFrame:
    """Parse message text to ``msg``; rows that are no message get a null ``msg``."""
    return df.withColumn("msg", F.from_json(F.col(value).cast("string"), KLINE_MSG_DDL))


def flatten_candle(df: DataFrame) -> DataFrame:
    """Nested candle message ``msg`` to CANDLE columns plus ``is_closed`` (and ``arrival``, where it is); bad numbers become null."""

    def inner(key: str, kind: str) -> Column:
        return F.col("msg.k").getItem(key).try_cast(kind)

    return df.select(
        F.col("msg.s").alias("symbol"),
        inner("t", "bigint").alias("open_time"),
        inner("o", "double").alias("open"),
        inner("h", "double").alias("high"),
        inner("l", "double").alias("low"),
        inner("c", "double").alias("close"),
        inner("v", "double").alias("volume"),
        inner("T", "bigint").alias("close_time"),
        inner("q", "double").alias("quote_volume"),
        inner("n", "bigint").alias("num_trades"),
        inner("V", "double").alias("taker_base_volume"),
        inner("Q", "double").alias("taker_quote_volume"),
        inner("x", "boolean").alias("is_closed"),
        *[c for c in ("arrival",) if c in df.columns],
    )


def closed_only(df: DataFrame) -> DataFrame:
    """Keep messages of finished candles."""
    return df.filter((F.col("msg.e") == "kline") & F.col("msg.k").getItem("x").try_cast("boolean"))


def decode_live(df: DataFrame, data: str = "data") -> DataFrame:
    """Live payload text to ``records`` (array of rows) and a ``status`` text per message."""
    text = F.col(data)
    body = F.get_json_object(text, "$.data")
    readable = F.try_parse_json(text)
    kind = F.schema_of_variant(readable)
    parsed = df.withColumn("records", F.from_json(body, f"array<struct<{_struct(ROW_DDL)}>>"))
    error = F.get_json_object(text, "$.error")
    status = (
        F.when(text.isNull(), STATUS["missing"])
        .when(readable.isNull(), STATUS["unreadable"])
        .when(~kind.startswith("OBJECT"), STATUS["no_object"])
        .when(error.isNotNull(), F.concat(F.lit(STATUS["error"]), error))
        .when(body.isNull() | ~F.trim(body).startswith("["), STATUS["no_list"])
        .when(F.size("records") == 0, STATUS["empty"])
        .otherwise(STATUS["good"])
    )
    good = F.col("status") == STATUS["good"]
    return parsed.withColumn("status", status).withColumn("records", F.when(good, F.col("records")))


def _struct(ddl: str) -> str:
    return ", ".join(part.strip().replace(" ", ": ", 1) for part in ddl.split(","))


def explode_live(decoded: DataFrame) -> DataFrame:
    """Rows of the good payloads, each with its position so that later arrivals can win."""
    return decoded.select("seq", F.posexplode("records").alias("pos", "row")).select(
        "seq",
        "pos",
        *[F.col(f"row.{part.strip().split(' ')[0]}") for part in ROW_DDL.split(",")],
    )
