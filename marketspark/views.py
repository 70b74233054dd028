"""Market tables derived from the generic ``events`` and ``embeddings`` tables, in Spark and in SQL.

``events`` is read as a tape of quotes: event type = symbol, user = exchange, value = price.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.operators.candles import build_candles
from marketspark.session import new_path, ship_code

HOUR_MS = 3_600_000
EXCHANGES = ["binance", "kraken", "bitmex", "bybit"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exchange_of(user: str = "user_id"):
    return F.element_at(F.array(*[F.lit(e) for e in EXCHANGES]), (F.col(user) % 4 + 1).cast("int"))


def quotes_of(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_type").alias("symbol"),
        exchange_of().alias("exchange"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("volume"),
    )


def quotes(spark: SparkSession, sf_dir: str, low_ms: int | None = None, high_ms: int | None = None) -> DataFrame:
    """The tape; bounds in epoch milliseconds (low in, high out) are on the stored column, so they reach the files."""
    events = table(spark, sf_dir, "events")
    for bound, keep in ((low_ms, "__ge__"), (high_ms, "__lt__")):
        if bound is not None:
            at = datetime.fromtimestamp(bound / 1000, timezone.utc).replace(tzinfo=None)
            events = events.filter(getattr(F.col("ts"), keep)(F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")))
    return quotes_of(events)


def candles(spark: SparkSession, sf_dir: str, low_ms: int | None = None, high_ms: int | None = None) -> DataFrame:
    """Hourly candles in the CANDLE schema; those that open from ``low_ms`` to ``high_ms`` need only those hours' quotes."""
    low = None if low_ms is None else low_ms // HOUR_MS * HOUR_MS
    high = None if high_ms is None else high_ms // HOUR_MS * HOUR_MS + HOUR_MS
    return as_candle_rows(build_candles(quotes(spark, sf_dir, low, high), ["symbol"], 3600))


def stored_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly candles as a table of their own, for queries that read them more than once.

    Otherwise every pass would read and aggregate the whole tape again.
    """
    path = new_path(spark, "candles")
    bars = candles(spark, sf_dir)
    bars.write.parquet(path)
    return spark.read.schema(bars.schema).parquet(path)


def as_candle_rows(bars: DataFrame, step_ms: int = HOUR_MS) -> DataFrame:
    return bars.select(
        "symbol",
        F.unix_millis("ts").alias("open_time"),
        "open",
        "high",
        "low",
        "close",
        "volume",
        (F.unix_millis("ts") + step_ms - 1).alias("close_time"),
        (F.col("volume") * F.col("close")).alias("quote_volume"),
        "num_trades",
        (F.col("volume") / 2).alias("taker_base_volume"),
        (F.col("volume") * F.col("close") / 2).alias("taker_quote_volume"),
    )


def sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("S"), (F.col("user_id") % 5).cast("string")).alias("symbol"),
        F.when(F.col("event_type").isin("purchase", "signup"), "bullish")
        .when(F.col("event_type") == "error", "bearish")
        .otherwise("neutral")
        .alias("sentiment_label"),
        F.least(F.col("value") / 500, F.lit(1.0)).alias("confidence"),
        F.concat_ws(" ", "event_type", F.format_string("%.2f", "value")).alias("text"),
        F.when(F.col("user_id") % 2 == 0, "mistral").otherwise("huggingface").alias("provider"),
        F.col("value").alias("price"),
        exchange_of().alias("exchange"),
        F.col("event_id").alias("seq"),
    )


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rules for every (symbol, exchange) that trades: above 100 and below 5."""
    return (
        quotes(spark, sf_dir)
        .select("symbol", "exchange")
        .distinct()
        .withColumn(
            "rule",
            F.explode(
                F.array(
                    F.struct(F.lit(100.0).alias("threshold"), F.lit("above").alias("condition")),
                    F.struct(F.lit(5.0).alias("threshold"), F.lit("below").alias("condition")),
                )
            ),
        )
        .select(
            "symbol",
            "exchange",
            "rule.threshold",
            "rule.condition",
            F.when(F.col("exchange") == "bitmex", F.array(F.lit("binance"), F.lit("kraken"))).alias("fallback_exchanges"),
        )
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v")
    )


_EXCHANGE_SQL = "['binance','kraken','bitmex','bybit'][user_id % 4 + 1]"
_SQL = {
    "quotes": f"""quotes AS (
  SELECT event_type AS symbol, {_EXCHANGE_SQL} AS exchange, ts, event_id AS seq, value AS price,
         CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) AS volume
  FROM events)""",
    "candles": """candles AS (
  SELECT symbol, open_time, open, high, low, close, volume, open_time + 3599999 AS close_time,
         volume * close AS quote_volume, num_trades, volume / 2 AS taker_base_volume,
         volume * close / 2 AS taker_quote_volume
  FROM (SELECT symbol, CAST(epoch_ms(time_bucket(INTERVAL '1 hour', ts)) AS BIGINT) AS open_time,
               arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low,
               arg_max(price, (ts, seq)) AS close, sum(volume) AS volume, count(*) AS num_trades
        FROM quotes GROUP BY ALL))""",
    "sentiment": f"""sentiment AS (
  SELECT ts AS "timestamp", 'S' || CAST(user_id % 5 AS VARCHAR) AS symbol,
         CASE WHEN event_type IN ('purchase','signup') THEN 'bullish'
              WHEN event_type = 'error' THEN 'bearish' ELSE 'neutral' END AS sentiment_label,
         least(value / 500, 1.0) AS confidence, event_type || ' ' || printf('%.2f', value) AS text,
         CASE WHEN user_id % 2 = 0 THEN 'mistral' ELSE 'huggingface' END AS provider,
         value AS price, {_EXCHANGE_SQL} AS exchange, event_id AS seq
  FROM events)""",
    "rules": """rules AS (
  SELECT symbol, exchange, threshold, condition,
         CASE WHEN exchange = 'bitmex' THEN ['binance','kraken'] END AS fallback_exchanges
  FROM (SELECT DISTINCT symbol, exchange FROM quotes),
       (VALUES (100.0::DOUBLE, 'above'), (5.0::DOUBLE, 'below')) r(threshold, condition))""",
    "points": """points AS (
  SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)""",
}
_NEEDS = {"candles": ["quotes", "candles"], "rules": ["quotes", "rules"]}


def with_views(*names: str) -> str:
    """``WITH`` prefix that defines the named views for the SQL oracle (ends without a comma)."""
    wanted: list[str] = []
    for name in names:
        for part in _NEEDS.get(name, [name]):
            if part not in wanted:
                wanted.append(part)
    return "WITH RECURSIVE " + ",\n".join(_SQL[n] for n in wanted)
