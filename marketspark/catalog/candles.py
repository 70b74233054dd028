"""Candle queries: projections, filters, order, aggregates, set operations."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketspark.catalog.base import query, rounded
from marketspark.functions import candles as C
from marketspark.functions import parse
from marketspark.operators import candles as O
from marketspark.session import new_path
from marketspark.sources.tables import read_candles, write_candles
from marketspark.views import HOUR_MS, candles, quotes, rules, stored_candles, table, with_views

CANDLES = with_views("candles")
QUOTES = with_views("quotes")
START, END = 1_704_844_800_000, 1_705_622_400_000  # 2024-01-10 and 2024-01-19, UTC
DERIVED_SQL = """close - open AS price_change,
  CASE WHEN open <> 0 THEN round((close - open) / open * 100, 4) ELSE 0 END AS price_change_pct,
  high - low AS high_low_spread,
  CASE WHEN low <> 0 THEN round((high - low) / low * 100, 4) ELSE 0 END AS high_low_spread_pct"""


def typed_times(bars):
    """Candles as the chart client holds them: typed open and close times."""
    return bars.withColumns(
        {"open_datetime": C.ms_to_timestamp("open_time"), "close_datetime": C.ms_to_timestamp("close_time")}
    )


def chart_table(spark, sf_dir, low_ms=None, high_ms=None):
    return typed_times(candles(spark, sf_dir, low_ms, high_ms))


def doubled(spark, sf_dir):
    """Candles with a second copy of every seventh hour, as a feed without keys would store them."""
    bars = candles(spark, sf_dir).withColumn("seq", F.lit(1))
    again = bars.filter(F.expr(f"(open_time div {HOUR_MS}) % 7") == 0)
    return bars.unionByName(again.withColumn("seq", F.lit(2)).withColumn("close", F.col("close") + 1))


DOUBLED = CANDLES + f""", doubled AS (SELECT *, 1 AS seq FROM candles UNION ALL
  SELECT * REPLACE (close + 1 AS close), 2 AS seq FROM candles WHERE (open_time // {HOUR_MS}) % 7 = 0)"""


@query("a20_build_candles", CANDLES + " SELECT symbol, make_timestamp(open_time * 1000) AS ts, open, high, low, close, volume, num_trades FROM candles")
def _(spark, sf_dir):
    return O.build_candles(quotes(spark, sf_dir), ["symbol"], 3600)


@query("p1_price_change", CANDLES + " SELECT symbol, open_time, round(close - open, 6) AS price_change FROM candles")
def _(spark, sf_dir):
    return rounded(
        candles(spark, sf_dir).select("symbol", "open_time", C.price_change().alias("price_change")), "price_change"
    )


@query(
    "p2_price_change_pct",
    CANDLES + " SELECT symbol, open_time, CASE WHEN open <> 0 THEN round((close - open) / open * 100, 4) ELSE 0 END AS price_change_pct FROM candles",
)
def _(spark, sf_dir):
    return candles(spark, sf_dir).select("symbol", "open_time", C.price_change_pct().alias("price_change_pct"))


@query("p3_high_low_spread", CANDLES + " SELECT symbol, open_time, round(high - low, 6) AS high_low_spread FROM candles")
def _(spark, sf_dir):
    return rounded(
        candles(spark, sf_dir).select("symbol", "open_time", C.high_low_spread().alias("high_low_spread")),
        "high_low_spread",
    )


@query(
    "p4_high_low_spread_pct",
    CANDLES
    + """ SELECT symbol, open_time,
  CASE WHEN low <> 0 THEN round((high - low) / low * 100, 4) ELSE 0 END AS spread_pct_low,
  CASE WHEN open <> 0 THEN round((high - low) / open * 100, 4) ELSE 0 END AS spread_pct_open FROM candles""",
)
def _(spark, sf_dir):
    return candles(spark, sf_dir).select(
        "symbol",
        "open_time",
        C.high_low_spread_pct("low").alias("spread_pct_low"),
        C.high_low_spread_pct("open").alias("spread_pct_open"),
    )


@query(
    "p5_epoch_to_time",
    CANDLES
    + """ SELECT symbol, open_time, make_timestamp(open_time * 1000) AS open_datetime,
  strftime(make_timestamp(close_time * 1000), '%Y-%m-%dT%H:%M:%S.%g+00:00') AS close_iso FROM candles""",
)
def _(spark, sf_dir):
    return candles(spark, sf_dir).select(
        "symbol",
        "open_time",
        C.ms_to_timestamp("open_time").alias("open_datetime"),
        C.iso_ms(C.ms_to_timestamp("close_time")).alias("close_iso"),
    )


@query(
    "p6_ingest_time",
    CANDLES + " SELECT symbol, open_time, true AS stamped, 1::BIGINT AS stamps FROM candles",
)
def _(spark, sf_dir):
    """Every candle bears one stamp, taken between the start of the query's making and its end."""
    before = F.lit(datetime.now(timezone.utc))
    stamped = candles(spark, sf_dir).withColumn("ingested", F.current_timestamp())
    inside = (F.col("ingested") >= before) & (F.col("ingested") < before + F.expr("INTERVAL 1 DAY"))
    stamps = F.size(F.collect_set("ingested").over(Window.partitionBy("symbol", "open_time"))).cast("bigint")
    return stamped.select("symbol", "open_time", inside.alias("stamped"), stamps.alias("stamps"))


@query(
    "p7_ohlcv_result",
    CANDLES
    + """ SELECT symbol, make_timestamp(open_time * 1000) AS open_datetime, make_timestamp(close_time * 1000) AS close_datetime,
  open, high, low, close, volume, round(quote_volume, 4) AS quote_volume, num_trades, taker_base_volume,
  round(taker_quote_volume, 4) AS taker_quote_volume, '1h' AS interval FROM candles""",
)
def _(spark, sf_dir):
    return rounded(C.ohlcv_result(candles(spark, sf_dir), "1h"), "quote_volume", "taker_quote_volume", digits=4)


@query("p8_live_result", CANDLES + " SELECT symbol, close, make_timestamp(close_time * 1000) AS close_datetime FROM candles")
def _(spark, sf_dir):
    return C.live_result(chart_table(spark, sf_dir))


@query(
    "p9_tolerant_time",
    """SELECT event_id, parsed, parsed + INTERVAL '1 hour' AS shown FROM (
  SELECT event_id, TRY_CAST(CASE WHEN event_type = 'error' THEN 'n/a' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP) AS parsed
  FROM events)""",
)
def _(spark, sf_dir):
    text = F.when(F.col("event_type") == "error", "n/a").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    rows = table(spark, sf_dir, "events").select("event_id", parse.parse_time(text).alias("parsed"))
    return rows.withColumn("shown", parse.display_time(F.col("parsed")))  # winter: one hour ahead of UTC


@query(
    "p10_tolerant_number",
    """SELECT event_id, TRY_CAST(CASE WHEN event_type = 'click' THEN 'x' || CAST(user_id AS VARCHAR) ELSE printf('%.2f', value) END AS DOUBLE) AS parsed
  FROM events""",
)
def _(spark, sf_dir):
    text = F.when(F.col("event_type") == "click", F.concat(F.lit("x"), F.col("user_id").cast("string"))).otherwise(
        F.format_string("%.2f", "value")
    )
    return table(spark, sf_dir, "events").select("event_id", parse.parse_number(text).alias("parsed"))


@query(
    "p20_direction",
    CANDLES + " SELECT symbol, open_time, CASE WHEN close > open THEN 'up' ELSE 'down' END AS direction FROM candles",
)
def _(spark, sf_dir):
    return candles(spark, sf_dir).select("symbol", "open_time", C.direction().alias("direction"))


@query(
    "p21_validity",
    """SELECT l_orderkey AS k, l_extendedprice AS high, l_quantity * 1000 AS low, l_extendedprice * (1 - l_discount) AS close,
  (l_extendedprice >= l_quantity * 1000 AND l_extendedprice * (1 - l_discount) <= l_extendedprice
   AND l_extendedprice * (1 - l_discount) >= l_quantity * 1000) AS valid FROM lineitem""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"),
        F.col("l_extendedprice").alias("high"),
        (F.col("l_quantity") * 1000).alias("low"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("close"),
    )
    return rows.withColumn("valid", C.is_valid())


@query(
    "p23_symbol_form",
    QUOTES + " SELECT seq, upper(replace(lower(symbol) || '/' || exchange, '/', '')) AS symbol FROM quotes",
)
def _(spark, sf_dir):
    pairs = quotes(spark, sf_dir).withColumn("pair", F.concat_ws("/", F.lower("symbol"), "exchange"))
    return pairs.select("seq", C.normal_symbol("pair").alias("symbol"))


# ---- filters -------------------------------------------------------------------------------


@query("f1_symbol", CANDLES + " SELECT symbol, open_time, close FROM candles WHERE symbol = 'CLICK' OR symbol = 'click'")
def _(spark, sf_dir):
    """From a table that holds symbols as exchanges write them: the equality prunes the symbol's partitions."""
    path = new_path(spark, "candles")
    write_candles(candles(spark, sf_dir).withColumn("symbol", F.upper("symbol")), path, whole=True)
    return O.for_symbol(read_candles(spark, path), "click").select(F.lower("symbol").alias("symbol"), "open_time", "close")


@query("f2_open_range", CANDLES + f" SELECT symbol, open_time, close FROM candles WHERE open_time BETWEEN {START} AND {END}")
def _(spark, sf_dir):
    return O.in_open_range(candles(spark, sf_dir, START, END), START, END).select("symbol", "open_time", "close")


@query(
    "f3_last_minutes",
    CANDLES + """ SELECT symbol, close, make_timestamp(close_time * 1000) AS close_datetime FROM candles
  WHERE make_timestamp(close_time * 1000) BETWEEN TIMESTAMP '2024-01-19 15:00:00' AND TIMESTAMP '2024-01-20 00:00:00'""",
)
def _(spark, sf_dir):
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    noon = 1_705_708_800_000  # the same time in milliseconds; a bar that closes in range opens up to an hour before
    return C.live_result(O.last_minutes(chart_table(spark, sf_dir, noon - 540 * 60_000 - HOUR_MS, noon), now, 540))


@query(
    "f4_seconds_range",
    CANDLES + f" SELECT symbol, make_timestamp(open_time * 1000) AS open_datetime, close FROM candles WHERE open_time BETWEEN {START} AND {END}",
)
def _(spark, sf_dir):
    return O.in_seconds_range(chart_table(spark, sf_dir, START, END), [START // 1000, END // 1000]).select(
        "symbol", "open_datetime", "close"
    )


@query("f8_drop_null_time", "SELECT event_id, ts FROM events WHERE event_type <> 'error'")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_type") != "error", F.col("ts")).alias("ts")
    )
    return rows.dropna(subset=["ts"])


@query("f9_whitelist", QUOTES + " SELECT symbol, exchange, ts, price FROM quotes WHERE symbol IN ('purchase','view')")
def _(spark, sf_dir):
    return O.whitelist(quotes(spark, sf_dir), ["purchase", "view"]).select("symbol", "exchange", "ts", "price")


@query(
    "f12_chart_rows",
    CANDLES + f""" SELECT symbol, make_timestamp(open_time * 1000) AS open_datetime, make_timestamp(close_time * 1000) AS close_datetime, close
  FROM candles WHERE symbol = 'view' AND open_time BETWEEN {START} AND {END} ORDER BY open_time""",
)
def _(spark, sf_dir):
    texts = chart_table(spark, sf_dir, START, END).withColumn("open_datetime", C.iso_ms(F.col("open_datetime")))
    return O.chart_rows(texts, "view", [START // 1000, END // 1000]).select(
        "symbol", "open_datetime", "close_datetime", "close"
    )


# ---- order and limit -----------------------------------------------------------------------


@query(
    "t1_newest",
    CANDLES + " SELECT * FROM (SELECT symbol, open_time, close FROM candles ORDER BY open_time DESC, symbol DESC LIMIT 500) ORDER BY open_time, symbol",
)
def _(spark, sf_dir):
    return O.newest(candles(spark, sf_dir).select("symbol", "open_time", "close"), 500)


@query("t3_time_order", QUOTES + " SELECT ts, seq, symbol, price FROM quotes ORDER BY ts, seq")
def _(spark, sf_dir):
    return quotes(spark, sf_dir).select("ts", "seq", "symbol", "price").orderBy("ts", "seq")


@query("t5_newest_per_symbol", CANDLES + " SELECT symbol, max(open_time) AS open_time, arg_max(close, open_time) AS close FROM candles GROUP BY symbol")
def _(spark, sf_dir):
    bars = candles(spark, sf_dir).select("symbol", "open_time", "close")
    return O.keep_one(bars.withColumn("at", F.col("open_time")), ["symbol"], ["at"]).drop("at")


@query("t6_series_order", CANDLES + " SELECT symbol, make_timestamp(close_time * 1000) AS close_datetime, close FROM candles ORDER BY close_datetime, symbol")
def _(spark, sf_dir):
    return C.live_result(chart_table(spark, sf_dir)).select("symbol", "close_datetime", "close").orderBy("close_datetime", "symbol")


@query(
    "t7_head_tail",
    CANDLES + """ SELECT * FROM (SELECT symbol, open_time, 'head' AS part FROM candles ORDER BY open_time, symbol LIMIT 5)
  UNION ALL SELECT * FROM (SELECT symbol, open_time, 'tail' AS part FROM candles ORDER BY open_time DESC, symbol DESC LIMIT 5)""",
)
def _(spark, sf_dir):
    bars = candles(spark, sf_dir).select("symbol", "open_time")
    head = bars.orderBy("open_time", "symbol").limit(5).withColumn("part", F.lit("head"))
    return head.unionByName(O.newest(bars, 5).withColumn("part", F.lit("tail")))


@query(
    "s9_chart_scan",
    CANDLES + """ SELECT symbol, make_timestamp(open_time * 1000) AS open_datetime, make_timestamp(close_time * 1000) AS close_datetime,
  open, high, low, close, volume, round(quote_volume, 4) AS quote_volume, num_trades, taker_base_volume,
  round(taker_quote_volume, 4) AS taker_quote_volume, '15m' AS interval FROM candles""",
)
def _(spark, sf_dir):
    return rounded(O.scan_for_chart(candles(spark, sf_dir)), "quote_volume", "taker_quote_volume", digits=4)


@query(
    "s10_last_bars",
    QUOTES + """ SELECT symbol, exchange, ts, open, close, volume FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol, exchange ORDER BY ts DESC) AS rn FROM (
    SELECT symbol, exchange, time_bucket(INTERVAL '1 minute', ts) AS ts, arg_min(price, (ts, seq)) AS open,
           arg_max(price, (ts, seq)) AS close, sum(volume) AS volume FROM quotes GROUP BY 1, 2, 3)) WHERE rn <= 60""",
)
def _(spark, sf_dir):
    minutes = O.build_candles(quotes(spark, sf_dir), ["symbol", "exchange"], 60)
    return O.last_bars(minutes, ["symbol", "exchange"], 60, "ts").select(
        "symbol", "exchange", "ts", "open", "close", "volume"
    )


@query(
    "s11_training_rows",
    CANDLES + """ SELECT symbol, make_timestamp(open_time * 1000) AS "timestamp", open, high, low, close, volume FROM candles""",
)
def _(spark, sf_dir):
    return O.training_rows(candles(spark, sf_dir))


# ---- de-duplication ------------------------------------------------------------------------


@query(
    "w12_keep_last",
    DOUBLED + " SELECT symbol, close_time, arg_max(close, seq) AS close FROM doubled GROUP BY symbol, close_time",
)
def _(spark, sf_dir):
    rows = O.keep_one(doubled(spark, sf_dir), ["symbol", "close_time"], ["seq"])
    return rows.select("symbol", "close_time", "close").orderBy("close_time", "symbol")


@query(
    "w13_keep_first",
    DOUBLED + " SELECT symbol, open_time, arg_min(close, seq) AS close FROM doubled GROUP BY symbol, open_time",
)
def _(spark, sf_dir):
    rows = O.keep_one(doubled(spark, sf_dir), ["symbol", "open_time"], ["seq"], last=False)
    return rows.select("symbol", "open_time", "close").orderBy("open_time", "symbol")


@query(
    "w14_gaps",
    CANDLES + f""" SELECT symbol, open_time, previous_open_time, (open_time - previous_open_time) // {HOUR_MS} - 1 AS missing_bars FROM (
  SELECT symbol, open_time, lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time) AS previous_open_time FROM candles)
  WHERE open_time - previous_open_time > {HOUR_MS}""",
)
def _(spark, sf_dir):
    return O.gaps(stored_candles(spark, sf_dir), HOUR_MS)


# ---- aggregates ----------------------------------------------------------------------------


@query("a1_date_range", CANDLES + " SELECT make_timestamp(min(open_time) * 1000) AS min_date, make_timestamp(max(open_time) * 1000) AS max_date FROM candles")
def _(spark, sf_dir):
    return O.date_range(candles(spark, sf_dir), F.current_timestamp())


@query("a10_mean_volume", CANDLES + " SELECT round(avg(volume), 6) AS mean_volume FROM candles")
def _(spark, sf_dir):
    return rounded(O.mean_volume(candles(spark, sf_dir)), "mean_volume")


@query(
    "a11_summary",
    CANDLES
    + " UNION ALL ".join(
        f" SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS stddev, min({c}) AS min, max({c}) AS max FROM candles"
        for c in ("open", "high", "low", "close", "volume")
    ),
)
def _(spark, sf_dir):
    return rounded(O.summary(candles(spark, sf_dir)), "mean", "stddev")


@query("a12_direction_counts", CANDLES + " SELECT symbol, count(*) FILTER (WHERE close > open) AS up_bars, count(*) FILTER (WHERE close < open) AS down_bars FROM candles GROUP BY symbol")
def _(spark, sf_dir):
    return O.direction_counts(candles(spark, sf_dir))


@query(
    "a13_completeness",
    CANDLES + f""" SELECT symbol, expected, actual, expected - actual AS difference FROM (
  SELECT symbol, CAST(round((max(open_time) - min(open_time)) / {HOUR_MS}) AS BIGINT) + 1 AS expected, count(*) AS actual FROM candles GROUP BY symbol)""",
)
def _(spark, sf_dir):
    return O.completeness(candles(spark, sf_dir), HOUR_MS)


@query(
    "a14_duplicates",
    DOUBLED + " SELECT symbol, count(*) FILTER (WHERE n > 1) AS duplicates FROM (SELECT symbol, open_time, count(*) AS n FROM doubled GROUP BY 1, 2) GROUP BY symbol",
)
def _(spark, sf_dir):
    return O.duplicate_keys(doubled(spark, sf_dir))


@query(
    "a15_symbol_counts",
    CANDLES + " SELECT symbol, count(*) AS bars, make_timestamp(min(open_time) * 1000) AS earliest, make_timestamp(max(open_time) * 1000) AS latest FROM candles GROUP BY symbol",
)
def _(spark, sf_dir):
    return O.symbol_counts(candles(spark, sf_dir))


_NEEDED = ["symbol", "open", "high", "low", "close", "volume"]


@query(
    "a17_quality",
    DOUBLED
    + " SELECT count(*) AS rows, "
    + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS null_{c}" for c in _NEEDED)
    + ", "
    + ", ".join(f"count(*) FILTER (WHERE {c} < 0) AS negative_{c}" for c in _NEEDED[1:])
    + ", count(*) FILTER (WHERE high < low) AS high_below_low, count(*) FILTER (WHERE close < low OR close > high) AS close_outside, count(*) FILTER (WHERE volume <= 0) AS volume_not_positive FROM doubled",
)
def _(spark, sf_dir):
    return O.quality_report(doubled(spark, sf_dir))


@query("a18_newest_value", CANDLES + " SELECT symbol, max(open_time) AS last_open_time FROM candles GROUP BY symbol")
def _(spark, sf_dir):
    return O.newest_open_time(candles(spark, sf_dir))


# ---- incremental load and set operations ---------------------------------------------------


@query(
    "j3_incremental",
    CANDLES + f""", stored AS (SELECT * FROM candles WHERE open_time <= {START} AND symbol <> 'view')
  SELECT c.symbol, c.open_time, c.close FROM candles c LEFT JOIN (SELECT symbol, max(open_time) AS m FROM stored GROUP BY symbol) s USING (symbol)
  WHERE c.open_time > coalesce(m, {END} - 900000)""",
)
def _(spark, sf_dir):
    bars = stored_candles(spark, sf_dir)
    stored = bars.filter((F.col("open_time") <= START) & (F.col("symbol") != "view"))
    return O.new_rows(bars, stored, END).select("symbol", "open_time", "close")


@query("u1_union", CANDLES + " SELECT symbol, open_time, close FROM candles")
def _(spark, sf_dir):
    """The candles of one symbol and those of all others, with their columns in another order."""
    bars = candles(spark, sf_dir).select("symbol", "open_time", "close")
    one = bars.filter(F.col("symbol") == "click")
    return one.unionByName(bars.filter(F.col("symbol") != "click").select("close", "symbol", "open_time"))


@query("u2_price_keys", with_views("rules") + " SELECT DISTINCT exchange, symbol FROM rules")
def _(spark, sf_dir):
    return rules(spark, sf_dir).select("exchange", "symbol").distinct()


@query(
    "u4_best_interval",
    QUOTES + """, bars AS (
  SELECT '1h' AS interval, symbol, time_bucket(INTERVAL '1 hour', ts) AS ts, count(*) AS n FROM quotes GROUP BY 1, 2, 3
  UNION ALL SELECT '4h', symbol, time_bucket(INTERVAL '4 hours', ts), count(*) FROM quotes GROUP BY 1, 2, 3
  UNION ALL SELECT '1d', symbol, time_bucket(INTERVAL '1 day', ts), count(*) FROM quotes GROUP BY 1, 2, 3),
  sizes AS (SELECT interval, count(*) AS c, list_position(['1d','4h','1h'], interval) AS place FROM bars GROUP BY interval)
  SELECT interval, symbol, ts, n AS num_trades FROM bars WHERE interval =
   coalesce((SELECT arg_min(interval, place) FROM sizes WHERE c >= 3000), (SELECT arg_max(interval, (c, -place)) FROM sizes))""",
)
def _(spark, sf_dir):
    # The tape is read once; wider bars are rolled up from the hourly ones.
    bars = O.roll_up(stored_candles(spark, sf_dir).withColumn("ts", F.timestamp_millis("open_time")), {"1h": 3600, "4h": 14_400, "1d": 86_400})
    return O.best_interval(bars, ["1d", "4h", "1h"], 3000)
