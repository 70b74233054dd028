"""Sources, sinks and streams, each run over the given tables and read back."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from marketspark.catalog.alerts import LATEST, REGIME_SQL, REPLAY_SQL, RULES
from marketspark.catalog.base import query, rounded
from marketspark.catalog.candles import CANDLES, DERIVED_SQL, DOUBLED, doubled
from marketspark.catalog.indicators import ATR_SQL, EMAS_SQL, MINUTES, NUMBERED, minute_bars
from marketspark.catalog.sentiment import SENTIMENT, gloomy_classifier
from marketspark.functions import parse
from marketspark.operators import alerts as A
from marketspark.operators.candles import PRICES, new_rows
from marketspark.operators.features import FEATURES, MIN_ROWS
from marketspark.operators.joins import join_small
from marketspark.operators.patterns import detect
from marketspark.plans.training import train
from marketspark.sources import paged, tables
from marketspark.session import new_path, settle
from marketspark.streaming import alerts as SA
from marketspark.streaming import compaction as SC
from marketspark.streaming import indicators as SN
from marketspark.streaming import ingest as SI
from marketspark.streaming import regimes as SR
from marketspark.views import HOUR_MS, candles, quotes, quotes_of, rules, sentiment, stored_candles, table, with_views

_ALL = "symbol, open_time, open, high, low, close, volume, close_time, round(quote_volume, 4) AS quote_volume, num_trades, taker_base_volume, round(taker_quote_volume, 4) AS taker_quote_volume"
_WHOLE = CANDLES + f" SELECT {_ALL} FROM candles"


def tidy(df):
    return rounded(df, "quote_volume", "taker_quote_volume", digits=4)


def _slots():
    """The 12 slots of a candle array, prices as text."""
    money = [F.col(c).cast("string") for c in (*PRICES, "volume")]
    tail = [F.col("quote_volume").cast("string"), F.col("num_trades").cast("string"), F.col("taker_base_volume").cast("string"), F.col("taker_quote_volume").cast("string"), F.lit("0")]
    return F.array(F.col("open_time").cast("string"), *money, F.col("close_time").cast("string"), *tail)


@query("s1_candle_pages", _WHOLE)
def _(spark, sf_dir):
    day = F.expr("open_time div 86400000")
    pages = candles(spark, sf_dir).groupBy("symbol", day.alias("day")).agg(F.to_json(F.collect_list(_slots())).alias("value"))
    return tidy(tables.parse_candle_pages(pages))


FEED = "marketspark.sources.paged:from_table"


def _feed(spark, sf_dir):
    """The candles behind a stand-in for the paged service, and the range of their open times."""
    store = new_path(spark, "feed")
    candles(spark, sf_dir).write.parquet(store)
    bars = spark.read.parquet(store)
    return store, bars, *bars.agg(F.min("open_time"), F.max("open_time")).first()


@query("s2_paged_read", _WHOLE)
def _(spark, sf_dir):
    store, bars, _, _ = _feed(spark, sf_dir)
    instruments = bars.groupBy("symbol").agg(F.min("open_time").alias("start"), F.max("open_time").alias("end"))
    return tidy(paged.read_instruments(instruments, FEED, "15m", 1, store=store))


@query("s2_resumed", _WHOLE)
def _(spark, sf_dir):
    """One symbol is loaded to the middle, the others not at all; then every symbol from where it stands."""
    store, bars, low, high = _feed(spark, sf_dir)
    table = new_path(spark, "candles")
    paged.read_paged(spark, FEED, ["view"], low, (low + high) // 2, "15m", 1, store=store).write.parquet(table)
    lacking = paged.resumed(bars, spark.read.parquet(table), low, high)
    paged.read_instruments(lacking, FEED, "15m", 1, store=store).write.mode("append").parquet(table)
    return tidy(spark.read.parquet(table))


@query("s2_pushed", _WHOLE + " WHERE symbol IN ('view', 'error') AND open_time >= 1704672000000 AND open_time < 1706000000000")
def _(spark, sf_dir):
    """Only two symbols and a part of the time are asked for."""
    store, bars, low, high = _feed(spark, sf_dir)
    instruments = new_path(spark, "instruments")
    bars.select("symbol").distinct().write.parquet(instruments)
    rows = paged.read_paged(spark, FEED, instruments, low, high, "15m", 1, store=store)
    return tidy(rows.filter("symbol IN ('view', 'error') AND open_time >= 1704672000000 AND open_time < 1706000000000"))


@query("s2_stream", _WHOLE)
def _(spark, sf_dir):
    """A stream of pages that is stopped in the middle and started again."""
    store, bars, low, high = _feed(spark, sf_dir)
    instruments, table, state = (new_path(spark, n) for n in ("instruments", "candles", "state"))
    bars.select("symbol").distinct().write.parquet(instruments)
    for end in ((low + high) // 2, high):
        run(SI.start_append(paged.stream_paged(spark, FEED, instruments, low, end, "15m", 1, store=store), table, state))
    return tidy(spark.read.parquet(table))


def messages(spark, sf_dir, copy=None):
    """Candle messages as text; every fifth hour is not finished yet, and one in nine is broken.

    ``copy`` takes those of the first or the second copies only (see ``doubled``).
    """
    bars = candles(spark, sf_dir) if copy is None else doubled(spark, sf_dir).filter(F.col("seq") == copy)
    hour = F.expr(f"open_time div {HOUR_MS}")
    closed = hour % 5 != 0
    pairs = {"t": "open_time", "T": "close_time", "o": "open", "c": "close", "h": "high", "l": "low", "v": "volume", "q": "quote_volume", "n": "num_trades", "V": "taker_base_volume", "Q": "taker_quote_volume"}
    k = F.create_map(*[x for key, c in pairs.items() for x in (F.lit(key), F.col(c).cast("string"))], F.lit("x"), closed.cast("string"))
    text = F.to_json(F.struct(F.lit("kline").alias("e"), F.col("symbol").alias("s"), k.alias("k")))
    return bars.select(F.when(hour % 9 == 0, F.concat(F.lit("broken "), F.col("symbol"))).otherwise(text).alias("value"))


_KEPT = f"(open_time // {HOUR_MS}) % 9 <> 0 AND (open_time // {HOUR_MS}) % 5 <> 0"


@query("s4_flatten", CANDLES + f" SELECT {_ALL}, (open_time // {HOUR_MS}) % 5 <> 0 AS is_closed FROM candles WHERE (open_time // {HOUR_MS}) % 9 <> 0")
def _(spark, sf_dir):
    rows = parse.flatten_candle(parse.decode_candle(messages(spark, sf_dir)))
    return tidy(rows.filter(F.col("symbol").isNotNull()))


@query("f5_closed_only", CANDLES + f" SELECT symbol, open_time FROM candles WHERE {_KEPT}")
def _(spark, sf_dir):
    rows = parse.flatten_candle(parse.closed_only(parse.decode_candle(messages(spark, sf_dir))))
    return rows.select("symbol", "open_time")


@query("s5_tickers", with_views("quotes") + " SELECT symbol, arg_max(price, (ts, seq)) AS price FROM quotes WHERE symbol IN ('view', 'click') GROUP BY symbol")
def _(spark, sf_dir):
    path = new_path(spark, "tickers")
    latest = quotes(spark, sf_dir).groupBy("symbol").agg(F.max_by("price", F.struct("ts", "seq")).alias("price"))
    tables.write_json(latest, path)
    return tables.read_tickers(spark, path, ["view", "click"])


@query("s6_candle_table", DOUBLED + ", u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, open_time ORDER BY seq DESC) AS rn FROM doubled) WHERE rn = 1) SELECT symbol, open_time, close, volume FROM u")
def _(spark, sf_dir):
    path = new_path(spark, "candles")
    rows = doubled(spark, sf_dir)
    tables.write_candles(rows, path, whole=True)
    tables.write_candles(rows.filter(F.col("symbol") == "view"), path)  # a repeated load changes nothing
    return tables.read_candles(spark, path).select("symbol", "open_time", "close", "volume")


@query("s6_incremental_load", CANDLES + f" SELECT {_ALL} FROM candles")
def _(spark, sf_dir):
    """Half of the tape is stored, then what is newer is loaded twice; the cut lies inside a day."""
    path = new_path(spark, "candles")
    bars = stored_candles(spark, sf_dir)
    low, high = bars.agg(F.min("open_time"), F.max("open_time")).first()
    cut = (low + high) // 2 // 86_400_000 * 86_400_000 + 11 * HOUR_MS
    tables.write_candles(bars.filter(F.col("open_time") <= cut), path, whole=True)
    for _ in range(2):
        fresh = new_rows(bars, spark.read.parquet(path), high)
        tables.write_candles(fresh, path)
    return tidy(spark.read.parquet(path).drop("open_date"))


@query("s8_sentiment_append", SENTIMENT + ' SELECT "timestamp", symbol, sentiment_label, confidence, price FROM sentiment')
def _(spark, sf_dir):
    path = new_path(spark, "sentiment")
    rows = sentiment(spark, sf_dir).drop("seq")
    for part in (F.col("provider") == "mistral", F.col("provider") == "huggingface", F.lit(False)):
        tables.append_sentiment(rows.filter(part), path)
    return spark.read.parquet(path).select("timestamp", "symbol", "sentiment_label", "confidence", "price")


@query("s12_rules_file", RULES + " SELECT symbol, exchange, threshold, condition, len(fallback_exchanges) AS fallbacks FROM rules")
def _(spark, sf_dir):
    path = new_path(spark, "rules")
    whole = rules(spark, sf_dir).agg(F.to_json(F.collect_list(F.struct("*"))))  # a rule file is one small array
    whole.coalesce(1).write.text(path)
    out = tables.read_rules(spark, path)
    return out.select("symbol", "exchange", "threshold", "condition", F.when(F.col("fallback_exchanges").isNotNull(), F.size("fallback_exchanges")).cast("bigint").alias("fallbacks"))


@query("s13_json_result", CANDLES + " SELECT symbol, count(*) FILTER (WHERE close > open) AS up_bars FROM candles GROUP BY symbol")
def _(spark, sf_dir):
    path = new_path(spark, "result")
    tables.write_json(candles(spark, sf_dir).groupBy("symbol").agg(F.count_if(F.col("close") > F.col("open")).alias("up_bars")), path)
    return spark.read.schema("symbol string, up_bars bigint").json(path)


@query("s14_retention", SENTIMENT + ' SELECT "timestamp", seq, symbol FROM sentiment WHERE "timestamp" > TIMESTAMP \'2024-01-31\' - INTERVAL \'14 days\'')
def _(spark, sf_dir):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return tables.retained(sentiment(spark, sf_dir), now, 14 * 86_400).select("timestamp", "seq", "symbol")


@query("s14_expired", SENTIMENT + ' SELECT "timestamp", symbol, price FROM sentiment WHERE CAST("timestamp" AS DATE) >= DATE \'2024-01-31\' - 14')
def _(spark, sf_dir):
    """The table's old days are removed, then it is read as a whole."""
    path = new_path(spark, "sentiment")
    tables.append_sentiment(sentiment(spark, sf_dir).drop("seq"), path)
    tables.drop_expired(spark, path, date(2024, 1, 31), 14)
    return spark.read.parquet(path).select("timestamp", "symbol", "price")


@query("s16_table_copy", _WHOLE)
def _(spark, sf_dir):
    source, target = new_path(spark, "source"), new_path(spark, "copy")
    candles(spark, sf_dir).write.parquet(source)
    tables.copy_table(spark, source, target)
    return tidy(spark.read.parquet(target))


# ---- streams -------------------------------------------------------------------------------


def message_stream(spark, sf_dir):
    path = new_path(spark, "messages")
    messages(spark, sf_dir).write.text(path)
    return SI.read_messages(spark, path)


def quote_stream(spark, sf_dir):
    """The events table read as a stream of quotes."""
    schema = table(spark, sf_dir, "events").schema
    return quotes_of(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))


def run(stream_query):
    stream_query.awaitTermination()


_DERIVED = f"symbol, open_time, close, make_timestamp(open_time * 1000) AS open_datetime, {DERIVED_SQL.replace('close - open AS', 'round(close - open, 6) AS').replace('high - low AS', 'round(high - low, 6) AS')}"


def _derived(df):
    names = ("symbol", "open_time", "close", "open_datetime", "price_change", "price_change_pct", "high_low_spread", "high_low_spread_pct")
    return rounded(df.select(*names), "price_change", "high_low_spread")


@query("x1_ingest", CANDLES + f" SELECT {_DERIVED} FROM candles WHERE {_KEPT}")
def _(spark, sf_dir):
    path, aside, state = (new_path(spark, n) for n in ("ingest", "aside", "state"))
    run(SI.start_ingest(message_stream(spark, sf_dir), path, aside, state))
    return _derived(spark.read.parquet(path))


@query("s3_stream_read", CANDLES + f" SELECT symbol, open_time FROM candles WHERE {_KEPT}")
def _(spark, sf_dir):
    path, state = new_path(spark, "append"), new_path(spark, "state")
    rows = SI.candles_from(message_stream(spark, sf_dir)).select("symbol", "open_time")
    run(SI.start_append(rows, path, state))
    return spark.read.parquet(path)


@query("s7_stream_write", CANDLES + f" SELECT {_DERIVED} FROM candles WHERE {_KEPT}")
def _(spark, sf_dir):
    path, aside, state = (new_path(spark, n) for n in ("ingest", "aside", "state"))
    run(SI.start_ingest(message_stream(spark, sf_dir), path, aside, state))
    return _derived(spark.read.parquet(path))


@query("s7_compacted", CANDLES + f" SELECT {_DERIVED} FROM candles WHERE {_KEPT}")
def _(spark, sf_dir):
    """Four loads, packed after the second and the third; the last lies beside the packed days."""
    feed, path, packed, aside, state = (new_path(spark, n) for n in ("messages", "ingest", "packed", "aside", "state"))
    text = messages(spark, sf_dir)
    for turn in range(4):
        text.filter(F.pmod(F.xxhash64("value"), F.lit(4)) == turn).write.mode("append").text(feed)
        run(SI.start_ingest(SI.read_messages(spark, feed), path, aside, state))
        if turn in (1, 2):
            SC.compact(spark, path, packed, least_parts=1)
    SC.forget_packed(spark, path, packed)
    return _derived(SC.read_ingested(spark, path, packed))


@query("x2_quarantine", CANDLES + f" SELECT 'broken ' || symbol AS value, count(*) AS messages FROM candles WHERE (open_time // {HOUR_MS}) % 9 = 0 GROUP BY symbol")
def _(spark, sf_dir):
    path, aside, state = (new_path(spark, n) for n in ("ingest", "aside", "state"))
    run(SI.start_ingest(message_stream(spark, sf_dir), path, aside, state))
    return spark.read.text(aside).groupBy("value").agg(F.count(F.lit(1)).alias("messages"))


@query("x3_rolling_view", CANDLES + f" SELECT symbol, close, make_timestamp(close_time * 1000) AS close_datetime FROM candles WHERE {_KEPT} AND make_timestamp(close_time * 1000) BETWEEN TIMESTAMP '2024-01-19 15:00:00' AND TIMESTAMP '2024-01-20'")
def _(spark, sf_dir):
    view, state = new_path(spark, "view"), new_path(spark, "state")
    now = lambda: F.lit("2024-01-20 00:00:00").cast("timestamp")
    run(SI.start_rolling_view(message_stream(spark, sf_dir), view, state, now, 540, availableNow=True))
    rows = spark.read.parquet(view)
    return rows.filter(F.col("batch") == rows.agg(F.max("batch")).scalar()).drop("batch")


@query("x4_latest_frame", DOUBLED + f" SELECT symbol, close_time, arg_max(close, seq) AS close FROM doubled WHERE {_KEPT} GROUP BY symbol, close_time")
def _(spark, sf_dir):
    """Second copies lie in a later file of the same batch."""
    feed, view, state = (new_path(spark, n) for n in ("messages", "view", "state"))
    for copy in (1, 2):
        messages(spark, sf_dir, copy).write.mode("append").text(feed)
    run(SI.start_latest_view(SI.read_messages(spark, feed, arrival=True), view, state, availableNow=True))
    rows = spark.read.parquet(view)
    return rows.filter(F.col("batch") == rows.agg(F.max("batch")).scalar()).select("symbol", "close_time", "close")


@query("x5_stateful_alerts", REPLAY_SQL.format(move="100"))
def _(spark, sf_dir):
    path, held, state = (new_path(spark, n) for n in ("fired", "last", "state"))
    run(SA.start_alerts(quote_stream(spark, sf_dir), rules(spark, sf_dir), path, held, state))
    return spark.read.schema(SA.FIRED_DDL).parquet(path).drop("batch")


@query("x5_out_of_order", REPLAY_SQL.format(move="100"))
def _(spark, sf_dir):
    """Each load holds a span of the tape and quotes that belong up to a day earlier or later."""
    feed, fired, late, state, checkpoint = (new_path(spark, n) for n in ("feed", "fired", "late", "state", "checkpoint"))
    tape = quotes(spark, sf_dir)
    low, high = tape.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    moved = F.unix_micros("ts") + (F.pmod(F.xxhash64("seq"), F.lit(86_400)) - 43_200) * 1_000_000
    load = F.greatest(F.lit(0), F.least(F.lit(3), F.floor((moved - low) * 4 / max(high - low, 1))))
    rows = settle(tape.withColumn("_load", load))
    for turn in range(4):
        rows.filter(F.col("_load") == turn).drop("_load").write.mode("append").parquet(feed)
        stream = spark.readStream.schema(tape.schema).parquet(feed)
        run(SA.start_event_time_alerts(stream, rules(spark, sf_dir), fired, late, state, checkpoint, lateness_seconds=2 * 86_400))
    SA.finish_alerts(spark, fired, late, state)
    return spark.read.schema(SA.FIRED_DDL).parquet(fired).drop("batch")


@query(
    "v4_stream_ema",
    EMAS_SQL + ATR_SQL.removeprefix(NUMBERED) + """ SELECT symbol, open_time, ema_9, ema_21, ema_50, ema_200, round(atr, 6) AS atr
  FROM emas JOIN (SELECT symbol, open_time, atr FROM a) USING (symbol, open_time)""",
)
def _(spark, sf_dir):
    """The candles come in three loads; averages are carried from one to the next."""
    feed, out, late, state, checkpoint = (new_path(spark, n) for n in ("feed", "averages", "late", "state", "checkpoint"))
    bars = stored_candles(spark, sf_dir)
    low, high = bars.agg(F.min("open_time"), F.max("open_time")).first()
    for turn in range(3):
        bars.filter(F.expr(f"(open_time - {low}) * 3 div ({high} - {low} + 1)") == turn).write.mode("append").parquet(feed)
        run(SN.start_indicators(spark.readStream.schema(bars.schema).parquet(feed), out, late, state, checkpoint))
    names = ["ema_9", "ema_21", "ema_50", "ema_200", "atr"]
    return rounded(spark.read.parquet(out).select("symbol", "open_time", *names), *names)


@query(
    "x6_fallback",
    REPLAY_SQL.format(move="100").replace("FROM quotes q JOIN rules r", "FROM (SELECT * REPLACE ('okx' AS exchange) FROM quotes WHERE exchange = 'kraken') q JOIN (SELECT * REPLACE ('okx' AS exchange) FROM rules WHERE exchange = 'binance') r"),
)
def _(spark, sf_dir):
    """Rules of an exchange without quotes fire on the first fallback that has some."""
    path, held, state = (new_path(spark, n) for n in ("fired", "last", "state"))
    moved = rules(spark, sf_dir).filter("exchange = 'binance'").withColumns({"exchange": F.lit("okx"), "fallback_exchanges": F.array(F.lit("nowhere"), F.lit("kraken"), F.lit("binance"))})
    run(SA.start_alerts(quote_stream(spark, sf_dir), moved, path, held, state, fallback=True))
    return spark.read.schema(SA.FIRED_DDL).parquet(path).drop("batch")


def _stand_in():
    """Classifier stand-in: alerts above a threshold are bullish, others have no answer."""

    def classify(texts):
        return [(["bullish", "neutral"], [0.9, 0.1]) if "(above)" in t else None for t in texts]

    return classify


def _alert_cycle(spark, sf_dir):
    store, box, fired, held, state = (new_path(spark, n) for n in ("sentiment", "outbox", "fired", "last", "state"))
    # A regime per key: its number of quotes modulo 5, noise for 0.
    patterns = quotes(spark, sf_dir).groupBy("exchange", "symbol").agg((F.count(F.lit(1)) % 5 - 1).alias("cluster_id"))
    run(SA.start_alert_cycle(quote_stream(spark, sf_dir), rules(spark, sf_dir), patterns, _stand_in, store, box, fired, held, state, gloomy_classifier, availableNow=True))
    return store, box


_CYCLE = REPLAY_SQL.format(move="100").replace("SELECT symbol, exchange, threshold, condition, ts, seq, price FROM s WHERE fired", ", f AS (SELECT symbol, exchange, threshold, condition, ts, seq, price FROM s WHERE fired)")


@query(
    "x6_alert_cycle",
    _CYCLE + """, g AS (SELECT exchange, symbol, count(*) % 5 - 1 AS c FROM quotes GROUP BY 1, 2)
  SELECT f.symbol, f.exchange, condition, ts, price,
    concat_ws(chr(10), '*Price Alert!*', 'Symbol: `' || f.symbol || '`', 'Exchange: `' || f.exchange || '`', 'Current: `$' || format('{:,.2f}', price) || '`',
      'Threshold: `$' || format('{:,.2f}', threshold) || '` (' || condition || ')', 'Time: ' || strftime(ts, '%Y-%m-%d %H:%M:%S UTC')) ||
    CASE WHEN c >= 0 THEN chr(10) || chr(10) || ' *Pattern:* ' || CASE c """ + REGIME_SQL + """ END || ' (cluster ' || c || ')' ELSE '' END || chr(10) || chr(10) ||
    CASE condition WHEN 'above' THEN ' *Sentiment (mistral):* bullish (0.90)' ELSE ' *Sentiment (huggingface):* bearish (0.75)' END AS message
  FROM f LEFT JOIN g ON f.exchange = g.exchange AND f.symbol = g.symbol""",
)
def _(spark, sf_dir):
    _, box = _alert_cycle(spark, sf_dir)
    message = F.col("message")
    return spark.read.parquet(box).select(
        "symbol",
        "exchange",
        "condition",
        "ts",
        "price",
        message,
    )


@query(
    "x6_stored_sentiment",
    _CYCLE + """ SELECT ts AS "timestamp", symbol, exchange, price, CASE condition WHEN 'above' THEN 'bullish' ELSE 'bearish' END AS sentiment_label,
    CASE condition WHEN 'above' THEN 0.9::DOUBLE ELSE 0.75::DOUBLE END AS confidence, condition AS m_condition FROM f""",
)
def _(spark, sf_dir):
    store, _ = _alert_cycle(spark, sf_dir)
    return spark.read.parquet(store).select(
        "timestamp", "symbol", "exchange", "price", "sentiment_label", "confidence", F.element_at("metadata", "alert_condition").alias("m_condition")
    )


@query(
    "x6_detected",
    _CYCLE + f""", span AS (SELECT min(epoch_us(ts)) AS low, max(epoch_us(ts)) AS high FROM quotes),
  minutes AS (SELECT n, exchange, symbol, time_bucket(INTERVAL '1 minute', ts) AS minute, arg_max(price, (ts, seq)) AS close, sum(volume) AS volume
    FROM (SELECT q.*, (epoch_us(ts) - low) * 3 // (high - low + 1) AS load FROM quotes q, span) q JOIN range(3) l(n) ON load <= n GROUP BY ALL),
  ring AS (SELECT n, exchange, symbol, count(*) AS bars, avg(close) AS mean_close, avg(volume) AS mean_volume
    FROM (SELECT *, row_number() OVER (PARTITION BY n, exchange, symbol ORDER BY minute DESC) AS rn FROM minutes) WHERE rn <= 60 GROUP BY ALL)
  SELECT f.symbol, f.exchange, condition, ts, price, bars, bars >= {MIN_ROWS} AS detected, bars >= {MIN_ROWS} AS told,
    CASE WHEN bars >= {MIN_ROWS} THEN round(mean_close, 6) END AS mean_close, CASE WHEN bars >= {MIN_ROWS} THEN round(mean_volume, 6) END AS mean_volume
  FROM f, span JOIN ring r ON r.n = (epoch_us(ts) - low) * 3 // (high - low + 1) AND r.exchange = f.exchange AND r.symbol = f.symbol""",
)
def _(spark, sf_dir):
    """Three loads; the regime of each alert is that of its key's newest 60 minutes when its load has come."""
    feed, store, box, fired, held, ring, state = (new_path(spark, n) for n in ("feed", "sentiment", "outbox", "fired", "last", "ring", "state"))
    model = train(stored_candles(spark, sf_dir), k=5, starts=2)
    detector = SR.RegimeRing(ring, model.embedder, model.centroids)
    tape = quotes(spark, sf_dir)
    low, high = tape.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    for turn in range(3):
        load = F.expr(f"(unix_micros(ts) - {low}L) * 3 div {high - low + 1}L")
        tape.filter(load == turn).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(tape.schema).parquet(feed)
        run(SA.start_alert_cycle(stream, rules(spark, sf_dir), detector, _stand_in, store, box, fired, held, state, gloomy_classifier, availableNow=True))
    found = spark.read.schema(SR.FOUND_DDL + ", batch int").parquet(f"{ring}/found")
    told = F.col("message").contains("*Pattern:*")
    value = {c: F.col("feature_vector").getItem(FEATURES.index(c)) for c in ("mean_close", "mean_volume")}
    out = spark.read.parquet(box).join(found, ["batch", "exchange", "symbol"]).withColumns(value)
    out = out.select("symbol", "exchange", "condition", "ts", "price", "bars", (F.col("cluster_id") >= 0).alias("detected"), told.alias("told"), "mean_close", "mean_volume")
    return rounded(out, "mean_close", "mean_volume")


@query("x7_no_repeats", CANDLES + f" SELECT symbol, open_time, close FROM candles WHERE {_KEPT}")
def _(spark, sf_dir):
    """Second copies, with another close, come in a later load, up to a month after the first."""
    feed, path, state = (new_path(spark, n) for n in ("messages", "unique", "state"))
    for copy in (1, 2):
        messages(spark, sf_dir, copy).write.mode("append").text(feed)
        run(SI.start_unique_ingest(SI.read_messages(spark, feed, arrival=True), path, state))
    return spark.read.parquet(path).select("symbol", "open_time", "close")


@query(
    "x8_stream_candles",
    CANDLES + " SELECT symbol, make_timestamp(open_time * 1000) AS ts, open, high, low, close, volume, num_trades FROM candles",
)
def _(spark, sf_dir):
    path, state = new_path(spark, "ticks"), new_path(spark, "state")
    run(SI.start_tick_candles(quote_stream(spark, sf_dir), path, state))
    return SI.read_tick_candles(spark, path)


@query(
    "j6_alert_patterns",
    LATEST + """, g AS (SELECT exchange, symbol, count(*) % 5 - 1 AS c FROM quotes GROUP BY 1, 2)
  SELECT r.symbol, r.exchange, threshold, condition, c AS cluster_id FROM latest l JOIN rules r ON l.exchange = r.exchange AND l.symbol = r.symbol
  LEFT JOIN g ON g.exchange = r.exchange AND g.symbol = r.symbol WHERE CASE condition WHEN 'above' THEN price > threshold ELSE price < threshold END""",
)
def _(spark, sf_dir):
    tape = quotes(spark, sf_dir)
    patterns = tape.groupBy("exchange", "symbol").agg((F.count(F.lit(1)) % 5 - 1).alias("cluster_id"))
    fired = A.matched_rules(A.latest_quotes(tape), rules(spark, sf_dir)).filter("crossed")
    out = SA.with_regimes(fired, patterns)
    return out.select("symbol", "exchange", "threshold", "condition", "cluster_id")


@query(
    "j6_detected",
    LATEST + MINUTES.removeprefix(with_views("quotes")) + f""", g AS (SELECT exchange, symbol, count(*) >= {MIN_ROWS} AS detected FROM newest GROUP BY 1, 2)
  SELECT r.symbol, r.exchange, threshold, condition, detected FROM latest l JOIN rules r ON l.exchange = r.exchange AND l.symbol = r.symbol
  LEFT JOIN g ON g.exchange = r.exchange AND g.symbol = r.symbol WHERE CASE condition WHEN 'above' THEN price > threshold ELSE price < threshold END""",
)
def _(spark, sf_dir):
    """Alerts of the newest quotes with the regime of their key's newest minutes; only alerting keys are given to the detector."""
    model = train(stored_candles(spark, sf_dir), k=5, starts=2)
    tape = quotes(spark, sf_dir)
    fired = settle(A.matched_rules(A.latest_quotes(tape), rules(spark, sf_dir)).filter("crossed"))
    wanted = join_small(minute_bars(spark, sf_dir), fired.select("exchange", "symbol").distinct(), ["exchange", "symbol"], "left_semi")
    out = SA.with_regimes(fired, detect(wanted, model.embedder, model.centroids))
    return out.select("symbol", "exchange", "threshold", "condition", (F.col("cluster_id") >= 0).alias("detected"))
