"""Indicators, window features and chart series."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketspark.catalog.base import query, rounded
from marketspark.catalog.candles import CANDLES, chart_table, typed_times
from marketspark.operators import candles as O
from marketspark.operators import features as W
from marketspark.operators import indicators as I
from marketspark.plans import series
from marketspark.views import quotes, stored_candles, with_views

NUMBERED = CANDLES + """, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time) AS i,
  lag(close) OVER (PARTITION BY symbol ORDER BY open_time) AS prev_close FROM candles)"""
EMAS_SQL = NUMBERED + """, e AS (
  SELECT symbol, i, open_time, close_time, close, close AS e9, close AS e21, close AS e50, close AS e200 FROM n WHERE i = 1
  UNION ALL SELECT n.symbol, n.i, n.open_time, n.close_time, n.close, e9 + (n.close - e9) * 2 / 10, e21 + (n.close - e21) * 2 / 22,
    e50 + (n.close - e50) * 2 / 51, e200 + (n.close - e200) * 2 / 201 FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1),
  emas AS (SELECT symbol, open_time, close_time, close, CASE WHEN i >= 9 THEN round(e9, 6) END AS ema_9, CASE WHEN i >= 21 THEN round(e21, 6) END AS ema_21,
    CASE WHEN i >= 50 THEN round(e50, 6) END AS ema_50, CASE WHEN i >= 200 THEN round(e200, 6) END AS ema_200 FROM e)"""
_TRUE_RANGE = "greatest(high - low, coalesce(abs(high - prev_close), 0), coalesce(abs(low - prev_close), 0))"
ATR_SQL = NUMBERED + f""", t AS (SELECT symbol, i, open_time, close_time, {_TRUE_RANGE} AS tr FROM n),
  a AS (SELECT symbol, i, open_time, close_time, tr AS atr FROM t WHERE i = 1
  UNION ALL SELECT t.symbol, t.i, t.open_time, t.close_time, atr + (tr - atr) * 2 / 15 FROM a JOIN t ON t.symbol = a.symbol AND t.i = a.i + 1)"""


@query("w1_ema", EMAS_SQL + " SELECT symbol, open_time, ema_9, ema_21, ema_50, ema_200 FROM emas")
def _(spark, sf_dir):
    out = I.close_emas(stored_candles(spark, sf_dir)).select("symbol", "open_time", "ema_9", "ema_21", "ema_50", "ema_200")
    return rounded(out, "ema_9", "ema_21", "ema_50", "ema_200")


@query("w2_true_range", NUMBERED + f" SELECT symbol, open_time, round({_TRUE_RANGE}, 6) AS true_range FROM n")
def _(spark, sf_dir):
    return rounded(I.true_range(stored_candles(spark, sf_dir)).select("symbol", "open_time", "true_range"), "true_range")


@query("w3_atr", ATR_SQL + " SELECT symbol, open_time, round(atr, 6) AS atr FROM a")
def _(spark, sf_dir):
    return rounded(I.atr(stored_candles(spark, sf_dir)).select("symbol", "open_time", "atr"), "atr")


@query(
    "w4_sma",
    NUMBERED
    + " SELECT symbol, open_time, "
    + ", ".join(
        f"CASE WHEN i >= {k} THEN round(avg(close) OVER (PARTITION BY symbol ORDER BY i ROWS {k - 1} PRECEDING), 6) END AS sma_{k}"
        for k in (3, 5, 10, 20, 30)
    )
    + " FROM n",
)
def _(spark, sf_dir):
    sizes = (3, 5, 10, 20, 30)
    out = I.moving_averages(
        I.in_order(stored_candles(spark, sf_dir)), ["symbol"], {f"sma_{k}": ("close", k) for k in sizes}
    )
    return rounded(out.select("symbol", "open_time", *[f"sma_{k}" for k in sizes]), *[f"sma_{k}" for k in sizes])


@query("w6_simple_return", NUMBERED + " SELECT symbol, open_time, round(coalesce(close / prev_close - 1, 0), 6) AS ret FROM n")
def _(spark, sf_dir):
    return rounded(I.simple_returns(stored_candles(spark, sf_dir)).select("symbol", "open_time", "ret"), "ret")


@query("w11_log_return", NUMBERED + " SELECT symbol, open_time, round(ln(close) - ln(prev_close), 6) AS log_return FROM n")
def _(spark, sf_dir):
    return rounded(I.log_returns(stored_candles(spark, sf_dir)).select("symbol", "open_time", "log_return"), "log_return")


def _features_sql(source: str, keys: str, n: str, frame_rows: str | None) -> str:
    """Feature expressions over rows numbered ``i`` from 0 with ``ret``/``delta``; either per frame or per group."""
    over = f" OVER (PARTITION BY {keys} ORDER BY i ROWS BETWEEN {frame_rows} PRECEDING AND 1 PRECEDING)" if frame_rows else ""
    inner = f" OVER (PARTITION BY {keys} ORDER BY i ROWS BETWEEN {int(frame_rows) - 1} PRECEDING AND 1 PRECEDING)" if frame_rows else ""
    rets = "ret" if frame_rows else "CASE WHEN i > 0 THEN ret END"
    delta = "delta" if frame_rows else "CASE WHEN i > 0 THEN delta END"
    skew = "(c - 2) / sqrt(c * (c - 1))"
    first = f"first(close){over}" if frame_rows else "arg_min(close, i)"
    last = f"last(close){over}" if frame_rows else "arg_max(close, i)"
    closes = f"list(close ORDER BY i){over}" if not frame_rows else f"list(close){over}"
    return f"""SELECT {keys}, {'open_time, i,' if frame_rows else ''} count(*){over} AS n, avg(close){over} AS mean_close, stddev_pop(close){over} AS std_close,
    skewness(close){over} AS sk, kurtosis_pop(close){over} AS kurtosis_close,
    avg({rets}){inner} AS mean_return, stddev_pop({rets}){inner} AS std_return, skewness({rets}){inner} AS skr,
    kurtosis_pop({rets}){inner} AS kurtosis_return, max(high){over} AS mh, min(low){over} AS ml, max(close){over} AS mxc, min(close){over} AS mnc,
    {first} AS fc, {last} AS lc, avg(volume){over} AS mean_volume, stddev_pop(volume){over} AS volume_volatility,
    regr_slope(close, CAST(i AS DOUBLE)){over} AS linear_trend,
    avg({delta}){('' if not frame_rows else ' FILTER (WHERE delta > 0)')}{inner if frame_rows else f' FILTER (WHERE {delta} > 0)'} AS gain,
    avg(-({delta})){('' if not frame_rows else ' FILTER (WHERE delta < 0)')}{inner if frame_rows else f' FILTER (WHERE {delta} < 0)'} AS loss,
    {closes} AS closes FROM {source}{'' if frame_rows else f' GROUP BY {keys}'}"""


def _ema_list(span: int) -> str:
    return f"list_reduce(closes, lambda a, x: a + (x - a) * 2 / {span + 1})"


_NAMES = ", ".join(f"round({name}, 6) AS {name}" for name in W.FEATURES)
_FINISH = f"""SELECT *, sk * (n - 2) / sqrt(n * (n - 1)) AS skew_close, skr * (n - 3) / sqrt((n - 1) * (n - 2)) AS skew_return,
    CASE WHEN ml > 0 THEN mh / ml ELSE 1 END AS high_low_ratio, CASE WHEN fc > 0 THEN lc / fc ELSE 1 END AS close_open_ratio,
    std_return * sqrt(252) AS volatility, CASE WHEN fc > 0 THEN lc / fc - 1 ELSE 0 END AS momentum,
    CASE WHEN mxc > 0 THEN (mxc - mnc) / mxc ELSE 0 END AS max_drawdown,
    CASE WHEN n < 15 THEN 50 ELSE 100 - 100 / (1 + coalesce(gain, 0) / coalesce(loss, 1)) END AS rsi,
    CASE WHEN n < 26 THEN 0 ELSE {_ema_list(12)} - {_ema_list(26)} END AS macd"""
_W9_SQL = (
    NUMBERED
    + ", m AS (SELECT symbol, open_time, i - 1 AS i, high, low, close, volume, ln(close) - ln(prev_close) AS ret, close - prev_close AS delta FROM n), g AS ("
    + _features_sql("m", "symbol", "30", "30")
    + f"), f AS ({_FINISH} FROM g WHERE i >= 30) SELECT symbol, open_time, {_NAMES} FROM f"
)


@query("w9_rolling_features", _W9_SQL)
def _(spark, sf_dir):
    return rounded(W.rolling_features(stored_candles(spark, sf_dir)), *W.FEATURES)


def minute_bars(spark, sf_dir):
    bars = O.build_candles(quotes(spark, sf_dir), ["exchange", "symbol"], 60)
    return bars.withColumn("open_time", F.unix_millis("ts")).drop("ts")


MINUTES = with_views("quotes") + """, minutes AS (SELECT exchange, symbol, CAST(epoch_ms(time_bucket(INTERVAL '1 minute', ts)) AS BIGINT) AS open_time,
    arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, seq)) AS close, sum(volume) AS volume
  FROM quotes GROUP BY 1, 2, 3),
  newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY exchange, symbol ORDER BY open_time DESC) AS rn FROM minutes) WHERE rn <= 60),
  m AS (SELECT exchange, symbol, open_time, high, low, close, volume, row_number() OVER w - 1 AS i, ln(close) - ln(lag(close) OVER w) AS ret,
    close - lag(close) OVER w AS delta FROM newest WINDOW w AS (PARTITION BY exchange, symbol ORDER BY open_time))"""
NEWEST_FEATURES_SQL = MINUTES + ", g AS (" + _features_sql("m", "exchange, symbol", "n", None) + f"), f AS ({_FINISH} FROM g)"


@query("w10_newest_features", NEWEST_FEATURES_SQL + f" SELECT exchange, symbol, n AS bars, {_NAMES} FROM f WHERE n >= 10")
def _(spark, sf_dir):
    out = W.newest_features(minute_bars(spark, sf_dir)).filter(F.col("bars") >= W.MIN_ROWS)
    return rounded(out, *W.FEATURES)


@query("f10_minimum_window", MINUTES + " SELECT exchange, symbol, count(*) AS bars, count(*) >= 10 AS usable FROM m GROUP BY ALL")
def _(spark, sf_dir):
    out = W.newest_features(minute_bars(spark, sf_dir))
    return out.select("exchange", "symbol", "bars", F.col("mean_close").isNotNull().alias("usable"))


# ---- chart series --------------------------------------------------------------------------


@query(
    "c1_line_series",
    EMAS_SQL + " SELECT symbol, make_timestamp(close_time * 1000) AS close_datetime, close, ema_9, ema_21, ema_50, ema_200 FROM emas",
)
def _(spark, sf_dir):
    return rounded(series.line_series(typed_times(stored_candles(spark, sf_dir))), "ema_9", "ema_21", "ema_50", "ema_200")


@query("c2_candlestick_series", CANDLES + " SELECT symbol, make_timestamp(close_time * 1000) AS close_datetime, open, high, low, close FROM candles")
def _(spark, sf_dir):
    return series.candlestick_series(chart_table(spark, sf_dir))


@query(
    "c3_volume_series",
    CANDLES + """ SELECT symbol, make_timestamp(close_time * 1000) AS close_datetime, CASE WHEN close > open THEN volume END AS volume_up,
  CASE WHEN close > open THEN NULL ELSE volume END AS volume_down, round(avg(volume) OVER (), 6) AS mean_volume FROM candles""",
)
def _(spark, sf_dir):
    return rounded(series.volume_series(typed_times(stored_candles(spark, sf_dir))), "mean_volume")


@query("c4_volatility_series", ATR_SQL + " SELECT symbol, make_timestamp(close_time * 1000) AS close_datetime, round(atr, 6) AS atr FROM a")
def _(spark, sf_dir):
    symbols = ["click", "error", "purchase", "signup", "view", "absent"]
    return rounded(series.volatility_series(typed_times(stored_candles(spark, sf_dir)), symbols), "atr")


def live_messages(spark, sf_dir):
    """One payload per hour and symbol, with the candle twice; error-symbol payloads report an error."""
    row = F.struct(
        "symbol",
        F.date_format("close_datetime", "yyyy-MM-dd HH:mm:ss").alias("close_datetime"),
        "close",
        "volume",
        "open",
        "high",
        "low",
    )
    later = F.struct(
        "symbol",
        F.date_format("close_datetime", "yyyy-MM-dd HH:mm:ss").alias("close_datetime"),
        (F.col("close") + 1).alias("close"),
        "volume",
        "open",
        "high",
        "low",
    )
    good = F.to_json(F.struct(F.array(row, later).alias("data")))
    text = (
        F.when(F.col("symbol") == "error", F.lit('{"error": "feed down"}'))
        .when(F.col("num_trades") == 1, F.lit('{"data": []}'))
        .when(F.col("num_trades") == 2, F.lit("not json"))
        .when(F.col("num_trades") == 3, F.lit(None).cast("string"))
        .when(F.col("num_trades") == 4, F.lit('{"data": 5}'))
        .when(F.col("num_trades") == 5, F.lit("[1]"))
        .otherwise(good)
    )
    return chart_table(spark, sf_dir).select("symbol", F.col("open_time").alias("seq"), text.alias("data"))


@query(
    "p25_live_status",
    CANDLES + """ SELECT symbol, open_time AS seq, CASE WHEN symbol = 'error' THEN 'WebSocket error: feed down' WHEN num_trades = 1 THEN 'No realtime data received'
  WHEN num_trades = 2 THEN 'Invalid WebSocket payload' WHEN num_trades = 3 THEN 'WebSocket payload missing data field'
  WHEN num_trades = 4 THEN 'Invalid WebSocket data format' WHEN num_trades = 5 THEN 'Unexpected WebSocket payload format'
  ELSE 'WebSocket connected' END AS status,
  CASE WHEN symbol <> 'error' AND num_trades > 5 THEN 2 END AS records FROM candles""",
)
def _(spark, sf_dir):
    from marketspark.functions.parse import decode_live

    out = decode_live(live_messages(spark, sf_dir))
    return out.select("symbol", "seq", "status", F.size("records").alias("records")).withColumn(
        "records", F.when(F.col("records") >= 0, F.col("records"))
    )


@query(
    "c5_live_series",
    CANDLES + """ SELECT symbol, date_trunc('second', make_timestamp(close_time * 1000)) + INTERVAL '1 hour' AS close_datetime, close + 1 AS close
  FROM candles WHERE symbol <> 'error' AND num_trades > 5""",
)
def _(spark, sf_dir):
    return series.live_series(live_messages(spark, sf_dir))
