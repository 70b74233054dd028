"""Alert queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketspark.catalog.base import query, rounded
from marketspark.functions import text as X
from marketspark.operators import alerts as O
from marketspark.views import quotes, rules, sentiment, table, with_views

RULES = with_views("rules")
LATEST = RULES + """, latest AS (SELECT exchange, symbol, arg_max(price, (ts, seq)) AS price, max(ts) AS ts FROM quotes GROUP BY 1, 2)"""
_CROSSED = "coalesce(CASE condition WHEN 'above' THEN price > threshold WHEN 'below' THEN price < threshold END, false)"
_MONEY = "'$' || format('{{:,.2f}}', {0})"
TEXT_SQL = f"""'*Price Alert!*' || chr(10) || 'Symbol: `' || symbol || '`' || chr(10) || 'Exchange: `' || exchange || '`' || chr(10) ||
  'Current: `' || {_MONEY.format('price')} || '`' || chr(10) || 'Threshold: `' || {_MONEY.format('threshold')} || '` (' || condition || ')' || chr(10) ||
  'Time: ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ' UTC'"""

#: The regime names as branches of an SQL CASE.
REGIME_SQL = " ".join(f"WHEN {n} THEN '{name}'" for n, name in X.REGIMES.items())


@query("j1_rules_with_quotes", LATEST + f" SELECT r.symbol, r.exchange, threshold, condition, price, {_CROSSED} AS crossed FROM latest l JOIN rules r ON l.exchange = r.exchange AND l.symbol = r.symbol")
def _(spark, sf_dir):
    out = O.matched_rules(O.latest_quotes(quotes(spark, sf_dir)), rules(spark, sf_dir))
    return out.select("symbol", "exchange", "threshold", "condition", "price", "crossed")


@query("f7_crossed", RULES + f" SELECT r.symbol, r.exchange, threshold, condition, seq, price FROM quotes q JOIN rules r ON q.exchange = r.exchange AND q.symbol = r.symbol WHERE {_CROSSED}")
def _(spark, sf_dir):
    return O.crossings(quotes(spark, sf_dir), rules(spark, sf_dir)).drop("ts", "_at")


@query(
    "j2_fallback_price",
    LATEST + """, fresh AS (SELECT * FROM latest WHERE ts > (SELECT max(ts) FROM quotes) - INTERVAL '1 hour'),
  tries AS (SELECT DISTINCT symbol, exchange, unnest(list_distinct_in_order) AS t, generate_subscripts(list_distinct_in_order, 1) AS pos FROM (
    SELECT symbol, exchange, list_filter([exchange] || coalesce(fallback_exchanges, ['binance','kraken','bybit']), lambda x, i: i = 1 OR x <> exchange) AS list_distinct_in_order FROM rules))
  SELECT tries.symbol, tries.exchange, arg_min(price, pos) AS price, arg_min(t, pos) AS source FROM tries JOIN fresh ON fresh.exchange = t AND fresh.symbol = tries.symbol GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    tape = quotes(spark, sf_dir)
    newest = tape.agg(F.max("ts")).scalar()
    fresh = O.latest_quotes(tape).filter(F.col("ts") > newest - F.make_dt_interval(hours=F.lit(1)))
    return O.fallback_prices(rules(spark, sf_dir), fresh).select("symbol", "exchange", "price", "source")


def _probes(spark, sf_dir, kind):
    tape = quotes(spark, sf_dir)
    probes = tape.filter(F.col("symbol") == kind).select("exchange", "ts", F.col("seq").alias("probe"))
    return probes, tape.filter(F.col("symbol") != kind).select("exchange", "ts", "seq", "price")


def _asof(kind: str) -> str:
    return with_views("quotes") + f""", f AS (SELECT p.exchange, p.ts, p.seq AS probe, q.price, q.ts AS quote_ts FROM (SELECT * FROM quotes WHERE symbol = '{kind}') p
  ASOF LEFT JOIN (SELECT * FROM quotes WHERE symbol <> '{kind}') q ON p.exchange = q.exchange AND q.ts <= p.ts)"""


@query("j4_fresh_price", _asof("purchase") + " SELECT exchange, ts, probe, CASE WHEN epoch_us(ts) - epoch_us(quote_ts) < 600000000 THEN price END AS price FROM f")
def _(spark, sf_dir):
    probes, tape = _probes(spark, sf_dir, "purchase")
    return O.fresh_price(probes, tape, ["exchange"], 600).select("exchange", "ts", "probe", "price")


@query("j5_price_at_scoring", _asof("signup") + " SELECT exchange, ts, probe, price, quote_ts FROM f")
def _(spark, sf_dir):
    probes, tape = _probes(spark, sf_dir, "signup")
    return O.price_at(probes, tape, ["exchange"]).select("exchange", "ts", "probe", "price", "quote_ts")


@query("p16_alert_text", LATEST + f", m AS (SELECT r.symbol, r.exchange, threshold, condition, price, ts FROM latest l JOIN rules r ON l.exchange = r.exchange AND l.symbol = r.symbol) SELECT symbol, exchange, condition, {TEXT_SQL} AS message FROM m")
def _(spark, sf_dir):
    m = O.matched_rules(O.latest_quotes(quotes(spark, sf_dir)), rules(spark, sf_dir))
    cols = [F.col(c) for c in ("symbol", "exchange", "price", "threshold", "condition", "ts")]
    return m.select("symbol", "exchange", "condition", X.alert_text(*cols).alias("message"))


@query(
    "p17_sentiment_suffix",
    with_views("sentiment") + """ SELECT seq, text || CASE WHEN exchange = 'kraken' THEN '' ELSE chr(10) || chr(10) || ' *Sentiment (' || provider || '):* ' || sentiment_label || ' (' || printf('%.2f', floor(price * 100) / 100) || ')' END AS message FROM sentiment""",
)
def _(spark, sf_dir):
    label = F.when(F.col("exchange") != "kraken", F.col("sentiment_label"))
    message = X.with_sentiment(F.col("text"), F.col("provider"), label, F.floor(F.col("price") * 100) / 100)
    return sentiment(spark, sf_dir).select("seq", message.alias("message"))


@query(
    "p18_pattern_suffix",
    f"""SELECT event_id, CASE WHEN c >= 0 THEN event_type || chr(10) || chr(10) || ' *Pattern:* ' || CASE c {REGIME_SQL} ELSE 'Pattern ' || c END || ' (cluster ' || c || ')' ELSE event_type END AS message
  FROM (SELECT event_id, event_type, CASE WHEN user_id % 8 < 7 THEN user_id % 8 - 1 END AS c FROM events)""",
)
def _(spark, sf_dir):
    cluster = F.when(F.col("user_id") % 8 < 7, F.col("user_id") % 8 - 1)
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", cluster.alias("c"))
    return rows.select("event_id", X.with_pattern(F.col("event_type"), F.col("c")).alias("message"))


@query(
    "j7_regime_names",
    f"SELECT event_id, CASE user_id % 6 {REGIME_SQL} ELSE 'Pattern ' || (user_id % 6) END AS regime FROM events",
)
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.regime_name(F.col("user_id") % 6).alias("regime"))


@query("p19_hygiene", f"""SELECT doc_id, CAST(p AS INTEGER) AS part, substring(text, CAST(p * {X.MESSAGE_LIMIT} + 1 AS BIGINT), {X.MESSAGE_LIMIT}) AS message
  FROM (SELECT doc_id, text, unnest(range(0, greatest((length(text) + {X.MESSAGE_LIMIT - 1}) // {X.MESSAGE_LIMIT}, 1))) AS p FROM documents WHERE length(ltrim(text, chr(10) || chr(9) || chr(13) || ' ')) > 0)""")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter(X.is_sendable(F.col("text")))
    return docs.select("doc_id", F.posexplode(X.parts(F.col("text"))).alias("part", "message"))


REPLAY_SQL = RULES + f""", c AS (SELECT r.symbol, r.exchange, threshold, condition, ts, seq, price, row_number() OVER (PARTITION BY r.symbol, r.exchange, threshold, condition ORDER BY ts, seq) AS i
    FROM quotes q JOIN rules r ON q.exchange = r.exchange AND q.symbol = r.symbol WHERE {_CROSSED}),
  s AS (SELECT symbol, exchange, threshold, condition, i, ts, seq, price, ts AS lt, price AS lp, true AS fired FROM c WHERE i = 1
  UNION ALL SELECT c.symbol, c.exchange, c.threshold, c.condition, c.i, c.ts, c.seq, c.price,
    CASE WHEN c.ts - lt >= INTERVAL '1 hour' AND abs(c.price - lp) > {{move}} THEN c.ts ELSE lt END, CASE WHEN c.ts - lt >= INTERVAL '1 hour' AND abs(c.price - lp) > {{move}} THEN c.price ELSE lp END,
    c.ts - lt >= INTERVAL '1 hour' AND abs(c.price - lp) > {{move}}
    FROM s JOIN c ON c.symbol = s.symbol AND c.exchange = s.exchange AND c.threshold = s.threshold AND c.condition = s.condition AND c.i = s.i + 1)
  SELECT symbol, exchange, threshold, condition, ts, seq, price FROM s WHERE fired"""


@query("x5b_alert_replay", REPLAY_SQL.format(move="100"))
def _(spark, sf_dir):
    return O.replay(quotes(spark, sf_dir), rules(spark, sf_dir))


@query("v4_custom_fold", REPLAY_SQL.format(move="1"))
def _(spark, sf_dir):
    return O.replay(quotes(spark, sf_dir), rules(spark, sf_dir), min_move=1.0, part_seconds=5 * 86_400)
