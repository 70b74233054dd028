"""One schema (as DDL text) per table; readers enforce them instead of inferring."""

from __future__ import annotations

CANDLE_DDL = (
    "symbol string, open_time bigint, open double, high double, low double, close double, "
    "volume double, close_time bigint, quote_volume double, num_trades bigint, "
    "taker_base_volume double, taker_quote_volume double"
)
CANDLE_1M_DDL = CANDLE_DDL + (
    ", open_datetime timestamp, close_datetime timestamp, price_change double, price_change_pct double, "
    "high_low_spread double, high_low_spread_pct double, ts timestamp, is_closed boolean"
)
SENTIMENT_DDL = (
    "timestamp timestamp, symbol string, sentiment_label string, confidence double, text string, "
    "provider string, price double, exchange string, metadata map<string,string>"
)
RULE_DDL = "symbol string, exchange string, threshold double, condition string, fallback_exchanges array<string>"
QUOTE_DDL = "symbol string, exchange string, ts timestamp, seq bigint, price double, volume double"
# Field names of the inner message differ only by case, so it is read as a map.
KLINE_MSG_DDL = "e string, s string, k map<string,string>"
