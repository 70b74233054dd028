"""Candle filters, limits, derived columns, de-duplication and quality."""

import pytest
from pyspark.sql import functions as F

from marketspark.functions import candles as C
from marketspark.functions import parse
from marketspark.operators import candles as O
from marketspark.plans import series

STORE = [
    ("BTCUSDT", 1000, 1015, 50000.0, 51000.0, 49000.0, 50500.0, 100.0),
    ("BTCUSDT", 1015, 1030, 50500.0, 51500.0, 49500.0, 51000.0, 150.0),
    ("ETHUSDT", 1000, 1015, 3000.0, 3100.0, 2900.0, 3050.0, 500.0),
]
DDL = "symbol string, open_time bigint, close_time bigint, open double, high double, low double, close double, volume double"


@pytest.fixture(scope="module")
def store(spark):
    return spark.createDataFrame(STORE, DDL)


def test_range_of_table_and_of_nothing(spark, store):
    row = store.agg(F.min("open_time"), F.max("open_time")).first()
    assert tuple(row) == (1000, 1015)
    now = F.lit("2024-01-08 00:00:00").cast("timestamp")
    empty = O.date_range(store.limit(0), now).first()
    assert (empty.max_date - empty.min_date).days == 7


def test_symbol_range_limit(store):
    assert O.for_symbol(store, None).count() == 3
    assert O.for_symbol(store, "btcusdt").count() == 2
    assert O.for_symbol(store, "XRP").count() == 0
    assert O.in_open_range(store, 1015).count() == 1
    assert O.in_open_range(store, None, 1000).count() == 2
    got = [(r.symbol, r.open_time) for r in O.newest(store, 2).collect()]
    assert got == [("ETHUSDT", 1000), ("BTCUSDT", 1015)]
    assert O.newest(store).count() == 3


def test_result_rows(store):
    row = O.scan_for_chart(store, "BTCUSDT", limit=1, interval="15m").first()
    assert row.close == 51000.0 and row.interval == "15m" and row.quote_volume is None


def test_derived_columns(spark):
    df = spark.createDataFrame(
        [("BTCUSDT", 1620000000000, 1620000060000, 50000.0, 50200.0, 49900.0, 50100.0, 1.5), ("Z", 0, 1, 0.0, 1.0, 0.0, 1.0, 1.0)], DDL
    )
    row, zero = C.with_derived(df).orderBy(F.desc("open_time")).collect()
    assert (row.price_change, row.price_change_pct, row.high_low_spread, row.high_low_spread_pct) == (100.0, 0.2, 300.0, 0.6012)
    assert C.with_derived(df, "open").filter("symbol = 'BTCUSDT'").first().high_low_spread_pct == 0.6
    assert (zero.price_change_pct, zero.high_low_spread_pct) == (0.0, 0.0)
    iso = df.select(C.iso_ms(C.ms_to_timestamp("open_time")).alias("x")).orderBy(F.desc("x")).first().x
    assert iso == "2021-05-03T00:00:00.000+00:00"
    with pytest.raises(ValueError):
        C.high_low_spread_pct("close")


def test_chart_filter(spark):
    rows = [("BTC", "2024-01-01 10:00:00", 1.0), ("ETH", "2024-01-01 10:01:00", 2.0), ("BTC", "2024-01-01 10:02:00", 3.0), ("BTC", "no time", 4.0)]
    df = spark.createDataFrame(rows, "symbol string, open_datetime string, close double")
    pair = [1704103200, 1704103320]
    assert [r.close for r in O.chart_rows(df, "BTC", pair).collect()] == [1.0, 3.0]
    assert O.chart_rows(df, "BTC", ["x", 1]).count() == 3  # an unusable pair filters nothing
    assert O.chart_rows(df, "BTC", [1]).count() == 3


def test_last_minutes(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 10:00:00' + make_interval(0,0,0,0,0,id,0) AS close_datetime, id FROM range(120)")
    now = F.lit("2024-01-01 11:30:00").cast("timestamp")
    got = sorted(r.id for r in O.last_minutes(df, now, 60).collect())
    assert got == list(range(30, 91))


def test_direction_and_validity(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 0.5), (2.0, 2.0, 3.0, 0.5), (2.0, 9.0, 3.0, 0.5), (1.0, None, 3.0, 0.5)], "open double, close double, high double, low double")
    rows = df.select(C.direction().alias("d"), C.is_valid().alias("v")).collect()
    assert [r.d for r in rows] == ["up", "down", "up", "down"]
    assert [r.v for r in rows] == [True, True, False, False]


def test_keep_one_and_duplicates(spark):
    df = spark.createDataFrame([("A", 1, 1, 10.0), ("A", 1, 2, 11.0), ("A", 2, 1, None)], "symbol string, open_time bigint, seq int, close double")
    last = {(r.open_time): r.close for r in O.keep_one(df, ["symbol", "open_time"], ["seq"]).collect()}
    first = {(r.open_time): r.close for r in O.keep_one(df, ["symbol", "open_time"], ["seq"], last=False).collect()}
    assert last == {1: 11.0, 2: None} and first == {1: 10.0, 2: None}
    assert O.duplicate_keys(df).first().duplicates == 1


def test_completeness_and_gaps(spark):
    step = 900_000
    df = spark.createDataFrame([("A", i * step) for i in (0, 1, 2, 5, 6)], "symbol string, open_time bigint")
    row = O.completeness(df, step).first()
    assert (row.expected, row.actual, row.difference) == (7, 5, 2)
    gap = O.gaps(df, step).collect()
    assert [(g.open_time // step, g.missing_bars) for g in gap] == [(5, 2)]


def test_quality_report(spark):
    df = spark.createDataFrame([("A", 1.0, 2.0, 0.5, 1.5, 1.0), (None, -1.0, 1.0, 2.0, None, 0.0)], "symbol string, open double, high double, low double, close double, volume double")
    row = O.quality_report(df).first()
    assert (row.rows, row.null_symbol, row.null_close, row.negative_open, row.high_below_low, row.close_outside, row.volume_not_positive) == (2, 1, 1, 1, 1, 0, 1)


def test_incremental_rows(spark):
    ddl = "symbol string, open_time bigint"
    stored = spark.createDataFrame([("A", 10), ("A", 20)], ddl)
    fresh = spark.createDataFrame([("A", 20), ("A", 30), ("A", 30), ("B", 5), ("B", 95)], ddl)
    got = sorted(tuple(r) for r in O.new_rows(fresh, stored, now_ms=100, lookback_ms=10).collect())
    assert got == [("A", 30), ("B", 95)]


def test_best_interval(spark):
    df = spark.createDataFrame([("1m", i) for i in range(3)] + [("5m", i) for i in range(5)] + [("1h", i) for i in range(4)], "interval string, x int")
    pick = lambda target: O.best_interval(df, ["1m", "5m", "1h"], target).first().interval
    assert pick(4) == "5m" and pick(3) == "1m" and pick(100) == "5m"


def test_volume_series(spark):
    df = spark.createDataFrame([("B", "2024-01-01 10:00:00", 1.0, 2.0, 100.0), ("B", "2024-01-01 10:15:00", 2.0, 1.0, 150.0)], "symbol string, close_datetime string, open double, close double, volume double")
    rows = series.volume_series(df).collect()
    assert [(r.volume_up, r.volume_down, r.mean_volume) for r in rows] == [(100.0, None, 125.0), (None, 150.0, 125.0)]


def test_live_payload(spark):
    good = '{"data": [{"symbol": "BTC", "close_datetime": "2024-01-01T10:00:00Z", "close": 1.5}, {"symbol": "BTC", "close_datetime": "2024-01-01T10:00:00Z", "close": 2.5}, {"symbol": "BTC", "close_datetime": "bad", "close": 9}]}'
    rows = [(1, good), (2, None), (3, "{oops"), (4, '{"error": "down"}'), (5, '{"data": []}'), (6, '{"data": {"a": 1}}'), (7, "[1, 2]")]
    df = spark.createDataFrame(rows, "seq bigint, data string")
    status = {r.seq: r.status for r in parse.decode_live(df).collect()}
    assert status == {
        1: "WebSocket connected",
        2: "WebSocket payload missing data field",
        3: "Invalid WebSocket payload",
        4: "WebSocket error: down",
        5: "No realtime data received",
        6: "Invalid WebSocket data format",
        7: "Unexpected WebSocket payload format",
    }
    live = series.live_series(df).collect()
    assert [(r.symbol, r.close, str(r.close_datetime)) for r in live] == [("BTC", 2.5, "2024-01-01 11:00:00")]
    bad = {(r.seq, r.pos): r.status for r in series.unusable_live(df).collect()}
    assert bad.pop((1, 2)) == "row without a readable close time"
    assert {seq for seq, _ in bad} == set(range(2, 8)) and all(bad.values())
