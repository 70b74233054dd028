"""Streams: restarts, broken input, state, late data; stream equals batch."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketspark.operators import alerts as A
from marketspark.schemas import QUOTE_DDL, RULE_DDL
from marketspark.operators import indicators as I
from marketspark.operators.candles import build_candles, last_bars
from marketspark.operators.features import FEATURES
from marketspark.operators.patterns import Embedder, detect
from marketspark.schemas import CANDLE_DDL
from marketspark.streaming import alerts as SA
from marketspark.streaming import compaction as SC
from marketspark.streaming import indicators as SN
from marketspark.streaming import ingest as SI
from marketspark.streaming import regimes as SR

START = dt.datetime(2024, 1, 1)


def message(i=0, closed=True, **changes):
    k = {"t": 1704067200000 + 60000 * i, "T": 1704067260000 + 60000 * i, "o": "800", "c": "804", "h": "812", "l": "796", "v": "2.25", "q": "1810", "n": 37, "V": "1.25", "Q": "1005", "x": closed}
    body = {"e": "kline", "s": "ADAEUR", "k": k | changes}
    return json.dumps(body)


def drop(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines))


def test_ingest_restarts_and_sets_bad_messages_aside(spark, tmp_path):
    feed, table, aside, state = (tmp_path / n for n in ("feed", "table", "aside", "state"))
    no_symbol = json.dumps({"e": "kline", "k": {"x": True}})
    drop(feed, "1.txt", [message(0), message(1, closed=False), "not json", message(2, o="0"), no_symbol, message(3, c="oops")])

    def run():
        SI.start_ingest(SI.read_messages(spark, str(feed)), str(table), str(aside), str(state)).awaitTermination()
        return spark.read.parquet(str(table)), [r.value for r in spark.read.text(str(aside)).collect()]

    rows, bad = run()
    first = rows.orderBy("open_time").first()
    assert rows.count() == 2
    assert (first.symbol, first.price_change, first.price_change_pct, first.high_low_spread, first.high_low_spread_pct, first.is_closed) == ("ADAEUR", 4.0, 0.5, 16.0, 2.0101, True)
    assert str(first.open_datetime) == "2024-01-01 00:00:00" and first.num_trades == 37 and first.ts is not None
    assert rows.orderBy(F.desc("open_time")).first().price_change_pct == 0.0
    assert len(bad) == 3 and "not json" in bad
    drop(feed, "2.txt", [message(9)])
    rows, bad = run()  # a restart reads only what is new
    assert rows.count() == 3 and len(bad) == 3


def test_repeats_are_dropped_across_batches(spark, tmp_path):
    feed, table, state = (tmp_path / n for n in ("feed", "table", "state"))
    drop(feed, "1.txt", [message(0), message(0), message(1)])

    def run():
        rows = SI.without_repeats(SI.candles_from(SI.read_messages(spark, str(feed))))
        SI.start_append(rows, str(table), str(state)).awaitTermination()
        return spark.read.parquet(str(table)).count()

    assert run() == 2
    drop(feed, "2.txt", [message(1), message(2)])
    assert run() == 3


def test_views(spark, tmp_path):
    feed, view, latest, s1, s2 = (tmp_path / n for n in ("feed", "view", "latest", "s1", "s2"))
    now = lambda: F.lit("2024-01-01 01:30:00").cast("timestamp")

    def run():
        SI.start_rolling_view(SI.read_messages(spark, str(feed)), str(view), str(s1), now, availableNow=True).awaitTermination()
        SI.start_latest_view(SI.read_messages(spark, str(feed), arrival=True), str(latest), str(s2), availableNow=True).awaitTermination()
        out = []
        for path in (view, latest):
            rows = spark.read.parquet(str(path))
            out.append(rows.filter(F.col("batch") == rows.agg(F.max("batch")).first()[0]))
        return out

    drop(feed, "1.txt", [message(i) for i in range(0, 60, 10)])
    rolling, frame = run()
    assert rolling.count() == 3 and frame.count() == 6  # closed 00:31, 00:41, 00:51
    drop(feed, "2.txt", [message(70, c="1"), message(70, c="2")])
    rolling, frame = run()
    assert rolling.count() == 5  # an earlier candle and both copies of the new one
    assert frame.count() == 1 and frame.first().close == 2.0  # the symbol's frame was replaced, by the last copy
    drop(feed, "3.txt", [message(80)])
    run()
    assert sorted(p.name for p in view.glob("batch=*")) == ["batch=1", "batch=2"]  # older copies are gone


def quotes_in_time(n=400, seed=6):
    rng = np.random.default_rng(seed)
    minutes = np.sort(rng.choice(20_000, n, replace=False))
    prices = 70000 + np.abs(rng.normal(0, 150, n).cumsum())
    keys = [("BTC/USDT", "binance"), ("BTC/USDT", "kraken")]
    return [(*keys[i % 2], START + dt.timedelta(minutes=int(m)), i, round(float(p), 2), 1.0) for i, (m, p) in enumerate(zip(minutes, prices))]


def test_alert_stream_equals_replay(spark, tmp_path):
    rules = spark.createDataFrame([("BTC/USDT", "binance", 70100.0, "above", None), ("BTC/USDT", "kraken", 70900.0, "below", None), ("BTC/USDT", "kraken", 70050.0, "above", None)], RULE_DDL)
    tape = quotes_in_time()
    feed, table, held, state = (str(tmp_path / n) for n in ("feed", "table", "held", "state"))
    for part in (tape[:150], tape[150:160], tape[160:]):  # three runs, the last fires handed on
        spark.createDataFrame(part, QUOTE_DDL).coalesce(1).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(QUOTE_DDL).parquet(feed)
        SA.start_alerts(stream, rules, table, held, state).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(table).select(*A.RULE_KEY, "seq").collect())
    want = sorted(tuple(r) for r in A.replay(spark.createDataFrame(tape, QUOTE_DDL), rules).select(*A.RULE_KEY, "seq").collect())
    assert got == want and len(want) > 5


def test_late_ticks_are_dropped(spark, tmp_path):
    feed, table, state = (str(tmp_path / n) for n in ("feed", "table", "state"))

    def add(minutes):
        rows = [("A", "x", START + dt.timedelta(minutes=m), m, float(m), 1.0) for m in minutes]
        spark.createDataFrame(rows, QUOTE_DDL).coalesce(1).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(QUOTE_DDL).parquet(feed)
        SI.start_append(SI.candles_from_ticks(stream), table, state).awaitTermination()
        return {r.ts.hour: (r.open, r.close, r.num_trades) for r in spark.read.parquet(table).collect()}

    assert add([1, 5, 59, 61]) == {}
    assert add([55, 75]) == {0: (1.0, 59.0, 4)}  # within ten minutes of the watermark's hour
    assert add([2, 200]) == {0: (1.0, 59.0, 4), 1: (61.0, 75.0, 2)}  # minute 2 came too late


def test_tick_candles_lose_nothing(spark, tmp_path):
    feed, table, state = (str(tmp_path / n) for n in ("feed", "table", "state"))

    def add(minutes):
        rows = [("A", "x", START + dt.timedelta(minutes=m), m, float(m), 1.0) for m in minutes]
        spark.createDataFrame(rows, QUOTE_DDL).coalesce(1).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(QUOTE_DDL).parquet(feed)
        SI.start_tick_candles(stream, table, state).awaitTermination()
        return {r.ts.hour: (r.open, r.high, r.low, r.close, r.volume, r.num_trades) for r in SI.read_tick_candles(spark, table).collect()}

    assert add([1, 5, 61]) == {0: (1.0, 5.0, 1.0, 5.0, 2.0, 2), 1: (61.0, 61.0, 61.0, 61.0, 1.0, 1)}
    assert add([200, 75]) == {0: (1.0, 5.0, 1.0, 5.0, 2.0, 2), 1: (61.0, 75.0, 61.0, 75.0, 2.0, 2), 3: (200.0, 200.0, 200.0, 200.0, 1.0, 1)}
    assert add([0, 59])[0] == (0.0, 59.0, 0.0, 59.0, 4.0, 4)  # both came hours late


def test_outbox_and_stored_sentiment(spark, tmp_path):
    rules = spark.createDataFrame([("BTC/USDT", "binance", 70000.0, "above", None)], RULE_DDL)
    feed, store, box, fired, held, state = (str(tmp_path / n) for n in ("feed", "store", "box", "fired", "held", "state"))
    spark.createDataFrame([("BTC/USDT", "binance", START, 1, 75000.0, 1.0)], QUOTE_DDL).write.parquet(feed)
    patterns = spark.createDataFrame([("binance", "BTC/USDT", 3), ("kraken", "BTC/USDT", 1)], "exchange string, symbol string, cluster_id int")
    stream = spark.readStream.schema(QUOTE_DDL).parquet(feed)
    make = lambda: lambda texts: [(["bearish", "bullish"], [0.2, 0.8])] * len(texts)
    SA.start_alert_cycle(stream, rules, patterns, make, store, box, fired, held, state, availableNow=True).awaitTermination()
    message = spark.read.parquet(box).first().message
    assert "$75,000.00" in message and "*Pattern:* Volatile spike (cluster 3)" in message
    assert message.endswith("*Sentiment (mistral):* bullish (0.80)")
    row = spark.read.parquet(store).first()
    assert (row.sentiment_label, row.confidence, row.price, row.provider) == ("bullish", 0.8, 75000.0, "mistral")
    assert row.metadata["all_labels"] == '["bearish","bullish"]' and row.metadata["alert_condition"] == "above"


def test_ring_of_bars_in_any_order(spark, tmp_path):
    """The ring after each batch is the newest bars of all quotes so far; only fired keys are detected, as in one batch."""
    rng = np.random.default_rng(6)
    tape = [(s, "x", START + dt.timedelta(seconds=int(t)), i, float(p), 1.0) for i, (s, t, p) in enumerate(zip(rng.choice(["A", "B", "C"], 900), rng.integers(0, 7200, 900), 100 + rng.normal(0, 1, 900).cumsum()))]
    tape += [("D", "x", START, 900, 5.0, 1.0), (None, None, START, 901, 6.0, None), ("A", "x", None, 902, 7.0, 1.0)]
    model = Embedder(FEATURES, [0.0] * 18, [1.0] * 18, [[1.0] + [0.0] * 17], [1.0])
    centroids = [[90.0], [110.0]]
    ring = SR.RegimeRing(str(tmp_path / "ring"), model, centroids, bars=40)
    fires = spark.createDataFrame([("x", "A"), ("x", "B"), ("x", "D"), ("x", "none")], "exchange string, symbol string")
    order, seen = rng.permutation(len(tape)), []
    for number, part in enumerate(np.array_split(order, 3)):
        rows = [tape[i] for i in part]
        seen += rows
        found = ring(fires, spark.createDataFrame(rows, QUOTE_DDL), number)
        if number == 1:
            ring(fires, spark.createDataFrame(rows, QUOTE_DDL), number)  # a repeated batch changes nothing
        whole = build_candles(spark.createDataFrame(seen, QUOTE_DDL), ["exchange", "symbol"], 60).withColumn("open_time", F.unix_millis("ts"))
        names = ["exchange", "symbol", "open_time", "open", "high", "low", "close", "volume", "num_trades"]
        want = sorted(map(str, last_bars(whole, ["exchange", "symbol"], 40).select(*names).collect()))
        held = spark.read.schema(SR.RING_DDL).parquet(f"{ring.path}/ring/batch={number}")
        assert sorted(map(str, held.select(*names).collect())) == want
    same = detect(whole, model, centroids, n=40).filter("symbol in ('A', 'B', 'D')")
    pick = lambda df: sorted((r.symbol, r.bars, r.cluster_id, r.distance and round(r.distance, 6)) for r in df.collect())
    assert pick(found) == pick(same)
    assert [p[2] for p in pick(found)][2] == -1 and {p[2] for p in pick(found)[:2]} <= {0, 1}


def test_kafka_needs_its_connector(spark):
    with pytest.raises(Exception, match="(?i)kafka"):
        SI.read_topic(spark, "localhost:9092", "candles")


RULES = [("BTC/USDT", "binance", 70100.0, "above", None), ("BTC/USDT", "kraken", 70900.0, "below", None), ("BTC/USDT", "kraken", 70050.0, "above", None)]


@pytest.mark.parametrize("lateness_minutes", [20_000, 3_000])
def test_alerts_in_event_time(spark, tmp_path, lateness_minutes):
    """Quotes in shuffled files fire what the replay of all but the late ones fires."""
    rules = spark.createDataFrame(RULES, RULE_DDL)
    tape = quotes_in_time(300, 8)
    rng = np.random.default_rng(1)
    order = np.argsort(np.arange(len(tape)) + rng.uniform(-60, 60, len(tape)))
    feed, table, late, held, state = (str(tmp_path / n) for n in ("feed", "table", "late", "held", "state"))
    clock, in_time = None, []
    for part in np.array_split(order, 5):
        rows = [tape[i] for i in part]
        spark.createDataFrame(rows, QUOTE_DDL).coalesce(2).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(QUOTE_DDL).parquet(feed)
        SA.start_event_time_alerts(stream, rules, table, late, held, state, lateness_minutes * 60).awaitTermination()
        in_time += [r for r in rows if clock is None or r[2] > clock]
        newest = max(r[2] for r in rows) - dt.timedelta(minutes=lateness_minutes)
        clock = newest if clock is None else max(clock, newest)
    SA.finish_alerts(spark, table, late, held)
    got = sorted(tuple(r) for r in spark.read.parquet(table).select(*A.RULE_KEY, "seq").collect())
    want = sorted(tuple(r) for r in A.replay(spark.createDataFrame(in_time, QUOTE_DDL), rules).select(*A.RULE_KEY, "seq").collect())
    assert got == want and len(want) > 5
    missed = {r[3] for r in tape} - {r[3] for r in in_time}
    crossed = {r.seq for r in A.crossings(spark.createDataFrame(tape, QUOTE_DDL), rules).collect()}
    assert {r.seq for r in spark.read.parquet(late).select("seq").collect()} == missed & crossed
    assert (len(missed) > 5) == (lateness_minutes == 3_000)


def test_a_batch_without_crossings(spark, tmp_path):
    rules = spark.createDataFrame([("A", "x", 5.0, "above", None)], RULE_DDL)
    feed, table, late, held, state = (str(tmp_path / n) for n in ("feed", "table", "late", "held", "state"))
    for minute, price in ((0, 1.0), (90, 9.0), (200, 2.0)):
        spark.createDataFrame([("A", "x", START + dt.timedelta(minutes=minute), minute, price, 1.0)], QUOTE_DDL).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(QUOTE_DDL).parquet(feed)
        SA.start_event_time_alerts(stream, rules, table, late, held, state, 600).awaitTermination()
    assert [r.seq for r in spark.read.parquet(table).collect()] == [90]  # let out by the quote at minute 200


def bars_in_time(n, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for symbol in ("A", "B"):
        close = 100 + rng.normal(0, 1, n).cumsum()
        for i in range(n):
            low, high = close[i] - rng.uniform(0, 1), close[i] + rng.uniform(0, 1)
            t = 1704067200000 + 3_600_000 * (i + 7 * (symbol == "B"))
            rows.append((symbol, t, float(close[i]), float(high), float(low), float(close[i]), 1.0, t + 3_599_999, 1.0, 1, 1.0, 1.0))
    return sorted(rows, key=lambda r: r[1])


@pytest.mark.parametrize("cuts", [[100], [1, 2, 90, 300], [250, 251]])
def test_indicators_do_not_depend_on_batches(spark, tmp_path, cuts):
    rows = bars_in_time(220)
    feed, table, late, held, state = (str(tmp_path / n) for n in ("feed", "table", "late", "held", "state"))
    for part in np.split(np.arange(len(rows)), cuts):
        spark.createDataFrame([rows[i] for i in part], CANDLE_DDL).coalesce(1).write.mode("append").parquet(feed)
        SN.start_indicators(spark.readStream.schema(CANDLE_DDL).parquet(feed), table, late, held, state).awaitTermination()
    whole = spark.createDataFrame(rows, CANDLE_DDL)
    names = ["ema_9", "ema_21", "ema_50", "ema_200", "atr"]
    want = {(r.symbol, r.open_time): r for r in I.close_emas(whole).join(I.atr(whole).select("symbol", "open_time", "atr"), ["symbol", "open_time"]).collect()}
    got = spark.read.parquet(table).collect()
    assert len(got) == len(rows) and spark.read.parquet(late).count() == 0
    for r in got:
        for name in names:
            a, b = r[name], want[r.symbol, r.open_time][name]
            assert (a is None and b is None) or abs(a - b) < 1e-9, (r, name)


def test_late_candles_of_indicators(spark, tmp_path):
    rows = bars_in_time(12)
    feed, table, late, held, state = (str(tmp_path / n) for n in ("feed", "table", "late", "held", "state"))
    late_row = rows[4]
    for part in (rows[:4] + rows[5:10], [late_row] + rows[10:]):
        spark.createDataFrame(part, CANDLE_DDL).coalesce(1).write.mode("append").parquet(feed)
        SN.start_indicators(spark.readStream.schema(CANDLE_DDL).parquet(feed), table, late, held, state).awaitTermination()
    assert [(r.symbol, r.open_time) for r in spark.read.parquet(late).collect()] == [late_row[:2]]
    assert spark.read.parquet(table).count() == len(rows) - 1


def test_first_copies_stay_however_late_others_come(spark, tmp_path):
    feed, table, state = (tmp_path / n for n in ("feed", "table", "state"))

    def run():
        SI.start_unique_ingest(SI.read_messages(spark, str(feed), arrival=True), str(table), str(state)).awaitTermination()
        return sorted((r.open_time, r.close) for r in spark.read.parquet(str(table)).collect())

    at = lambda i: 1704067200000 + 60000 * i
    drop(feed, "1.txt", [message(0, c="1"), message(0, c="2"), message(5000, c="3")])
    assert run() == [(at(0), 1.0), (at(5000), 3.0)]
    drop(feed, "2.txt", [message(0, c="7"), message(1, c="4"), message(5000, c="8"), message(90_000, c="5")])
    want = [(at(0), 1.0), (at(1), 4.0), (at(5000), 3.0), (at(90_000), 5.0)]
    assert run() == want
    drop(feed, "3.txt", [message(0, c="9")])
    assert run() == want


def test_arrival_order_is_that_of_the_files(spark, tmp_path):
    feed, view, state = (tmp_path / n for n in ("feed", "view", "state"))
    drop(feed, "z.txt", [message(i % 3, c=str(i + 1)) for i in range(30)])
    drop(feed, "a.txt", [message(1, c="99")])
    import os

    os.utime(feed / "z.txt", (1_000_000_000, 1_000_000_000))  # the file with the later name is the older one
    SI.start_latest_view(SI.read_messages(spark, str(feed), arrival=True), str(view), str(state), availableNow=True).awaitTermination()
    assert sorted(r.close for r in spark.read.parquet(str(view)).collect()) == [28.0, 30.0, 99.0]
    with pytest.raises(ValueError):
        SI.arrival_order(spark.createDataFrame([("x",)], "value string"))


def test_compaction(spark, tmp_path):
    feed, table, packed, aside, state = (str(tmp_path / n) for n in ("feed", "table", "packed", "aside", "state"))

    def add(name, numbers):
        drop(tmp_path / "feed", name, [message(i) for i in numbers])
        SI.start_ingest(SI.read_messages(spark, feed), table, aside, state).awaitTermination()

    def rows():
        return sorted(r.open_time for r in SC.read_ingested(spark, table, packed).collect())

    def at(numbers):
        return sorted(1704067200000 + 60000 * i for i in numbers)

    add("1.txt", range(0, 3000, 7))
    assert rows() == at(range(0, 3000, 7)) and SC.compact(spark, table, packed) == 0  # one part a day
    add("2.txt", range(1, 3000, 7))
    before = SC.read_ingested(spark, table, packed)  # a reader that has begun
    both = at([*range(0, 3000, 7), *range(1, 3000, 7)])
    assert SC.compact(spark, table, packed, target_bytes=1 << 30) == 3 and rows() == both
    assert sorted(r.open_time for r in before.collect()) == both
    assert len(list((tmp_path / "packed").glob("open_date=*/upto=*/*.parquet"))) == 3  # a file a day
    add("3.txt", range(2, 1000, 7))  # later batches lie beside the packed parts
    three = sorted(both + at(range(2, 1000, 7)))
    assert rows() == three and SC.compact(spark, table, packed) == 0
    assert SC.compact(spark, table, packed, least_parts=1) == 1 and rows() == three
    assert SC.forget_packed(spark, table, packed) > 0 and rows() == three
    assert SC.read_ingested(spark, table, packed).columns == before.columns
    add("4.txt", [5])
    assert rows() == sorted(three + at([5]))


def test_a_file_grows_no_larger_than_asked(spark, tmp_path):
    table, packed = str(tmp_path / "table"), str(tmp_path / "packed")
    rows = spark.range(200_000).selectExpr("'A' AS symbol", "id * 400 AS open_time", "rand(1) AS close", "date'1970-01-01' AS open_date", "cast(id % 4 AS int) AS batch")
    rows.write.partitionBy("open_date", "batch").parquet(table)
    SC.compact(spark, table, packed, target_bytes=1 << 20)
    sizes = [p.stat().st_size for p in (tmp_path / "packed").glob("*/*/*.parquet")]
    assert 2 <= len(sizes) <= 4 and max(sizes) < 2 << 20 < sum(sizes)
    assert SC.read_ingested(spark, table, packed).count() == 200_000
