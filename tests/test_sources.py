"""Readers and writers."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThan

from marketspark.operators import candles as O
from marketspark.schemas import CANDLE_DDL, SENTIMENT_DDL
from marketspark.session import checkpoint_root, clean, new_path
from marketspark.sources import paged, tables
from marketspark.streaming import ingest as SI

STEP = 900_000
FEED = "marketspark.sources.paged:from_table"


def candle(symbol, i, close=1.0):
    t = i * STEP
    return (symbol, t, 1.0, 2.0, 0.5, close, 10.0, t + STEP - 1, 10.0, 5, 4.0, 4.0)


def test_candle_pages(spark):
    page = '[[1704067200000,"12.5","13","12.25","12.75","640",1704067259999,"8100",31,"300","3800","0"],[1,"x","2","1","2","3",4,"5",6,"7","8","0"]]'
    rows = tables.parse_candle_pages(spark.createDataFrame([("XYZEUR", page)], "symbol string, value string")).collect()
    assert tuple(rows[0]) == ("XYZEUR", 1704067200000, 12.5, 13.0, 12.25, 12.75, 640.0, 1704067259999, 8100.0, 31, 300.0, 3800.0)
    assert rows[1].open is None and rows[1].high == 2.0
    assert rows[0].asDict().keys() == dict(x.strip().split(" ") for x in CANDLE_DDL.split(",")).keys()


def test_paged_read_until_caught_up(spark, tmp_path):
    rows = [candle("A", i) for i in range(2500)] + [candle("B", i) for i in range(10)]
    path = str(tmp_path / "feed")
    spark.createDataFrame(rows, CANDLE_DDL).write.parquet(path)
    end = 2499 * STEP
    for pages in (1, 2, 10):
        df = paged.read_paged(spark, "marketspark.sources.paged:from_table", ["A", "B"], 0, end, "15m", pages, store=path)
        got = {r.symbol: r["count"] for r in df.groupBy("symbol").count().collect()}
        assert got == {"A": 2500, "B": 10}
        assert df.select("symbol", "open_time").distinct().count() == 2510
    later = paged.read_paged(spark, "marketspark.sources.paged:from_table", ["A"], 2000 * STEP + 1, end, store=path)
    assert later.count() == 499
    assert paged.months_back(1_000_000_000_000, 6) == 1_000_000_000_000 - 180 * 86_400_000


def test_conditions_reach_the_paged_service(spark, tmp_path):
    rows = [candle(s, i) for s in "ABC" for i in range(3000) if not 500 <= i < 2600]
    path, names = str(tmp_path / "feed"), str(tmp_path / "names")
    spark.createDataFrame(rows, CANDLE_DDL).write.parquet(path)
    spark.createDataFrame([("A",), ("B",), ("C",), ("B",), (None,)], "symbol string").write.parquet(names)
    options = {"transport": FEED, "instruments": names, "start": "0", "end": str(3000 * STEP), "pages": "1"}

    def asked(*conditions):
        reader = paged.PagedReader(options)
        assert list(reader.pushFilters(list(conditions))) == list(conditions)
        return [(s.symbol, s.start // STEP, s.end // STEP) for s in reader.partitions()]

    assert len(asked()) == 12
    assert asked(EqualTo(("symbol",), "B"), GreaterThan(("open_time",), 2500 * STEP - 1), LessThan(("open_time",), 2700 * STEP)) == [("B", 2500, 2699)]
    assert asked(In(("symbol",), ("A", "C", "none")), In(("symbol",), ("C", "B")), EqualTo(("open_time",), 7 * STEP)) == [("C", 7, 7)]
    assert asked(EqualTo(("symbol",), "none")) == [] and asked(GreaterThan(("close",), 1.0)) == asked()
    df = paged.read_paged(spark, FEED, names, 0, 3000 * STEP, pages=1, store=path)
    assert df.count() == 2700  # over the gap
    some = df.filter((F.col("symbol") == "B") & (F.col("open_time") > 2590 * STEP))
    assert some.rdd.getNumPartitions() == 1 and some.count() == 400
    assert df.filter("symbol = 'none'").count() == 0


def test_instruments_resume_where_they_stand(spark, tmp_path):
    rows = [candle(s, i) for s in "ABC" for i in range(1500)]
    path = str(tmp_path / "feed")
    spark.createDataFrame(rows, CANDLE_DDL).write.parquet(path)
    stored = spark.createDataFrame([candle("A", i) for i in range(1200)] + [candle("B", i) for i in range(1500)], CANDLE_DDL)
    names = spark.createDataFrame([("A",), ("B",), ("C",), ("D",), (None,)], "symbol string")
    lacking = paged.resumed(names, stored, 100 * STEP, 1499 * STEP)
    for pages, tasks in ((1, None), (10, 1)):
        got = paged.read_instruments(lacking, FEED, "15m", pages, tasks, store=path)
        assert {r.symbol: (r.n, r.a // STEP) for r in got.groupBy("symbol").agg(F.count("*").alias("n"), F.min("open_time").alias("a")).collect()} == {"A": (300, 1200), "C": (1400, 100)}
    assert paged.read_instruments(lacking.limit(0), FEED, store=path).count() == 0


def test_paged_stream_goes_on_per_instrument(spark, tmp_path):
    rows = [candle(s, i) for s in "AB" for i in range(30)]
    path, names, table, state = (str(tmp_path / n) for n in ("feed", "names", "table", "state"))
    spark.createDataFrame(rows, CANDLE_DDL).write.parquet(path)

    def load(symbols, end):
        spark.createDataFrame([(s,) for s in symbols], "symbol string").write.mode("overwrite").parquet(names)
        stream = paged.stream_paged(spark, FEED, names, 0, end * STEP, pages=1, store=path)
        SI.start_append(stream, table, state).awaitTermination()
        return sorted((r.symbol, r["count"]) for r in spark.read.schema(CANDLE_DDL).parquet(table).groupBy("symbol").count().collect())

    assert load("A", 9) == [("A", 10)]
    assert load("A", 9) == [("A", 10)]
    assert load("AB", 29) == [("A", 30), ("B", 30)]  # A from 10, B from the start


def test_rules_file_and_defaults(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps([{"symbol": "A", "threshold": 1.0, "condition": "above"}, {"symbol": "B", "exchange": "kraken", "threshold": 2, "condition": "below", "fallback_exchanges": ["x", "y"]}], indent=1))
    rows = tables.read_rules(spark, str(path)).orderBy("symbol").collect()
    assert [(r.symbol, r.exchange, r.threshold, r.fallback_exchanges) for r in rows] == [("A", "binance", 1.0, None), ("B", "kraken", 2.0, ["x", "y"])]
    assert tables.read_rules(spark, str(tmp_path / "absent.json")).count() == 2


def test_candle_table_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "candles")
    day = 96
    rows = spark.createDataFrame([candle("A", i) for i in range(2 * day)] + [candle("B", 1)], CANDLE_DDL)
    tables.write_candles(rows, path, whole=True)
    again = spark.createDataFrame([candle("A", i, 9.0) for i in range(day)] * 2, CANDLE_DDL)
    tables.write_candles(again, path)
    out = tables.read_candles(spark, path)
    assert out.count() == 2 * day + 1
    assert out.filter("close = 9.0").count() == day
    plan = O.in_open_range(out, day * STEP)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(open_date" in plan  # whole days are pruned
    tables.write_candles(rows.limit(5), path, whole=True)
    assert tables.read_candles(spark, path).count() == 5


def test_sentiment_append_and_retention(spark, tmp_path):
    path = str(tmp_path / "s")
    at = dt.datetime(2024, 1, 1)
    row = (at, "A", "bullish", 0.5, "t", "p", 1.0, "e", {"k": "v"})
    df = spark.createDataFrame([row], SENTIMENT_DDL)
    tables.append_sentiment(df, path)
    tables.append_sentiment(df, path)
    tables.append_sentiment(df.limit(0), path)
    out = spark.read.parquet(path)
    assert out.count() == 2 and out.first().metadata == {"k": "v"}
    now = lambda seconds: F.lit(at + dt.timedelta(seconds=seconds))
    assert tables.retained(out, now(100), 101).count() == 2 and tables.retained(out, now(100), 100).count() == 0


def test_tickers_copy_json(spark, tmp_path):
    df = spark.createDataFrame([("A", 1.5), ("B", 2.5)], "symbol string, price double")
    tables.write_json(df, str(tmp_path / "t"))
    assert [tuple(r) for r in tables.read_tickers(spark, str(tmp_path / "t"), ["B"]).collect()] == [("B", 2.5)]
    assert tables.read_tickers(spark, str(tmp_path / "t")).count() == 2
    df.write.parquet(str(tmp_path / "p"))
    tables.copy_table(spark, str(tmp_path / "p"), str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q")).count() == 2


def test_shared_folder_is_kept(spark):
    root = checkpoint_root(spark)
    assert root == checkpoint_root(spark)
    assert new_path(spark, "x") != new_path(spark, "x")
    assert new_path(spark, "x").startswith(root)


def test_training_rows(spark):
    df = spark.createDataFrame([candle("BTCUSDT", i, float(i)) for i in range(20)], CANDLE_DDL)
    got = [r.close for r in O.training_rows(df, "btc/usdt", 3).collect()]
    assert got == [17.0, 18.0, 19.0]
    stamped = df.withColumn("timestamp", F.timestamp_millis("open_time"))
    hole = stamped.withColumn("timestamp", F.when(F.col("close") != 19.0, F.col("timestamp"))).withColumn("open_time", F.lit(None).cast("timestamp"))
    assert [r.close for r in O.training_rows(hole, "BTCUSDT", 2).collect()] == [17.0, 18.0]


@pytest.mark.parametrize("text", ["[1, 2", '[{"symbol": "A", "threshold": "much", "condition": "above"}]', '[{"symbol": "A", "condition": "above"}]', '[{"threshold": 1, "condition": "above"}]'])
def test_broken_rules_are_an_error(spark, tmp_path, text):
    bad = tmp_path / "bad.json"
    bad.write_text(text)
    with pytest.raises(Exception):
        tables.read_rules(spark, str(bad)).collect()


def test_a_load_inside_a_day_keeps_the_stored_part(spark, tmp_path):
    path = str(tmp_path / "candles")
    bars = spark.createDataFrame([candle(s, i, float(i)) for s in "AB" for i in range(150)], CANDLE_DDL)
    tables.write_candles(bars.filter(F.col("open_time") <= 40 * STEP), path, whole=True)  # the first day ends at bar 95
    for _ in range(2):
        tables.write_candles(O.new_rows(bars, tables.read_candles(spark, path), 149 * STEP), path)
        got = sorted((r.symbol, r.open_time, r.close) for r in tables.read_candles(spark, path).collect())
        assert got == sorted((s, i * STEP, float(i)) for s in "AB" for i in range(150))
    tables.write_candles(spark.createDataFrame([candle("A", 3, 777.0)], CANDLE_DDL), path)
    out = tables.read_candles(spark, path)
    assert out.count() == 300 and [r.symbol for r in out.filter("close = 777").collect()] == ["A"]
    tables.write_candles(bars.limit(3), str(tmp_path / "fresh"))  # a load into nothing makes the table
    assert tables.read_candles(spark, str(tmp_path / "fresh")).count() == 3


def test_expired_days_are_removed(spark, tmp_path):
    path = str(tmp_path / "s")
    for day in (1, 2, 5):
        row = (dt.datetime(2024, 1, day, 12), "A", "bullish", 0.5, "t", "p", 1.0, "e", None)
        tables.append_sentiment(spark.createDataFrame([row], SENTIMENT_DDL), path, f"load-{day}")
    assert tables.drop_expired(spark, path, dt.date(2024, 1, 6), 4) == 1
    assert sorted(r.timestamp.day for r in spark.read.parquet(path).collect()) == [2, 5]
    again = (dt.datetime(2024, 1, 5, 13), "A", "bearish", 0.5, "t", "p", 1.0, "e", None)
    tables.append_sentiment(spark.createDataFrame([again], SENTIMENT_DDL), path, "load-5")  # a repeated load replaces itself
    assert spark.read.parquet(path).count() == 2


def test_hand_over_tables_can_be_removed(spark):
    path = new_path(spark, "mine")
    spark.range(3).write.parquet(path)
    assert os.path.isdir(path) and clean(spark) >= 1 and not os.path.exists(path)


def test_clusters_must_name_a_shared_folder():
    class Context:
        master = "spark://host:7077"
        getConf = lambda self: {}

        class _jsc:
            sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})())

    class Session:
        conf = {}
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_root(Session())


def test_one_row_per_key_needs_no_sort(spark):
    rows = spark.createDataFrame([candle("A", i % 3, float(i)) for i in range(9)], CANDLE_DDL).withColumn("seq", F.col("close").cast("bigint"))
    out = O.keep_one(rows, ["symbol", "open_time"], ["seq"])
    assert sorted(r.close for r in out.collect()) == [6.0, 7.0, 8.0]
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
