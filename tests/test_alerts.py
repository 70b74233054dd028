"""Alert rules: firing, cooldown, minimum move, fallback prices, texts."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketspark.functions import text as X
from marketspark.operators import alerts as A
from marketspark.schemas import QUOTE_DDL, RULE_DDL

RULES = [("BTC/USDT", "binance", 70000.0, "above", None), ("ETH/USDT", "kraken", 4000.0, "below", None)]
START = dt.datetime(2024, 1, 1)


def quote(minutes, price, symbol="BTC/USDT", exchange="binance", seq=0):
    return (symbol, exchange, START + dt.timedelta(minutes=minutes), seq, float(price), 1.0)


@pytest.fixture(scope="module")
def rules(spark):
    return spark.createDataFrame(RULES, RULE_DDL)


def fired(spark, rules, quotes, **kw):
    out = A.replay(spark.createDataFrame(quotes, QUOTE_DDL), rules, **kw).collect()
    return sorted((r.symbol, r.condition, int((r.ts - START).total_seconds() // 60), r.price) for r in out)


def test_fires_above_and_below(spark, rules):
    got = fired(spark, rules, [quote(0, 71000), quote(0, 3500, "ETH/USDT", "kraken")])
    assert got == [("BTC/USDT", "above", 0, 71000.0), ("ETH/USDT", "below", 0, 3500.0)]


def test_nothing_within_threshold(spark, rules):
    quotes = [quote(0, 65000), quote(1, 70000), quote(0, 4500, "ETH/USDT", "kraken"), quote(0, 99999, "BTC/USDT", "kraken")]
    assert fired(spark, rules, quotes) == []


def test_cooldown_and_minimum_move(spark, rules):
    quotes = [quote(0, 71000), quote(1, 72000), quote(59, 80000), quote(61, 71050), quote(62, 71100), quote(63, 71200), quote(124, 71300)]
    assert [f[2] for f in fired(spark, rules, quotes)] == [0, 63]
    assert [f[2] for f in fired(spark, rules, quotes, min_move=99.0)] == [0, 62, 124]
    assert [f[2] for f in fired(spark, rules, quotes, cooldown_seconds=0)] == [0, 1, 59, 61, 63]


def test_exactly_one_hour_is_enough(spark, rules):
    assert [f[2] for f in fired(spark, rules, [quote(0, 71000), quote(60, 72000)])] == [0, 60]


@pytest.mark.parametrize("part_seconds", [None, 4 * 3600, 20 * 3600])
def test_parts_do_not_change_the_result(spark, rules, part_seconds):
    rng = np.random.default_rng(4)
    minutes = np.sort(rng.integers(0, 4000, 600))
    prices = 70000 + np.abs(rng.normal(0, 150, 600).cumsum())
    quotes = [quote(int(m), round(p, 2), seq=i) for i, (m, p) in enumerate(zip(minutes, prices))]
    want, last = [], None
    for _, _, ts, _, price, _ in quotes:  # the rule, literally
        minute = int((ts - START).total_seconds() // 60)
        if price > 70000 and (last is None or (minute - last[0] >= 60 and abs(price - last[1]) > 100)):
            last = (minute, price)
            want.append(last)
    assert len(want) > 5
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(key)
    spark.conf.set(key, "16")  # a part arrives in many batches
    try:
        got = [f[2:] for f in fired(spark, rules, quotes, part_seconds=part_seconds)]
    finally:
        spark.conf.set(key, usual)
    assert got == want


def literal(prices, cooldown, min_move, entry=(None, None)):
    """The firing rule, one crossing (time, price) after another."""
    (at, last), fires = entry, []
    for now, price in prices:
        if at is None or (now - at >= cooldown and abs(price - last) > min_move):
            at, last = now, price
            fires.append((now, price))
    return fires


@pytest.mark.parametrize("cooldown,part_seconds", [(3600, None), (900, 5 * 3600), (0, 6 * 3600)])
def test_crowded_parts_are_searched(spark, rules, cooldown, part_seconds):
    """Parts beyond ``part_rows`` rows, beside calm ones: same fires as one crossing after another."""
    rng = np.random.default_rng(11)
    minutes = np.sort(np.concatenate([rng.integers(600, 1200, 300), rng.integers(0, 3000, 40)]))
    prices = np.round(70001 + np.abs(rng.normal(0, 40, len(minutes)).cumsum()), 2)
    tape = [quote(int(m), p, seq=i) for i, (m, p) in enumerate(zip(minutes, prices))]
    want = literal([(60 * int(m), float(p)) for m, p in zip(minutes, prices)], cooldown, 100.0)
    got = [(60 * f[2], f[3]) for f in fired(spark, rules, tape, cooldown_seconds=cooldown, part_seconds=part_seconds, part_rows=60)]
    assert len(want) > 3 and got == sorted(want)


def test_crowded_parts_begin_from_the_entry(spark, rules):
    tape = spark.createDataFrame([quote(i, 71000 + 3 * i, seq=i) for i in range(200)], QUOTE_DDL)
    entry = spark.createDataFrame([("BTC/USDT", "binance", 70000.0, "above", int(START.replace(tzinfo=dt.timezone.utc).timestamp() - 600) * 1_000_000, 71200.0)], "symbol string, exchange string, threshold double, condition string, at bigint, price double")
    want = literal([(60 * i, 71000.0 + 3 * i) for i in range(200)], 3600, 100.0, (-600, 71200.0))
    out = A.replay(tape, rules, part_rows=20, entry=entry).orderBy("seq").collect()
    assert [(60 * r.seq, r.price) for r in out] == want and len(want) > 1


def test_a_rule_with_a_million_crossings_in_an_hour(spark, rules):
    """One part of one rule over eight tasks: each hands on one row a round, none is sorted or sent to Python."""
    tape = spark.range(0, 1_000_000, 1, 8).select(
        F.lit("BTC/USDT").alias("symbol"), F.lit("binance").alias("exchange"), F.timestamp_micros(F.col("id") * 3600 + 1_704_067_200_000_000).alias("ts"),
        F.col("id").alias("seq"), (70001 + F.pmod(F.col("id") * 7919, F.lit(1000))).cast("double").alias("price"), F.lit(1.0).alias("volume"),
    )
    ids = np.arange(1_000_000)
    at, price = ids * 3600, 70001.0 + ids * 7919 % 1000
    for cooldown in (3600, 450):
        want = A.fire(at, price, None, None, cooldown * 1_000_000, 100.0)[0]
        got = [r.seq for r in A.replay(tape, rules, cooldown_seconds=cooldown, part_rows=1000).orderBy("seq").collect()]
        assert got == want
    rows = A.crossings(tape, rules).withColumn("_part", F.lit(0).cast("bigint"))
    keys = [*A.RULE_KEY, "_part"]
    none = {c: F.lit(None).cast(t) for c, t in (("_in_at", "bigint"), ("_in_price", "double"), ("_last_at", "bigint"), ("_last_seq", "bigint"), ("_last_price", "double"))}
    state = rules.filter("symbol = 'BTC/USDT'").select(*A.RULE_KEY, F.lit(0).cast("bigint").alias("_part")).withColumns(none)
    step = A.next_fires(rows, state, keys, 3_600_000_000, 100.0)
    plan = step._jdf.queryExecution().executedPlan().toString()
    before = plan[plan.index("Exchange hashpartitioning"):]
    assert "partial_min_by" in before and "Pandas" not in plan and "SortAggregate" not in plan
    assert [r.seq for r in step.collect()] == [0]


def test_part_width_is_measured(spark, rules):
    rows = A.crossings(spark.createDataFrame([quote(i, 71000 + i) for i in range(200)], QUOTE_DDL), rules)
    assert A._part_width(rows, 1000, 0) == 0
    width = A._part_width(rows, 20, 0)
    assert rows.groupBy("symbol", F.expr(f"_at div {width}L")).count().agg(F.max("count")).first()[0] <= 21
    assert A._part_width(rows, 20, 3_600_000_000) == 8 * 3_600_000_000


def test_unknown_condition_never_fires(spark):
    odd = spark.createDataFrame([("BTC/USDT", "binance", 1.0, "sideways", None)], RULE_DDL)
    assert A.replay(spark.createDataFrame([quote(0, 5)], QUOTE_DDL), odd).count() == 0


def test_latest_quotes_and_fallback(spark):
    tape = [quote(0, 1), quote(5, 2, seq=1), quote(5, 3, seq=2), quote(0, 65000, exchange="kraken"), quote(0, 9, "ETH/USDT", "bybit")]
    latest = A.latest_quotes(spark.createDataFrame(tape, QUOTE_DDL))
    assert {(r.exchange, r.symbol): r.price for r in latest.collect()}[("binance", "BTC/USDT")] == 3.0
    rules = spark.createDataFrame(
        [("BTC/USDT", "bitmex", 1.0, "above", ["binance", "kraken"]), ("BTC/USDT", "bitmex", 2.0, "below", None), ("BTC/USDT", "kraken", 1.0, "above", None), ("ETH/USDT", "okx", 1.0, "above", ["bitmex"])],
        RULE_DDL,
    )
    got = sorted((r.exchange, r.symbol, len(r.fallback_exchanges), r.price, r.source) for r in A.fallback_prices(rules, latest).collect())
    assert got == [("bitmex", "BTC/USDT", 2, 3.0, "binance"), ("bitmex", "BTC/USDT", 3, 3.0, "binance"), ("kraken", "BTC/USDT", 3, 65000.0, "kraken")]


def test_price_expires(spark):
    quotes = spark.createDataFrame([("x", START, 1, 7.0)], "exchange string, ts timestamp, seq bigint, price double")
    probes = spark.createDataFrame([("x", START + dt.timedelta(seconds=s), s) for s in (0, 4, 5)], "exchange string, ts timestamp, probe int")
    got = {r.probe: r.price for r in A.fresh_price(probes, quotes, ["exchange"]).collect()}
    assert got == {0: 7.0, 4: 7.0, 5: None}


def test_texts(spark):
    df = spark.createDataFrame([("BTC/USDT", "binance", 75000.0, 70000.0, "above", START)], "s string, e string, p double, t double, c string, at timestamp")
    text = df.select(X.alert_text(*[F.col(c) for c in ("s", "e", "p", "t", "c", "at")]).alias("m")).first().m
    assert text == "*Price Alert!*\nSymbol: `BTC/USDT`\nExchange: `binance`\nCurrent: `$75,000.00`\nThreshold: `$70,000.00` (above)\nTime: 2024-01-01 00:00:00 UTC"
    add = df.select(
        X.with_sentiment(F.lit("m"), F.lit("mistral"), F.lit("bullish"), F.lit(0.5)).alias("a"),
        X.with_pattern(F.lit("m"), F.lit(2)).alias("b"),
        X.with_pattern(F.lit("m"), F.lit(7)).alias("c"),
        X.with_pattern(F.lit("m"), F.lit(-1)).alias("d"),
        X.with_pattern(F.lit("m"), F.lit(None).cast("int")).alias("e"),
    ).first()
    assert add.a == "m\n\n *Sentiment (mistral):* bullish (0.50)"
    assert add.b == "m\n\n *Pattern:* Range consolidation (cluster 2)" and add.c == "m\n\n *Pattern:* Pattern 7 (cluster 7)"
    assert add.d == add.e == "m"


def test_message_hygiene(spark):
    df = spark.createDataFrame([("",), ("  \n\t",), ("\u00a0\x1c",), (None,), ("x" * 5000,), ("ok",)], "m string")
    rows = df.filter(X.is_sendable(F.col("m"))).select(F.posexplode(X.parts(F.col("m"))).alias("part", "m")).collect()
    assert sorted((r.part, len(r.m)) for r in rows) == [(0, 2), (0, 4096), (1, 904)]
