"""Sentiment analytics, records and classifiers."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketspark.functions import sentiment as S
from marketspark.operators import sentiment as O

DDL = "timestamp timestamp, symbol string, sentiment_label string, confidence double, price double, seq bigint"


def records(labels, prices=None, symbol="BTC/USDT", start=dt.datetime(2024, 1, 1), step=60):
    prices = prices or [65000.0 + 100 * i for i in range(len(labels))]
    return [(start + dt.timedelta(minutes=step * i), symbol, w, 0.5, float(p), i) for i, (w, p) in enumerate(zip(labels, prices))]


def test_one_bullish_among_neutral_is_an_anomaly(spark):
    rows = records(["neutral"] * 10 + ["bullish"]) + records(["neutral"] * 5, symbol="FLAT") + records(["bullish"], symbol="ONE")
    out = O.anomalies(spark.createDataFrame(rows, DDL)).collect()
    assert [(r.symbol, r.sentiment_label) for r in out] == [("BTC/USDT", "bullish")]
    assert out[0].z_score == pytest.approx(3.015, abs=1e-3)


def test_trend_directions(spark):
    rows = records(["neutral"] * 6 + ["bullish"]) + records(["bullish"] * 3 + ["odd"] * 3 + ["bearish"], [9, 8, 7, 6, 5, 4, 3], "DOWN")
    rows += records(["bullish"], symbol="ONE")
    out = {r.symbol: r for r in O.trend(spark.createDataFrame(rows, DDL)).collect()}
    btc, down, one = out["BTC/USDT"], out["DOWN"], out["ONE"]
    assert (btc.current_sentiment, btc.current_sentiment_score, btc.sentiment_trend, btc.price_trend, btc.data_points) == ("bullish", 1.0, "improving", "rising", 7)
    assert (down.sentiment_trend, down.price_trend) == ("neutral", "falling")  # unknown labels leave gaps
    assert (one.sentiment_trend, one.price_trend, one.current_price) == ("neutral", "neutral", 65000.0)


def test_moving_trend_equals_pandas(spark):
    rng = np.random.default_rng(0)
    rows = records(rng.choice(["bullish", "neutral", "bearish"], 80).tolist(), rng.random(80).round(3).tolist())
    out = O.moving_trend(spark.createDataFrame(rows, DDL), 5, 3600 * 7, 8).toPandas().sort_values("seq")
    want = pd.Series([r[4] for r in rows]).rolling(5).mean()
    np.testing.assert_allclose(out["price_ma"].to_numpy(dtype=float), want.to_numpy(), atol=1e-12)


def test_correlations(spark):
    hours = 24
    rng = np.random.default_rng(5)
    rows = []
    for i in range(hours):
        for label in rng.choice(["bullish", "neutral", "bearish"], 4):
            rows.append((dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), "A", str(label), 0.5, float(rng.integers(1, 9)), i))
    rows += records(["bullish"], symbol="ONE") + records(["bullish"] * 3, [5, 5, 5], "FLAT")
    buckets = O.price_buckets(spark.createDataFrame(rows, DDL))
    out = {r.symbol: r for r in O.with_p_values(O.correlations(buckets)).collect()}
    table = buckets.filter("symbol = 'A'").toPandas()
    score = (table["bullish_count"] - table["bearish_count"]) / table["count"]
    assert out["A"].pearson_correlation == pytest.approx(np.corrcoef(table["avg_price"], score)[0, 1])
    assert out["A"].spearman_correlation == pytest.approx(np.corrcoef(table["avg_price"].rank(), score.rank())[0, 1])
    assert 0 < out["A"].pearson_p_value < 1
    assert out["ONE"].message and out["ONE"].pearson_correlation is None
    assert out["FLAT"].pearson_correlation is None and out["FLAT"].pearson_p_value is None


@pytest.mark.parametrize("t,df,p", [(2.228139, 10, 0.05), (12.706205, 1, 0.05), (1.959966, 10**6, 0.05), (0.0, 5, 1.0), (4.587, 10, 0.001)])
def test_p_values_from_the_t_table(t, df, p):
    r = t / np.sqrt(t * t + df)
    assert O._p_value(r, df + 2) == pytest.approx(p, rel=2e-4)


def test_four_hour_buckets_and_unknown_width(spark):
    df = spark.createDataFrame(records(["bullish"] * 9), DDL)
    assert sorted(r["count"] for r in O.price_buckets(df, "4h").collect()) == [1, 4, 4]
    assert O.price_buckets(df, "7m").count() == O.price_buckets(df, "1h").count() == 9


def test_week_numbers(spark):
    days = [dt.datetime(2023, 12, 31), dt.datetime(2024, 1, 6), dt.datetime(2024, 1, 7)]
    df = spark.createDataFrame([(d, "A", "neutral", 0.5, 1.0, i) for i, d in enumerate(days)], DDL)
    got = sorted((r.year, r.week) for r in O.calendar_rollup(df, "week").collect())
    assert got == [(2023, 53), (2024, 0), (2024, 1)]


@pytest.mark.parametrize("size", [12, 1024])
def test_training_set(spark, size):
    rng = np.random.default_rng(2)
    rows = records(rng.choice(["bullish", "bearish"], 40).tolist(), rng.integers(50, 99, 40).tolist())
    out = O.training_set(O.price_buckets(spark.createDataFrame(rows, DDL)), 10, 2, size).toPandas().sort_values("bucket")
    score = np.array([1.0 if r[2] == "bullish" else -1.0 for r in rows])
    price = np.array([r[4] for r in rows])
    ret = np.concatenate([[0], price[1:] / price[:-1] - 1])
    want = [(score[i - 10 : i].tolist(), ret[i + 2]) for i in range(10, 40 - 2)]
    assert [list(f) for f in out["features"]] == [w[0] for w in want]
    np.testing.assert_allclose(out["target"], [w[1] for w in want])
    short = spark.createDataFrame(records(["bullish"] * 10), DDL)
    assert O.training_set(O.price_buckets(short), 10, 1).count() == 0


def test_top_label(spark):
    df = spark.createDataFrame([(["a", "b", "c"], [0.2, 0.7, 0.7]), ([], []), (None, None)], "labels array<string>, scores array<double>")
    rows = df.select(S.top_label().alias("l"), S.top_confidence().alias("c")).collect()
    assert [(r.l, r.c) for r in rows] == [("b", 0.7), (None, None), (None, None)]


def test_reply_parsing(spark):
    good = '{"choices":[{"message":{"content":"{\\"sentiment\\": \\"bullish\\", \\"confidence\\": 0.85}"}}],"usage":{"total_tokens": 9}}'
    empty = '{"choices":[{"message":{"content":"{}"}}]}'
    df = spark.createDataFrame([(good,), (empty,), ("nope",), ('{"choices":[]}',)], "reply string")
    labels, scores = S.parse_reply()
    rows = df.select(labels.alias("l"), scores.alias("s")).collect()
    assert [(r.l, r.s) for r in rows] == [(["bullish"], [0.85]), (["neutral"], [0.5]), (None, None), (None, None)]


def test_record_extras_win(spark):
    df = spark.createDataFrame(records(["bullish"]), DDL).withColumns({"provider": F.lit("m"), "exchange": F.lit("e"), "text": F.lit("t")})
    row = S.as_record(df, F.create_map(F.lit("provider"), F.lit("other"), F.lit("new"), F.lit("x"))).first()
    assert row.metadata == {"symbol": "BTC/USDT", "sentiment_label": "bullish", "exchange": "e", "provider": "other", "new": "x"}
    plain = S.as_record(df, F.lit(None).cast("map<string,string>")).first()
    assert plain.metadata["provider"] == "m"


def test_cost_ledger(spark):
    df = spark.createDataFrame([("mistral", "x" * 100)] * 10 + [("huggingface", "abcde")], "provider string, text string")
    rows = {r.provider: (r.requests, r.tokens, r.cost) for r in O.cost_ledger(df).collect()}
    assert rows["mistral"] == (10, 250, pytest.approx(0.00005)) and rows["huggingface"] == (1, 1, 0.0)


def test_classifier_fallback_and_bad_batches(spark):
    def primary():
        def classify(texts):
            if "boom" in texts:
                raise RuntimeError("service down")
            return [(["bullish"], [0.9]) if t.startswith("up") else ([], []) for t in texts]

        return classify

    def second():
        return lambda texts: [None if t == "none" else (["bearish"], [0.6]) for t in texts]

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["up 1", "boom", "down", "none", "up 2"])], "id int, text string").coalesce(1)
    both = {r.id: (r.labels, r.provider) for r in O.score_texts(df, "text", primary, "one", second, "two").collect()}
    assert both == {0: (["bullish"], "one"), 1: (["bearish"], "two"), 2: (["bearish"], "two"), 3: (None, None), 4: (["bullish"], "one")}
    alone = {r.id: r.provider for r in O.score_texts(df, "text", primary, "one").collect()}
    assert alone == {0: "one", 1: None, 2: None, 3: None, 4: "one"}
