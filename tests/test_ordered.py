"""Ordered scans against pandas; slot and chunk sizes must not change results."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketspark.operators import ordered as R
from marketspark.operators.indicators import atr, close_emas, in_order, moving_averages, true_range

HOUR = 3_600_000


def series(n=300, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for symbol, count in (("A", n), ("B", n // 3), ("C", 1)):
        at = np.sort(rng.choice(n * 4, count, replace=False)) * HOUR
        close = np.round(100 + rng.normal(0, 5, count).cumsum(), 2)
        rows.append(pd.DataFrame({"symbol": symbol, "open_time": at, "close": close, "high": close + 1, "low": close - 2.5}))
    return pd.concat(rows, ignore_index=True)


@pytest.fixture(scope="module")
def bars():
    return series()


@pytest.mark.parametrize("slot_ms", [HOUR, 7 * HOUR, 10_000 * HOUR])
def test_index_and_previous(spark, bars, slot_ms):
    df = spark.createDataFrame(bars)
    out = R.ordered(df, ["symbol"], ["open_time"], R.slot_of_ms("open_time", slot_ms), ["close"]).toPandas()
    out = out.sort_values(["symbol", "open_time"]).reset_index(drop=True)
    want = bars.sort_values(["symbol", "open_time"]).reset_index(drop=True)
    assert out["row_index"].tolist() == want.groupby("symbol").cumcount().tolist()
    assert out["prev_close"].fillna(-1).tolist() == want.groupby("symbol")["close"].shift().fillna(-1).tolist()


def test_rows_with_null_key_form_a_series(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("A", 5)], "symbol string, open_time bigint")
    out = R.ordered(df, ["symbol"], ["open_time"], R.slot_of_ms("open_time", 1)).collect()
    assert sorted((r.symbol or "", r.open_time, r.row_index) for r in out) == [("", 1, 0), ("", 2, 1), ("A", 5, 0)]


@pytest.mark.parametrize("span,size", [(1, None), (2, 5), (5, 7), (9, 64), (26, None), (200, 16)])
def test_ema_equals_pandas(spark, bars, span, size):
    df = in_order(spark.createDataFrame(bars), slot_ms=50 * HOUR)
    out = R.ema(df, ["symbol"], {"e": ("close", span, False)}, size=size).toPandas().sort_values(["symbol", "open_time"])
    want = bars.sort_values(["symbol", "open_time"]).groupby("symbol")["close"].transform(lambda s: s.ewm(span=span, adjust=False).mean())
    assert np.abs(out["e"].to_numpy() - want.to_numpy()).max() < 1e-9


def test_ema_minimum_rows(spark, bars):
    out = close_emas(spark.createDataFrame(bars)).toPandas().sort_values(["symbol", "open_time"])
    want = bars.sort_values(["symbol", "open_time"]).groupby("symbol")["close"]
    for span in (9, 21, 50, 200):
        expected = want.transform(lambda s: s.ewm(span=span, min_periods=span, adjust=False).mean())
        np.testing.assert_allclose(out[f"ema_{span}"].to_numpy(dtype=float), expected.to_numpy(), atol=1e-9)


def test_true_range_and_atr(spark):
    rows = [("BTC", 0, 50000.0, 50500.0, 49800.0, 50200.0), ("BTC", 900_000, 50200.0, 50700.0, 50000.0, 50500.0)]
    df = spark.createDataFrame(rows, "symbol string, open_time bigint, open double, high double, low double, close double")
    assert [r.true_range for r in true_range(df).orderBy("open_time").collect()] == [700.0, 700.0]
    assert [r.atr for r in atr(df, 2).orderBy("open_time").collect()] == pytest.approx([700.0, 700.0])


@pytest.mark.parametrize("size", [5, 32, 1024])
def test_moving_average(spark, bars, size):
    df = in_order(spark.createDataFrame(bars))
    out = moving_averages(df, ["symbol"], {"m": ("close", 5)}, size).toPandas().sort_values(["symbol", "open_time"])
    want = bars.sort_values(["symbol", "open_time"]).groupby("symbol")["close"].transform(lambda s: s.rolling(5).mean())
    np.testing.assert_allclose(out["m"].to_numpy(dtype=float), want.to_numpy(), atol=1e-9)
    assert len(out) == len(bars)


@pytest.mark.parametrize("seconds", [1, 60, 100_000])
def test_latest_before_equals_merge_asof(spark, seconds):
    rng = np.random.default_rng(3)

    def side(n, name):
        at = pd.to_datetime("2024-01-01") + pd.to_timedelta(rng.integers(0, 5000, n), unit="s")
        return pd.DataFrame({"k": rng.choice(["x", "y", "z"], n), "ts": at, name: np.arange(n)})

    probes, quotes = side(200, "probe"), side(150, "seq")
    quotes["price"] = quotes["seq"] * 1.5
    quotes.loc[::7, "price"] = np.nan
    quotes = quotes[quotes["k"] != "z"]
    schema = "k string, ts timestamp, seq bigint, price double"
    q = spark.createDataFrame(quotes, schema).withColumn("price", F.nanvl("price", F.lit(None).cast("double")))
    out = R.latest_before(spark.createDataFrame(probes), q, ["k"], "ts", ["price"], R.slot_of_ts("ts", seconds), ["seq"]).toPandas()
    want = pd.merge_asof(
        probes.sort_values(["ts", "probe"]), quotes.sort_values(["ts", "seq"]), on="ts", by="k"
    ).sort_values("probe")
    out = out.sort_values("probe")
    np.testing.assert_array_equal(out["price"].to_numpy(dtype=float), want["price"].to_numpy())
    known = want["seq"].notna().to_numpy()
    assert (out["quote_ts"].notna().to_numpy() == known).all()


def test_margin_must_fit(spark):
    with pytest.raises(ValueError):
        R.with_margin(spark.range(3).withColumn("row_index", F.col("id")), 2, back=3)


def test_ema_refuses_nulls(spark):
    rows = spark.createDataFrame([("a", i, None if i == 3 else float(i)) for i in range(6)], "k string, row_index bigint, v double")
    with pytest.raises(Exception, match="v is null"):
        R.ema(rows, ["k"], {"e": ("v", 3, False)}).collect()
