"""The 18 window features against numpy."""

import numpy as np
import pandas as pd
import pytest

from marketspark.operators import features as W


def by_hand(window: pd.DataFrame) -> list[float]:
    c = window["close"].to_numpy()
    r = np.diff(np.log(c))

    def moment(x, k):
        d = x - x.mean()
        return (d**k).mean() / (d**2).mean() ** (k / 2)

    delta = np.diff(c)
    gains, losses = delta[delta > 0], -delta[delta < 0]
    gain = gains.mean() if len(gains) else 0
    loss = losses.mean() if len(losses) else 1
    rsi = 50.0 if len(c) < 15 else 100 - 100 / (1 + gain / loss)
    s = pd.Series(c)
    macd = 0.0 if len(c) < 26 else (s.ewm(span=12, adjust=False).mean() - s.ewm(span=26, adjust=False).mean()).iloc[-1]
    return [
        c.mean(), c.std(), moment(c, 3), moment(c, 4) - 3,
        r.mean(), r.std(), moment(r, 3), moment(r, 4) - 3,
        window["high"].max() / window["low"].min(), c[-1] / c[0], r.std() * np.sqrt(252),
        window["volume"].mean(), window["volume"].std(ddof=0), c[-1] / c[0] - 1, (c.max() - c.min()) / c.max(),
        np.polyfit(range(len(c)), c, 1)[0], rsi, macd,
    ]


def bars(n, seed=0, symbol="A"):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(rng.normal(0, 0.02, n).cumsum())
    return pd.DataFrame(
        {"symbol": symbol, "open_time": np.arange(n) * 3_600_000, "close": close, "high": close * 1.01, "low": close * 0.98, "volume": rng.integers(1, 50, n).astype(float)}
    )


@pytest.mark.parametrize("window,size", [(30, 512), (30, 31), (12, 16)])
def test_rolling_features(spark, window, size):
    data = bars(120)
    out = W.rolling_features(spark.createDataFrame(data), window, size=size).toPandas().sort_values("open_time")
    assert len(out) == 120 - window
    for i, row in zip(range(window, 120), out[W.FEATURES].to_numpy()):
        np.testing.assert_allclose(row, by_hand(data.iloc[i - window : i]), rtol=1e-7, atol=1e-9)


def test_newest_features_and_thresholds(spark):
    sizes = [9, 10, 14, 15, 25, 26, 30, 80]
    data = pd.concat([bars(n, n, f"S{n:02d}") for n in sizes])
    out = W.newest_features(spark.createDataFrame(data), ["symbol"], 60).toPandas().sort_values("symbol")
    assert out["bars"].tolist() == [min(n, 60) for n in sizes]
    assert out.iloc[0][W.FEATURES].isna().all()
    for n, (_, row) in list(zip(sizes, out.iterrows()))[1:]:
        window = bars(n, n).tail(60)
        np.testing.assert_allclose(row[W.FEATURES].to_numpy(dtype=float), by_hand(window), rtol=1e-7, atol=1e-9)


def test_constant_and_rising_series(spark):
    flat = bars(40).assign(close=5.0, high=5.0, low=5.0)
    rising = bars(40).assign(close=np.arange(1.0, 41.0))
    row = W.rolling_features(spark.createDataFrame(flat)).first()
    assert row.std_close == 0 and row.skew_close is None and row.rsi == 0 and row.macd == pytest.approx(0)
    row = W.rolling_features(spark.createDataFrame(rising)).orderBy("open_time").first()
    # no losses: the mean loss counts as 1, the mean gain is 1
    assert row.rsi == pytest.approx(50) and row.linear_trend == pytest.approx(1)


def test_window_needs_rows(spark):
    with pytest.raises(ValueError):
        W.rolling_features(spark.createDataFrame(bars(20)), 9)
