"""Sentiment roll-ups, correlation, trend, anomalies, training rows and scoring."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence


import pandas as pd
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from marketspark.functions.sentiment import score
from marketspark.operators.candles import last_bars
from marketspark.operators.joins import join_small
from marketspark.operators.ordered import CHUNK_ROWS, TICK_SLOT_SECONDS, chunk_window, ordered, own_rows, slot_of_ts, with_margin
from marketspark.session import ship_code

WIDTHS = {"1h": "1 hour", "4h": "4 hours", "1d": "1 day"}
# Price of a million tokens per provider.
PRICES = {"mistral": 0.20, "huggingface": 0.0}


def select_range(
    df: DataFrame,
    symbol: str | None = None,
    start: Column | None = None,
    end: Column | None = None,
    provider: str | None = None,
    limit: int | None = None,
    oldest_first: bool = False,
) -> DataFrame:
    """Stored records of a closed time range; oldest first if asked or limited."""
    if symbol is not None:
        df = df.filter(F.col("symbol") == symbol)
    if start is not None:
        df = df.filter(F.col("timestamp") >= start)
    if end is not None:
        df = df.filter(F.col("timestamp") <= end)
    if provider:
        df = df.filter(F.col("provider") == provider)
    if limit or oldest_first:
        df = df.orderBy("timestamp", *[c for c in ("seq",) if c in df.columns])
    return df.limit(limit) if limit else df


def _label_counts(suffix: str = "") -> list[Column]:
    return [F.count_if(F.col("sentiment_label") == label).alias(f"{label}{suffix}") for label in ("bullish", "bearish", "neutral")]


def price_buckets(df: DataFrame, width: str = "1h") -> DataFrame:
    """Per symbol and time bucket: first time, mean confidence and price, counts. Unknown widths act as 1h."""
    bucket = F.window("timestamp", WIDTHS.get(width, WIDTHS["1h"])).alias("_w")
    return (
        df.groupBy("symbol", bucket)
        .agg(
            F.min("timestamp").alias("timestamp"),
            F.avg("confidence").alias("avg_sentiment_score"),
            F.avg("price").alias("avg_price"),
            F.count(F.lit(1)).alias("count"),
            *_label_counts("_count"),
        )
        .withColumn("bucket", F.col("_w.start"))
        .drop("_w")
    )


def calendar_rollup(df: DataFrame, by: str = "hour") -> DataFrame:
    """Counts and mean confidence by hour, day, week (Sunday-based, 0-53) or month; others act as day."""
    ts = F.col("timestamp")
    year, month, day = F.year(ts).alias("year"), F.month(ts).alias("month"), F.day(ts).alias("day")
    week = F.floor((F.dayofyear(ts) + 7 - F.dayofweek(ts)) / 7).cast("int").alias("week")
    parts = {
        "hour": [year, month, day, F.hour(ts).alias("hour")],
        "week": [year, week],
        "month": [year, month],
    }.get(by, [year, month, day])
    return df.groupBy(*parts).agg(
        F.count(F.lit(1)).alias("count"), F.avg("confidence").alias("avg_confidence"), *_label_counts()
    )


def pearson(a: str, b: str) -> Column:
    """Correlation; null (not an error) when a side is constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


@F.pandas_udf(DoubleType())
def p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of a correlation ``r`` over ``n`` pairs (t test, n-2 degrees of freedom)."""
    return pd.Series([_p_value(a, b) for a, b in zip(r, n)], dtype="float64")


def _p_value(r: float, n: float) -> float | None:
    if r is None or math.isnan(r) or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    # With t^2 = r^2 * df / (1 - r^2) the tail is I_x(df/2, 1/2) at x = df / (df + t^2) = 1 - r^2.
    return beta_tail((n - 2) / 2, 0.5, 1 - r * r)


def beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz's method)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(b, a, 1 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    value = d
    for m in range(1, 500):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 / (1 + step * d or 1e-300)
            c = 1 + step / c or 1e-300
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * value / a


def correlations(buckets: DataFrame) -> DataFrame:
    """Pearson and Spearman correlation of mean price and sentiment balance over buckets, per symbol.

    Windows here run over buckets, of which a symbol has one per hour of history at most.
    """
    balance = (F.col("bullish_count") - F.col("bearish_count")) / F.col("count")
    rows = buckets.select("symbol", F.col("avg_price").alias("price"), balance.alias("score"))
    for c in ("price", "score"):
        order = Window.partitionBy("symbol").orderBy(c)
        ties = Window.partitionBy("symbol", c)
        rows = rows.withColumn(f"{c}_rank", F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2)
    n = F.count(F.lit(1))
    return (
        rows.groupBy("symbol")
        .agg(
            n.alias("sample_size"),
            F.when(n >= 2, pearson("price", "score")).alias("pearson_correlation"),
            F.when(n >= 2, pearson("price_rank", "score_rank")).alias("spearman_correlation"),
        )
        .withColumn("message", F.when(F.col("sample_size") < 2, "Insufficient data for correlation"))
    )


def with_p_values(result: DataFrame) -> DataFrame:
    """P-value columns on one row per symbol."""
    ship_code(result.sparkSession)
    return result.withColumns(
        {
            "pearson_p_value": p_value("pearson_correlation", "sample_size"),
            "spearman_p_value": p_value("spearman_correlation", "sample_size"),
        }
    )


def cost_ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """Requests, estimated tokens and cost per provider."""
    rate = F.lit(0.0)
    for provider, price in PRICES.items():
        rate = F.when(F.col("provider") == provider, F.lit(price)).otherwise(rate)
    return (
        df.groupBy("provider")
        .agg(F.count(F.lit(1)).alias("requests"), F.sum(F.floor(F.length(text) / 4)).alias("tokens"))
        .withColumn("cost", F.col("tokens") / 1_000_000 * rate)
    )


def table_statistics(df: DataFrame) -> DataFrame:
    """Row count, total and mean size of the rows: a string's bytes, and the width of every other value."""
    widths = {"int": 4, "float": 4, "date": 4, "smallint": 2, "tinyint": 1, "boolean": 1}
    text = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    nested = [F.octet_length(F.to_json(c)) for c, kind in df.dtypes if kind.startswith(("map", "array", "struct"))]
    fixed = sum(widths.get(kind, 8) for _, kind in df.dtypes) - 8 * (len(text) + len(nested))
    size = sum([*text, *[F.coalesce(n, F.lit(0)) for n in nested]], F.lit(fixed)).cast("bigint")
    return df.agg(
        F.count(F.lit(1)).alias("count"), F.sum(size).alias("size"), F.avg(size).alias("avg_obj_size")
    )


def trend(df: DataFrame, window: int = 5) -> DataFrame:
    """Latest label, score and price per symbol, with the direction of both moving averages.

    Only the newest ``window + 1`` rows per symbol reach a window; the row count is an aggregate.
    """
    rows = df.withColumn("score", score())
    counts = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("data_points"))
    tail = last_bars(rows, ["symbol"], window + 1, ["timestamp", "seq"], rank="_rank")
    latest, before = F.col("_rank") <= window, F.col("_rank") >= 2

    def mean(value: str, part: Column) -> Column:
        chosen = F.when(part, F.col(value))
        return F.when(F.count(chosen) == window, F.avg(chosen))

    def towards(value: str, up: str, down: str) -> Column:
        a, b = mean(value, latest), mean(value, before)
        return F.when(a > b, up).when(a < b, down).otherwise("neutral")

    first = F.col("_rank") == 1
    facts = tail.groupBy("symbol").agg(
        F.max(F.when(first, F.col("sentiment_label"))).alias("current_sentiment"),
        F.max(F.when(first, F.col("score"))).alias("current_sentiment_score"),
        F.max(F.when(first, F.col("price"))).alias("current_price"),
        towards("score", "improving", "deteriorating").alias("sentiment_trend"),
        towards("price", "rising", "falling").alias("price_trend"),
    )
    return facts.join(counts, "symbol")


def moving_trend(df: DataFrame, window: int = 5, slot_seconds: int = TICK_SLOT_SECONDS, size: int = CHUNK_ROWS) -> DataFrame:
    """Moving averages of score and price at every record: the series behind ``trend``."""
    from marketspark.operators.indicators import moving_averages

    rows = ordered(
        df.withColumn("score", score()), ["symbol"], ["timestamp", "seq"], slot_of_ts("timestamp", slot_seconds)
    )
    columns = {"sentiment_ma": ("score", window), "price_ma": ("price", window)}
    return moving_averages(rows, ["symbol"], columns, size).drop("row_index")


def training_set(
    buckets: DataFrame, lookback: int = 10, horizon: int = 1, size: int = CHUNK_ROWS, slot_seconds: int = 86_400
) -> DataFrame:
    """Supervised rows: the ``lookback`` balances before a bucket, and the return ``horizon`` buckets after it."""
    balance = (F.col("bullish_count") - F.col("bearish_count")) / F.col("count")
    rows = buckets.select("symbol", "bucket", "avg_price", balance.alias("score"))
    rows = ordered(rows, ["symbol"], ["bucket"], slot_of_ts("bucket", slot_seconds), previous=["avg_price"])
    rows = rows.withColumn(
        "price_return", F.coalesce(F.try_divide(F.col("avg_price"), F.col("prev_avg_price")) - 1, F.lit(0.0))
    )
    rows = with_margin(rows, max(size, lookback, horizon), back=lookback, ahead=horizon)
    order = chunk_window(["symbol"])
    rows = rows.withColumns(
        {
            "features": F.collect_list("score").over(order.rowsBetween(-lookback, -1)),
            "target": F.lead("price_return", horizon).over(order),
        }
    )
    usable = (F.col("row_index") >= lookback) & F.col("target").isNotNull()
    return own_rows(rows).filter(usable).select("symbol", "bucket", "features", "target")


def anomalies(df: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Records whose score lies more than ``threshold`` sample deviations from their symbol's mean."""
    rows = df.withColumn("sentiment_score", score(unknown=0.0))
    stats = rows.groupBy("symbol").agg(F.avg("sentiment_score").alias("_mean"), F.stddev_samp("sentiment_score").alias("_std"))
    z = (F.col("sentiment_score") - F.col("_mean")) / F.nullif(F.col("_std"), F.lit(0.0))
    joined = join_small(rows, stats.filter(F.col("_std") > 0), ["symbol"])
    return joined.withColumn("z_score", z).filter(F.abs("z_score") > threshold).drop("_mean", "_std")


# ---- classifiers ---------------------------------------------------------------------------

# A classifier takes a list of texts and returns one (labels, scores) pair per text, or None for a failure.
Classifier = Callable[[Sequence[str]], Sequence[tuple[Sequence[str], Sequence[float]] | None]]


def _classify(texts: list[str], classifier: Classifier, failures=None, down_twice: bool = True) -> list:
    """One answer per text. A failing batch is halved until only the bad texts are lost; each failure is counted.

    A service that fails on a whole batch and on both its halves is taken to be down, and the batch is given up.
    """
    answers, failed = _ask(texts, classifier)
    if failures is not None and failed:
        failures.add(failed)
    if answers is not None or not texts:
        return answers or []
    if len(texts) == 1:
        return [None]
    halves = [texts[: len(texts) // 2], texts[len(texts) // 2 :]]
    if down_twice and len(texts) > 2:
        tried = [_ask(half, classifier) for half in halves]
        if failures is not None:
            failures.add(sum(n for _, n in tried))
        if all(found is None for found, _ in tried):
            # Two single texts tell a dead service from a batch with bad texts in both halves.
            probes = [_ask([half[0]], classifier)[0] for half in halves] + [_ask([half[-1]], classifier)[0] for half in halves]
            if all(p is None for p in probes):
                return [None] * len(texts)
        return [x for half, (found, _) in zip(halves, tried) for x in (found if found is not None else _split(half, classifier, failures))]
    return _split(texts, classifier, failures)


def _split(texts: list[str], classifier: Classifier, failures) -> list:
    if len(texts) == 1:
        return [None]
    middle = len(texts) // 2
    return _classify(texts[:middle], classifier, failures, False) + _classify(texts[middle:], classifier, failures, False)


def _ask(texts: list[str], classifier: Classifier) -> tuple[list | None, int]:
    """The answers, or none and one failure."""
    try:
        answers = list(classifier(texts)) if texts else []
    except Exception:  # whatever a user's service raises costs these texts, not the job
        return None, 1
    return (answers, 0) if len(answers) == len(texts) else (None, 1)


def score_texts(
    df: DataFrame,
    text: str,
    make: Callable[[], Classifier],
    provider: str = "primary",
    fallback: Callable[[], Classifier] | None = None,
    fallback_provider: str = "fallback",
    batch: int = 256,
    failures: Accumulator | None = None,
) -> DataFrame:
    """Append (or replace) ``labels``, ``scores`` and the ``provider`` that answered, through a user's classifier.

    ``make`` builds the classifier once per partition. Texts without an answer go to the
    fallback, if there is one; if that fails too all three columns are null. ``failures`` counts failed calls.
    """
    ship_code(df.sparkSession)
    added = ("labels", "scores", "provider")
    columns = [c for c in df.columns if c not in added]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain = [(provider, make())] + ([(fallback_provider, fallback())] if fallback else [])
        for part in parts:
            texts = part[text].tolist()
            answers: list = [None] * len(texts)
            for name, classifier in chain:
                open_ = [i for i, a in enumerate(answers) if a is None]
                for at in range(0, len(open_), batch):
                    block = open_[at : at + batch]
                    for i, answer in zip(block, _classify([texts[i] for i in block], classifier, failures)):
                        if answer is not None and len(answer[0]) > 0:
                            answers[i] = (list(answer[0]), [float(s) for s in answer[1]], name)
            out = part[columns].copy()
            for k, name in enumerate(added):
                out[name] = pd.Series([a[k] if a else None for a in answers], index=part.index, dtype="object")
            yield out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in columns)
    return df.mapInPandas(run, f"{fields}, labels array<string>, scores array<double>, provider string")


def label_classifier(make: Callable[[list[str]], Classifier], labels: Sequence[str]) -> Callable[[], Classifier]:
    """Zero-shot use: bind the caller's candidate labels to a classifier factory."""
    wanted = list(labels)
    return lambda: make(wanted)


