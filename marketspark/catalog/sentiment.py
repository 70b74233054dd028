"""Sentiment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketspark.catalog.base import query, rounded
from marketspark.functions import sentiment as S
from marketspark.operators import sentiment as O
from marketspark.views import quotes, sentiment, with_views

SENTIMENT = with_views("sentiment")
_COUNTS = ", ".join(f"count(*) FILTER (WHERE sentiment_label = '{w}') AS {w}_count" for w in ("bullish", "bearish", "neutral"))
_CALENDAR_COUNTS = _COUNTS.replace("_count", "")
_SCORE = "CASE sentiment_label WHEN 'bullish' THEN 1.0 WHEN 'neutral' THEN 0.0 WHEN 'bearish' THEN -1.0 END"


def buckets_sql(width: str) -> str:
    return f"""SELECT symbol, time_bucket(INTERVAL '{width}', "timestamp") AS bucket, min("timestamp") AS "timestamp",
    avg(confidence) AS avg_sentiment_score, avg(price) AS avg_price, count(*) AS count, {_COUNTS} FROM sentiment GROUP BY 1, 2"""


BUCKETS = SENTIMENT + f", b AS ({buckets_sql('1 hour')})"


@query("p13_score", SENTIMENT + f" SELECT seq, CAST({_SCORE} AS DOUBLE) AS score, CAST(CASE WHEN exchange = 'bybit' THEN 0 ELSE {_SCORE} END AS DOUBLE) AS filled FROM sentiment")
def _(spark, sf_dir):
    rows = sentiment(spark, sf_dir).withColumn(
        "odd_label", F.when(F.col("exchange") == "bybit", "unsure").otherwise(F.col("sentiment_label"))
    )
    return rows.select("seq", S.score().alias("score"), S.score("odd_label", 0.0).alias("filled"))


def _results(spark, sf_dir):
    """Classifier-like answers from quote columns; every kraken answer is empty."""
    rows = quotes(spark, sf_dir)
    empty = F.col("exchange") == "kraken"
    labels = F.array(F.lit("bullish"), F.lit("bearish"), F.lit("neutral"))
    scores = F.array(F.col("price") / 500, F.col("volume") / 100, F.lit(0.25))
    return rows.select(
        "seq",
        F.when(empty, F.array().cast("array<string>")).otherwise(labels).alias("labels"),
        F.when(empty, F.array().cast("array<double>")).otherwise(scores).alias("scores"),
    )


@query(
    "p14_top_label",
    with_views("quotes") + """, r AS (SELECT seq, ['bullish','bearish','neutral'] AS labels, [price / 500, volume / 100, 0.25] AS scores, exchange FROM quotes)
  SELECT seq, CASE WHEN exchange <> 'kraken' THEN labels[list_position(scores, list_max(scores))] END AS label,
    CASE WHEN exchange <> 'kraken' THEN list_max(scores) END AS confidence FROM r""",
)
def _(spark, sf_dir):
    return _results(spark, sf_dir).select(
        "seq", S.top_label().alias("label"), S.top_confidence().alias("confidence")
    )


@query(
    "p15_record",
    SENTIMENT + """ SELECT "timestamp", symbol, sentiment_label, confidence, price, symbol AS m_symbol, provider AS m_provider,
  'venue ' || exchange AS m_exchange, 'unknown' AS m_condition, CAST(5 AS INTEGER) AS m_size FROM sentiment""",
)
def _(spark, sf_dir):
    extras = F.create_map(
        F.lit("exchange"), F.concat(F.lit("venue "), F.col("exchange")), F.lit("alert_condition"), F.lit("unknown")
    )
    rows = S.as_record(sentiment(spark, sf_dir), extras)
    item = lambda key: F.element_at("metadata", key)
    return rows.select(
        "timestamp",
        "symbol",
        "sentiment_label",
        "confidence",
        "price",
        item("symbol").alias("m_symbol"),
        item("provider").alias("m_provider"),
        item("exchange").alias("m_exchange"),
        item("alert_condition").alias("m_condition"),
        F.size("metadata").alias("m_size"),
    )


@query(
    "p24_reply",
    SENTIMENT + """ SELECT seq, CASE WHEN exchange = 'bybit' THEN NULL WHEN exchange = 'kraken' THEN 'neutral' ELSE sentiment_label END AS label,
  CASE WHEN exchange = 'bybit' THEN NULL WHEN exchange = 'kraken' THEN 0.5 ELSE price END AS confidence FROM sentiment""",
)
def _(spark, sf_dir):
    inner = (
        F.when(F.col("exchange") == "bybit", "sorry, no JSON")
        .when(F.col("exchange") == "kraken", "{}")
        .otherwise(F.to_json(F.struct(F.col("sentiment_label").alias("sentiment"), F.col("price").alias("confidence"))))
    )
    reply = F.to_json(F.struct(F.array(F.struct(F.struct(inner.alias("content")).alias("message"))).alias("choices")))
    labels, scores = S.parse_reply("reply")
    rows = sentiment(spark, sf_dir).select("seq", reply.alias("reply"))
    return rows.select("seq", labels.getItem(0).alias("label"), scores.getItem(0).alias("confidence"))


@query(
    "f6_sentiment_range",
    SENTIMENT + """ SELECT "timestamp", symbol, sentiment_label, confidence, price FROM sentiment
  WHERE symbol = 'S1' AND provider = 'mistral' AND "timestamp" BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'""",
)
def _(spark, sf_dir):
    bound = lambda text: F.lit(text).cast("timestamp")
    rows = O.select_range(sentiment(spark, sf_dir), "S1", bound("2024-01-05"), bound("2024-01-20"), "mistral")
    return rows.select("timestamp", "symbol", "sentiment_label", "confidence", "price")


@query("t2_oldest_first", SENTIMENT + ' SELECT "timestamp", seq, symbol, price FROM sentiment')
def _(spark, sf_dir):
    return O.select_range(sentiment(spark, sf_dir).select("timestamp", "seq", "symbol", "price"), oldest_first=True)


def _buckets_query(name: str, code: str, width: str) -> None:
    sql = SENTIMENT + f", b AS ({buckets_sql(width)}) SELECT * REPLACE (round(avg_sentiment_score, 12) AS avg_sentiment_score, round(avg_price, 10) AS avg_price) FROM b"

    @query(name, sql)
    def _(spark, sf_dir):
        # Digits beyond any decimal the averages can end in, so that no rounding tie can occur.
        out = rounded(O.price_buckets(sentiment(spark, sf_dir), code), "avg_sentiment_score", digits=12)
        return rounded(out, "avg_price", digits=10)


_buckets_query("a2_buckets_1h", "1h", "1 hour")
_buckets_query("a2_buckets_1d", "1d", "1 day")
_buckets_query("a3_buckets_4h", "4h", "4 hours")


@query(
    "t4_bucket_order",
    BUCKETS + " SELECT symbol, bucket, count FROM b ORDER BY symbol, bucket",
)
def _(spark, sf_dir):
    return O.price_buckets(sentiment(spark, sf_dir)).select("symbol", "bucket", "count").orderBy("symbol", "bucket")


def _calendar_query(by: str, parts: str) -> None:
    sql = SENTIMENT + f" SELECT {parts}, count(*) AS count, round(avg(confidence), 12) AS avg_confidence, {_CALENDAR_COUNTS} FROM sentiment GROUP BY ALL"

    @query(f"a4_calendar_{by}", sql)
    def _(spark, sf_dir):
        return rounded(O.calendar_rollup(sentiment(spark, sf_dir), by), "avg_confidence", digits=12)


_PART = {p: f'CAST({p}("timestamp") AS INTEGER) AS {p}' for p in ("year", "month", "day", "hour")}
_PART["week"] = "CAST(strftime(\"timestamp\", '%U') AS INTEGER) AS week"
_calendar_query("hour", ", ".join(_PART[p] for p in ("year", "month", "day", "hour")))
_calendar_query("day", ", ".join(_PART[p] for p in ("year", "month", "day")))
_calendar_query("week", ", ".join(_PART[p] for p in ("year", "week")))
_calendar_query("month", ", ".join(_PART[p] for p in ("year", "month")))

_PAIRS = BUCKETS + ", p AS (SELECT symbol, avg_price AS price, CAST(bullish_count - bearish_count AS DOUBLE) / count AS score FROM b)"
_CORR = "CASE WHEN count(*) >= 2 THEN round(covar_pop({0}, {1}) / nullif(stddev_pop({0}) * stddev_pop({1}), 0), 6) END"


@query("a5_pearson", _PAIRS + f" SELECT symbol, count(*) AS sample_size, {_CORR.format('price', 'score')} AS pearson_correlation FROM p GROUP BY symbol")
def _(spark, sf_dir):
    out = O.correlations(O.price_buckets(sentiment(spark, sf_dir)))
    return rounded(out.select("symbol", "sample_size", "pearson_correlation"), "pearson_correlation")


@query(
    "a6_spearman",
    _PAIRS + f""", k AS (SELECT symbol, rank() OVER (PARTITION BY symbol ORDER BY price) + (count(*) OVER (PARTITION BY symbol, price) - 1) / 2 AS price,
  rank() OVER (PARTITION BY symbol ORDER BY score) + (count(*) OVER (PARTITION BY symbol, score) - 1) / 2 AS score FROM p)
  SELECT symbol, count(*) AS sample_size, {_CORR.format('price', 'score')} AS spearman_correlation FROM k GROUP BY symbol""",
)
def _(spark, sf_dir):
    out = O.correlations(O.price_buckets(sentiment(spark, sf_dir)))
    return rounded(out.select("symbol", "sample_size", "spearman_correlation"), "spearman_correlation")


# Student's t with whole degrees of freedom has a finite series: the chance of a smaller |t| at angle a = atan(t / sqrt(df)).
_WITHIN = """CASE WHEN df % 2 = 1 THEN 2 / pi() * (a + CASE WHEN df > 1 THEN sin(a) * cos(a) * list_sum(list_transform(range(0, (df - 1) // 2),
    lambda k: exp(k * ln(4) + 2 * lgamma(k + 1) - lgamma(2 * k + 2) + 2 * k * ln(cos(a))))) ELSE 0 END)
  ELSE sin(a) * list_sum(list_transform(range(0, df // 2), lambda k: exp(lgamma(2 * k + 1) - k * ln(4) - 2 * lgamma(k + 1) + 2 * k * ln(cos(a))))) END"""
_A7 = _PAIRS + f""", k AS (SELECT symbol, price, score, rank() OVER (PARTITION BY symbol ORDER BY price) + (count(*) OVER (PARTITION BY symbol, price) - 1) / 2 AS price_rank,
    rank() OVER (PARTITION BY symbol ORDER BY score) + (count(*) OVER (PARTITION BY symbol, score) - 1) / 2 AS score_rank FROM p),
  c AS (SELECT symbol, count(*) AS n, covar_pop(price, score) / nullif(stddev_pop(price) * stddev_pop(score), 0) AS pearson,
    covar_pop(price_rank, score_rank) / nullif(stddev_pop(price_rank) * stddev_pop(score_rank), 0) AS spearman FROM k GROUP BY symbol),
  u AS (SELECT symbol, n, 'pearson' AS kind, pearson AS r FROM c UNION ALL SELECT symbol, n, 'spearman', spearman FROM c),
  w AS (SELECT symbol, n, kind, n - 2 AS df, abs(r) AS r, atan(abs(r) / sqrt(1 - r * r)) AS a FROM u)
  SELECT symbol, n AS sample_size, round(max(CASE WHEN kind = 'pearson' THEN 1 - {_WITHIN} END), 6) AS pearson_p_value,
    round(max(CASE WHEN kind = 'spearman' THEN 1 - {_WITHIN} END), 6) AS spearman_p_value FROM w GROUP BY symbol, n"""


@query("a7_p_values", _A7)
def _(spark, sf_dir):
    out = O.with_p_values(O.correlations(O.price_buckets(sentiment(spark, sf_dir))))
    out = out.select("symbol", "sample_size", "pearson_p_value", "spearman_p_value")
    return rounded(out, "pearson_p_value", "spearman_p_value")


@query(
    "a8_cost_ledger",
    SENTIMENT + """ SELECT provider, count(*) AS requests, CAST(sum(length(text) // 4) AS BIGINT) AS tokens,
  round(sum(length(text) // 4) / 1000000 * CASE provider WHEN 'mistral' THEN 0.20 ELSE 0.0 END, 9) AS cost FROM sentiment GROUP BY provider""",
)
def _(spark, sf_dir):
    return rounded(O.cost_ledger(sentiment(spark, sf_dir)), "cost", digits=9)


_SIZE = "32 + strlen(symbol) + strlen(sentiment_label) + strlen(text) + strlen(provider) + strlen(exchange)"


@query("a9_table_statistics", SENTIMENT + f" SELECT count(*) AS count, CAST(sum({_SIZE}) AS BIGINT) AS size, avg({_SIZE}) AS avg_obj_size FROM sentiment")
def _(spark, sf_dir):
    return O.table_statistics(sentiment(spark, sf_dir))


@query(
    "a19_trend_header",
    SENTIMENT + f""" SELECT symbol, arg_max(sentiment_label, ("timestamp", seq)) AS current_sentiment, CAST(arg_max({_SCORE}, ("timestamp", seq)) AS DOUBLE) AS current_sentiment_score,
  arg_max(price, ("timestamp", seq)) AS current_price, count(*) AS data_points FROM sentiment GROUP BY symbol""",
)
def _(spark, sf_dir):
    return O.trend(sentiment(spark, sf_dir)).drop("sentiment_trend", "price_trend")


_MOVING = SENTIMENT + f""", s AS (SELECT symbol, seq, "timestamp", CAST({_SCORE} AS DOUBLE) AS score, price, row_number() OVER w AS i FROM sentiment
    WINDOW w AS (PARTITION BY symbol ORDER BY "timestamp", seq)),
  ma AS (SELECT symbol, seq, "timestamp", i, CASE WHEN i >= 5 THEN avg(score) OVER w END AS sentiment_ma, CASE WHEN i >= 5 THEN avg(price) OVER w END AS price_ma
    FROM s WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS 4 PRECEDING))"""


@query("w4_sentiment_sma", _MOVING + ' SELECT symbol, seq, "timestamp", round(sentiment_ma, 6) AS sentiment_ma, round(price_ma, 6) AS price_ma FROM ma')
def _(spark, sf_dir):
    out = O.moving_trend(sentiment(spark, sf_dir)).select("symbol", "seq", "timestamp", "sentiment_ma", "price_ma")
    return rounded(out, "sentiment_ma", "price_ma")


@query(
    "w5_trend",
    _MOVING + """ SELECT symbol, CASE WHEN sentiment_ma > ps THEN 'improving' WHEN sentiment_ma < ps THEN 'deteriorating' ELSE 'neutral' END AS sentiment_trend,
  CASE WHEN price_ma > pp THEN 'rising' WHEN price_ma < pp THEN 'falling' ELSE 'neutral' END AS price_trend FROM (
    SELECT *, lag(sentiment_ma) OVER w AS ps, lag(price_ma) OVER w AS pp, row_number() OVER (PARTITION BY symbol ORDER BY i DESC) AS rn
    FROM ma WINDOW w AS (PARTITION BY symbol ORDER BY i)) WHERE rn = 1""",
)
def _(spark, sf_dir):
    return O.trend(sentiment(spark, sf_dir)).select("symbol", "sentiment_trend", "price_trend")


@query(
    "w7_training_set",
    BUCKETS + """, r AS (SELECT symbol, bucket, round(CAST(bullish_count - bearish_count AS DOUBLE) / count, 6) AS score, row_number() OVER w AS i,
    coalesce(avg_price / lag(avg_price) OVER w - 1, 0) AS ret FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bucket)),
  t AS (SELECT symbol, bucket, i, list(score) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS features,
    lead(ret) OVER (PARTITION BY symbol ORDER BY i) AS target FROM r)
  SELECT symbol, bucket, array_to_string(list_transform(features, lambda x: printf('%.6f', x)), ' ') AS features, round(target, 6) AS target FROM t WHERE i > 10 AND target IS NOT NULL""",
)
def _(spark, sf_dir):
    out = O.training_set(O.price_buckets(sentiment(spark, sf_dir)))
    texts = F.transform("features", lambda x: F.format_string("%.6f", F.round(x, 6) + 0.0))
    return rounded(out.withColumn("features", F.array_join(texts, " ")), "target")


@query(
    "w8_anomalies",
    SENTIMENT + f""", m AS (SELECT *, CAST({_SCORE} AS DOUBLE) AS score FROM sentiment), z AS (
  SELECT symbol, seq, "timestamp", sentiment_label, (score - avg(score) OVER (PARTITION BY symbol)) / nullif(stddev_samp(score) OVER (PARTITION BY symbol), 0) AS z FROM m)
  SELECT symbol, seq, "timestamp", sentiment_label, round(z, 6) AS z_score FROM z WHERE abs(z) > 1.25""",
)
def _(spark, sf_dir):
    out = O.anomalies(sentiment(spark, sf_dir), 1.25)
    return rounded(out.select("symbol", "seq", "timestamp", "sentiment_label", "z_score"), "z_score")


# ---- classifiers ---------------------------------------------------------------------------


def keyword_classifier():
    """Stand-in classifier: the first word decides; 'error' texts cannot be read."""

    def classify(texts):
        answers = []
        for text in texts:
            word, number = text.split(" ")
            if word == "error":
                answers.append(None)
            else:
                sure = min(float(number) / 500, 1.0)
                label = "bullish" if word in ("purchase", "signup") else "neutral"
                answers.append(([label, "bearish"], [max(sure, 1 - sure), min(sure, 1 - sure)]))
        return answers

    return classify


def gloomy_classifier():
    """Stand-in fallback: calls everything bearish, but fails on short texts."""

    def classify(texts):
        if any(len(text) < 11 for text in texts):
            raise ValueError("text too short")
        return [(["bearish"], [0.75]) for _ in texts]

    return classify


_V1 = """CASE WHEN sentiment_label = 'bearish' THEN NULL ELSE sentiment_label END AS label,
  CASE WHEN sentiment_label = 'bearish' THEN NULL ELSE round(greatest(confidence, 1 - confidence), 6) END AS confidence"""


@query("v1_classifier", SENTIMENT + f" SELECT seq, {_V1}, CASE WHEN sentiment_label <> 'bearish' THEN 'primary' END AS answered_by FROM sentiment")
def _(spark, sf_dir):
    rows = O.score_texts(sentiment(spark, sf_dir).select("seq", "text"), "text", keyword_classifier)
    out = rows.select(
        "seq", S.top_label().alias("label"), S.top_confidence().alias("confidence"), F.col("provider").alias("answered_by")
    )
    return rounded(out, "confidence")


@query(
    "v2_fallback",
    SENTIMENT + """ SELECT seq, CASE WHEN sentiment_label <> 'bearish' THEN sentiment_label WHEN length(text) >= 11 THEN 'bearish' END AS label,
  CASE WHEN sentiment_label <> 'bearish' THEN 'mistral' WHEN length(text) >= 11 THEN 'huggingface' END AS answered_by FROM sentiment""",
)
def _(spark, sf_dir):
    rows = O.score_texts(
        sentiment(spark, sf_dir).select("seq", "text"),
        "text",
        keyword_classifier,
        "mistral",
        gloomy_classifier,
        "huggingface",
    )
    return rows.select("seq", S.top_label().alias("label"), F.col("provider").alias("answered_by"))


def overlap_classifier(labels):
    """Stand-in zero-shot classifier: scores a label by the letters it shares with the text."""

    def classify(texts):
        return [(labels, [float(len(set(label) & set(text))) for label in labels]) for text in texts]

    return classify


_SHARED = "CAST(len(list_intersect(list_distinct(string_split('{0}', '')), string_split(text, ''))) AS DOUBLE)"
_ZERO_SHOT = SENTIMENT + ", z AS (SELECT seq, ['sharp drop','steady rise','news'] AS labels, [" + ", ".join(
    _SHARED.format(label) for label in ("sharp drop", "steady rise", "news")
) + "] AS scores FROM sentiment) SELECT seq, labels[list_position(scores, list_max(scores))] AS label, list_max(scores) AS confidence FROM z"


@query("v3_zero_shot", _ZERO_SHOT)
def _(spark, sf_dir):
    make = O.label_classifier(overlap_classifier, ["sharp drop", "steady rise", "news"])
    rows = O.score_texts(sentiment(spark, sf_dir).select("seq", "text"), "text", make)
    return rows.select("seq", S.top_label().alias("label"), S.top_confidence().alias("confidence"))
