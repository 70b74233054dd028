"""Message texts of the alerting job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the first four price regimes, and the chat service's length limit.
REGIMES = {0: "Breakout (bullish)", 1: "Breakdown (bearish)", 2: "Range consolidation", 3: "Volatile spike"}
MESSAGE_LIMIT = 4096


def money(value: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(value, 2))


# The layout of the three message parts below.
def alert_text(symbol: Column, exchange: Column, price: Column, threshold: Column, condition: Column, at: Column) -> Column:
    lines = [
        F.lit("*Price Alert!*"),
        F.concat(F.lit("Symbol: `"), symbol, F.lit("`")),
        F.concat(F.lit("Exchange: `"), exchange, F.lit("`")),
        F.concat(F.lit("Current: `"), money(price), F.lit("`")),
        F.concat(F.lit("Threshold: `"), money(threshold), F.lit("` ("), condition, F.lit(")")),
        F.concat(F.lit("Time: "), F.date_format(at, "yyyy-MM-dd HH:mm:ss 'UTC'")),
    ]
    return F.concat_ws("\n", *lines)


def with_sentiment(message: Column, provider: Column, label: Column, confidence: Column) -> Column:
    """Message with the sentiment line; unchanged where there is no label."""
    suffix = F.concat(
        F.lit("\n\n *Sentiment ("), provider, F.lit("):* "), label, F.lit(" ("), F.format_string("%.2f", confidence), F.lit(")")
    )
    return F.concat(message, F.coalesce(suffix, F.lit("")))


def regime_name(cluster: Column) -> Column:
    name = F.concat(F.lit("Pattern "), cluster.cast("string"))
    for number, text in REGIMES.items():
        name = F.when(cluster == number, text).otherwise(name)
    return name


def with_pattern(message: Column, cluster: Column) -> Column:
    """Message with the regime line; unchanged for no cluster or noise."""
    suffix = F.concat(
        F.lit("\n\n *Pattern:* "), regime_name(cluster), F.lit(" (cluster "), cluster.cast("string"), F.lit(")")
    )
    return F.when(cluster >= 0, F.concat(message, suffix)).otherwise(message)


def is_sendable(message: Column) -> Column:
    """Anything but white space (in any script) is left."""
    return F.length(F.regexp_replace(message, r"^(?U)[\s\x1c-\x1f]+", "")) > 0


def parts(message: Column) -> Column:
    """A message as an array of parts within the service's limit; nothing is lost. An empty message is one part."""
    count = F.greatest(F.ceil(F.char_length(message) / MESSAGE_LIMIT), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substr(message, i * MESSAGE_LIMIT + 1, F.lit(MESSAGE_LIMIT)))
