"""Sentiment labels, scores, records and classifier replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Numeric score per label.
SCORES = {"bullish": 1.0, "neutral": 0.0, "bearish": -1.0}


def score(label: str = "sentiment_label", unknown: float | None = None) -> Column:
    """Numeric score of a label; labels outside the list become ``unknown``."""
    out = F.lit(None).cast("double")
    for name, value in SCORES.items():
        out = F.when(F.col(label) == name, F.lit(value)).otherwise(out)
    return out if unknown is None else F.coalesce(out, F.lit(unknown))


def top_label(labels: str = "labels", scores: str = "scores") -> Column:
    """Label at the first highest score; null when there are none."""
    place = F.array_position(F.col(scores), F.array_max(scores)).cast("int")
    usable = (F.size(labels) > 0) & (F.size(scores) > 0)
    return F.when(usable, F.try_element_at(F.col(labels), place))


def top_confidence(scores: str = "scores") -> Column:
    return F.array_max(scores)


def metadata(base: dict[str, Column], extras: Column) -> Column:
    """String map of ``base`` overlaid with the map ``extras``; extras win."""
    entries = [part for key, value in base.items() for part in (F.lit(key), value)]
    extras = F.coalesce(extras, F.create_map().cast("map<string,string>"))
    kept = F.map_filter(F.create_map(*entries), lambda k, _: ~F.map_contains_key(extras, k))
    return F.map_concat(kept, extras)


def as_record(df: DataFrame, extras: Column) -> DataFrame:
    """Flat sentiment columns to a stored record with its metadata map."""
    base = {c: F.col(c) for c in ("symbol", "provider", "sentiment_label", "exchange")}
    return df.select(
        "timestamp",
        "symbol",
        "sentiment_label",
        F.col("confidence").cast("double").alias("confidence"),
        "text",
        "provider",
        F.col("price").cast("double").alias("price"),
        "exchange",
        metadata(base, extras).alias("metadata"),
    )


def parse_reply(reply: str = "reply") -> tuple[Column, Column]:
    """(labels, scores) from a chat reply whose message content is itself JSON.

    Missing keys default to neutral and 0.5; an unreadable reply gives two nulls.
    """
    content = F.get_json_object(F.col(reply), "$.choices[0].message.content")
    inner = F.try_parse_json(content)
    readable = F.schema_of_variant(inner).startswith("OBJECT")
    label = F.coalesce(F.get_json_object(content, "$.sentiment"), F.lit("neutral"))
    confidence = F.coalesce(F.get_json_object(content, "$.confidence").try_cast("double"), F.lit(0.5))
    return F.when(readable, F.array(label)), F.when(readable, F.array(confidence))
