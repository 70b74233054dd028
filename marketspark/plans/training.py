"""Training of the regime model: rolling features, embedding, centroids, labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.operators.candles import training_rows
from marketspark.operators.features import FEATURES, rolling_features
from marketspark.operators.patterns import Embedder, complete, fit_centroids, fit_embedder, nearest_centroid
from marketspark.session import settle


@dataclass(frozen=True)
class Regimes:
    embedder: Embedder
    centroids: list[list[float]] | None
    labelled: DataFrame


def train(
    candles: DataFrame, symbol: str | None = None, limit: int | None = None, window: int = 30, dim: int = 8, k: int = 5, starts: int = 10
) -> Regimes:
    """Fit ``k`` regimes on all bars of all instruments, or of one; an instrument without enough bars is an error.

    Everything that touches bars is a Spark job: windows, scaling, components and k-means. ``limit`` (default
    none) trains on the newest bars only.
    """
    bars = training_rows(candles, None, limit) if symbol is None else training_rows(candles, symbol, limit).withColumn("symbol", F.lit(symbol))
    bars = bars.select("symbol", F.unix_millis("timestamp").alias("open_time"), "open", "high", "low", "close", "volume")
    features = complete(rolling_features(bars, window), FEATURES)
    embedder = fit_embedder(features, dim)
    embedded = settle(embedder.embed(features).select("symbol", "open_time", "embedding"))
    centroids = fit_centroids(embedded, k=k, starts=starts)
    labelled = nearest_centroid(embedded, centroids).withColumnRenamed("cluster_id", "label")
    return Regimes(embedder, centroids, labelled)
