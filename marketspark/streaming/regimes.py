"""Regimes of alerting keys, detected anew in every batch of a quote stream."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.operators.candles import last_bars
from marketspark.operators.joins import join_small
from marketspark.operators.ordered import sort_key
from marketspark.operators.patterns import Embedder, detect
from marketspark.session import remove

KEYS = ["exchange", "symbol"]
RING_DDL = (
    "exchange string, symbol string, open_time bigint, open double, high double, low double, close double, "
    "volume double, num_trades bigint, _first decimal(38,0), _last decimal(38,0)"
)
FOUND_DDL = "exchange string, symbol string, bars bigint, feature_vector array<double>, embedding array<double>, cluster_id int, distance double"


def bar_pieces(quotes: DataFrame, seconds: int) -> DataFrame:
    """Bars of these quotes alone, with the places of their first and last quote, so that pieces can be merged."""
    start = F.expr(f"unix_millis(ts) div {seconds * 1000}L * {seconds * 1000}L")
    rows = quotes.filter(F.col("ts").isNotNull())
    return (
        rows.withColumns({"open_time": start, "_when": sort_key(rows, ["ts", "seq"])})
        .groupBy(*KEYS, "open_time")
        .agg(
            F.min_by("price", "_when").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "_when").alias("close"),
            F.sum("volume").alias("volume"),
            F.count(F.lit(1)).alias("num_trades"),
            F.min("_when").cast("decimal(38,0)").alias("_first"),
            F.max("_when").cast("decimal(38,0)").alias("_last"),
        )
    )


def merged(pieces: DataFrame) -> DataFrame:
    """One bar per key and time from its pieces, whatever order they came in."""
    return pieces.groupBy(*KEYS, "open_time").agg(
        F.min_by("open", "_first").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "_last").alias("close"),
        F.sum("volume").alias("volume"),
        F.sum("num_trades").alias("num_trades"),
        F.min("_first").alias("_first"),
        F.max("_last").alias("_last"),
    )


@dataclass(frozen=True)
class RegimeRing:
    """Detector for ``start_alert_cycle``: the regimes of the keys that fire, from their newest bars.

    The newest ``bars`` bars of every (exchange, symbol) are carried from batch to batch under ``path/ring``, as
    pieces that later quotes can still extend. They are the newest bars of all quotes so far in whatever order
    these came: a bar leaves the ring only for as many newer ones, and quotes older than all of these change
    none. Only keys that fired are given to the detector; what it found is kept under ``path/found``, by batch.
    A batch reads the ring of the one before and writes its own, so it can be repeated. The ring holds at most
    ``bars`` rows a key. Quotes without a time are left out; fewer than ten bars, or no model, are regime -1.
    """

    path: str
    embedder: Embedder | None
    centroids: Sequence[Sequence[float]] | None
    seconds: int = 60
    bars: int = 60

    def __call__(self, fires: DataFrame, quotes: DataFrame, number: int) -> DataFrame:
        spark = quotes.sparkSession
        pieces = bar_pieces(quotes, self.seconds)
        if number:
            pieces = pieces.unionByName(spark.read.schema(RING_DDL).parquet(f"{self.path}/ring/batch={number - 1}"))
        names = [c.strip().split(" ")[0] for c in RING_DDL.split(", ")]
        last_bars(merged(pieces), KEYS, self.bars).select(*names).write.mode("overwrite").parquet(f"{self.path}/ring/batch={number}")
        ring = spark.read.schema(RING_DDL).parquet(f"{self.path}/ring/batch={number}")
        wanted = join_small(ring, fires.select(*KEYS).distinct(), KEYS, "left_semi")
        found = detect(wanted, self.embedder, self.centroids, KEYS, self.bars)
        found = found.select(*[F.col(c.split(" ")[0]).cast(c.split(" ")[1]) for c in FOUND_DDL.split(", ")])
        found.write.mode("overwrite").parquet(f"{self.path}/found/batch={number}")
        remove(spark, f"{self.path}/ring/batch={number - 2}")
        return spark.read.schema(FOUND_DDL).parquet(f"{self.path}/found/batch={number}")
