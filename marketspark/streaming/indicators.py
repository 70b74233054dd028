"""Indicators of a candle stream, carried on from batch to batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marketspark.operators.indicators import EMA_SPANS, carried_schema, carry_on
from marketspark.operators.joins import join_small
from marketspark.session import remove, settle, ship_code


def start_indicators(
    candles: DataFrame, table: str, late: str, state: str, checkpoint: str, spans: Sequence[int] = EMA_SPANS, period: int = 14, **trigger
) -> StreamingQuery:
    """Moving averages of the close and the average true range of every candle of a stream, in ``table`` by batch.

    What is handed on is one row per symbol (see ``carry_on``), so the averages are those of one pass over all
    candles, however the stream is cut. An average cannot take in a candle older than its last one: such candles
    go to ``late``, by batch. A batch reads the state that the one before left and overwrites its own parts, so it
    can be repeated.
    """
    ship_code(candles.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(carried_schema(spans)).parquet(f"{state}/batch={number - 1}") if number else spark.createDataFrame([], carried_schema(spans))
        known = before.select("symbol", F.col("open_time").alias("_last"))
        rows = settle(join_small(batch, known, ["symbol"], "left").select(*batch.columns, F.coalesce(F.col("open_time") <= F.col("_last"), F.lit(False)).alias("_late")))
        made, after = carry_on(rows.filter("NOT _late").drop("_late"), before, spans, period)
        made.write.mode("overwrite").parquet(f"{table}/batch={number}")
        rows.filter("_late").drop("_late").write.mode("overwrite").parquet(f"{late}/batch={number}")
        after.write.mode("overwrite").parquet(f"{state}/batch={number}")
        remove(spark, f"{state}/batch={number - 2}")

    return candles.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
