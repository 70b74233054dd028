"""Candle messages to the candle table, live views, and candles from ticks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marketspark.functions.candles import live_result, with_derived
from marketspark.functions.parse import closed_only, decode_candle, flatten_candle
from marketspark.operators.candles import build_candles, keep_one, last_minutes
from marketspark.operators.ordered import sort_key
from marketspark.session import remove


def read_messages(spark: SparkSession, path: str, files_per_batch: int | None = None, arrival: bool = False) -> DataFrame:
    """Message stream from text files (one JSON message per line), column ``value``.

    With ``arrival`` each message also bears its file's time and name and the block it was read from; with its
    place in the block (``arrival_order``) that is the order in which messages were written.
    """
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    made = reader.load(path)
    if arrival:
        facts = [F.col(f"_metadata.{c}").alias(c) for c in ("file_modification_time", "file_path", "file_block_start")]
        made = made.select("value", F.struct(*facts).alias("arrival"))
    return made


def arrival_order(batch: DataFrame) -> Column:
    """A column that sorts a batch of messages as they arrived: the topic's offset, or file, block and place in it."""
    if "offset" in batch.columns:
        return F.col("offset")
    if "arrival" not in batch.columns:
        raise ValueError("messages need an offset or an arrival (read_messages(arrival=True))")
    return F.struct("arrival.*", F.monotonically_increasing_id().alias("place"))  # rises within a block


def read_topic(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """Message stream from a Kafka topic, from the earliest offset on a first start."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .options(**options)
        .load()
    )


def candles_from(messages: DataFrame) -> DataFrame:
    """Finished candles with all derived columns and the ingest time."""
    rows = flatten_candle(closed_only(decode_candle(messages)))
    return with_derived(rows).withColumn("ts", F.current_timestamp())


def split_batch(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candles, quarantine) of a batch of messages: unreadable text and candles with holes go aside,
    unfinished candles are neither."""
    decoded = decode_candle(batch)
    closed = closed_only(decoded)
    good = with_derived(flatten_candle(closed.filter(_is_complete()))).withColumn("ts", F.current_timestamp())
    unreadable = F.col("msg").isNull() | F.col("msg.e").isNull() | F.col("msg.k").isNull()
    bad = decoded.filter(unreadable).unionByName(closed.filter(~_is_complete()))
    return good, bad.select("value")


def _is_complete() -> Column:
    ok = F.col("msg.s").isNotNull()
    for key, kind in (("t", "bigint"), ("T", "bigint"), ("o", "double"), ("h", "double"), ("l", "double"), ("c", "double"), ("v", "double")):
        ok = ok & F.col("msg.k").getItem(key).try_cast(kind).isNotNull()
    return ok


def without_repeats(candles: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Drop second copies of a candle that arrive within the watermark; state stays bounded by it."""
    return candles.withWatermark("open_datetime", lateness).dropDuplicatesWithinWatermark(["symbol", "open_time"])


def start_ingest(messages: DataFrame, table: str, quarantine: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append readable closed candles to ``table`` and unreadable messages to ``quarantine``.

    The table is laid out by day, with a part per batch below and files sorted by symbol and time, so that reads
    prune days and skip symbols while a batch adds few files; a batch that Spark repeats replaces its parts, so a
    restart neither loses nor doubles rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            good, bad = split_batch(batch)
            rows = good.withColumns({"open_date": F.timestamp_millis("open_time").cast("date"), "batch": F.lit(number)})
            rows = rows.repartitionByRange("open_date", "symbol").sortWithinPartitions("open_date", "symbol", "open_time")
            parts = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("open_date", "batch")
            parts.parquet(table)
            bad.write.mode("overwrite").text(f"{quarantine}/batch={number}")
        finally:
            batch.unpersist()

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def start_unique_ingest(messages: DataFrame, table: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append closed candles to ``table``, each (symbol, open time) once: the first copy to arrive stays, however late others come.

    No state is kept beside the table and nothing is dropped for being late: a batch is compared with the keys
    stored for the days that it touches. Parts are by day and batch; a repeated batch replaces its own and is
    compared with the others only.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        good, _ = split_batch(batch.withColumn("arrival", arrival_order(batch)))
        rows = keep_one(good, ["symbol", "open_time"], ["arrival"], last=False).drop("arrival")
        rows = rows.withColumns({"open_date": F.timestamp_millis("open_time").cast("date"), "batch": F.lit(number)}).persist()
        try:
            if number:
                days = [r.open_date for r in rows.select("open_date").distinct().collect()]  # bounded by the calendar
                stored = spark.read.schema("symbol string, open_time bigint, open_date date, batch int").parquet(table)
                known = stored.filter(F.col("open_date").isin(days) & (F.col("batch") != number)).select("symbol", "open_time")
                fresh = rows.join(known, ["symbol", "open_time"], "left_anti")
            else:
                fresh = rows
            fresh.select(*rows.columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("open_date", "batch").parquet(table)
        finally:
            rows.unpersist()

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def start_append(stream: DataFrame, table: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream to a parquet table exactly once."""
    return (
        stream.writeStream.format("parquet")
        .option("path", table)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def rolling_view(table: DataFrame, now: Column, minutes: int = 60) -> DataFrame:
    """The last minutes of every symbol, as the live page shows them."""
    return live_result(last_minutes(table, now, minutes))


def _previous(spark: SparkSession, view: str, number: int, like: DataFrame) -> DataFrame:
    """The view as the batch before left it, or an empty frame of the same shape."""
    if number == 0:
        return like.limit(0)
    return spark.read.schema(like.schema).parquet(f"{view}/batch={number - 1}")


def _forget(spark: SparkSession, view: str, number: int) -> None:
    """Remove the copies before the previous one; that stays for readers that have begun."""
    remove(spark, f"{view}/batch={number - 2}")


def start_rolling_view(
    messages: DataFrame, view: str, checkpoint: str, now=F.current_timestamp, minutes: int = 60, **trigger
) -> StreamingQuery:
    """Keep the last minutes of every symbol as a small table, renewed with each batch.

    A batch reads only the view before it, never the candle history. The folder with the
    highest batch number is the current view.
    """

    def write(batch: DataFrame, number: int) -> None:
        fresh = live_result(split_batch(batch)[0])
        kept = last_minutes(_previous(batch.sparkSession, view, number, fresh).unionByName(fresh), now(), minutes)
        kept.write.mode("overwrite").parquet(f"{view}/batch={number}")
        _forget(batch.sparkSession, view, number)

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "30 seconds"})).start()


def start_latest_view(messages: DataFrame, view: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep the newest frame per symbol: a batch with rows of a symbol replaces that symbol's frame.

    Of copies of a candle in one batch the last to arrive stays (see ``arrival_order``).
    """

    def write(batch: DataFrame, number: int) -> None:
        fresh = latest_frame(split_batch(batch.withColumn("arrival", arrival_order(batch)))[0], ["arrival"]).drop("arrival").persist()
        try:
            symbols = fresh.select("symbol").distinct()
            kept = _previous(batch.sparkSession, view, number, fresh).join(symbols, "symbol", "left_anti")
            kept.unionByName(fresh).write.mode("overwrite").parquet(f"{view}/batch={number}")
        finally:
            fresh.unpersist()
        _forget(batch.sparkSession, view, number)

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "30 seconds"})).start()


def latest_frame(candles: DataFrame, arrival: Sequence[str] = ("ts",)) -> DataFrame:
    """One row per (symbol, close time): the last to arrive."""
    return keep_one(candles, ["symbol", "close_time"], arrival)


def start_tick_candles(ticks: DataFrame, table: str, checkpoint: str, seconds: int = 3600, **trigger) -> StreamingQuery:
    """Candles of a tick stream that lose no tick: late ones count, and open windows are in the table too.

    Each batch adds one partial candle per symbol and window that it touches, by day and batch; a repeated batch
    replaces its own. No state grows with the stream; ``read_tick_candles`` puts the parts together.
    """

    def write(batch: DataFrame, number: int) -> None:
        when = sort_key(batch, ["ts", "seq"])
        parts = (
            batch.withColumn("_when", when)
            .groupBy("symbol", F.window("ts", f"{seconds} seconds").alias("_w"))
            .agg(
                F.min_by("price", "_when").alias("open"),
                F.max("price").alias("high"),
                F.min("price").alias("low"),
                F.max_by("price", "_when").alias("close"),
                F.sum("volume").alias("volume"),
                F.count(F.lit(1)).alias("num_trades"),
                F.min("_when").alias("first_at"),
                F.max("_when").alias("last_at"),
            )
            .withColumns({"ts": F.col("_w.start"), "day": F.col("_w.start").cast("date"), "batch": F.lit(number)})
            .drop("_w")
        )
        parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(table)

    return ticks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_tick_candles(spark: SparkSession, table: str) -> DataFrame:
    """The candles of ``start_tick_candles`` as they stand."""
    return (
        spark.read.parquet(table)
        .groupBy("symbol", "ts")
        .agg(
            F.min_by("open", "first_at").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "last_at").alias("close"),
            F.sum("volume").alias("volume"),
            F.sum("num_trades").alias("num_trades"),
        )
    )


def candles_from_ticks(ticks: DataFrame, seconds: int = 3600, lateness: str = "10 minutes") -> DataFrame:
    """Tumbling candles of a tick stream; a window is emitted once the watermark passes it, later ticks are dropped."""
    return build_candles(ticks.withWatermark("ts", lateness), ["symbol"], seconds)
