"""Alerting on a quote stream, with state that survives restarts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marketspark.functions import text as X
from marketspark.functions.sentiment import as_record, top_confidence, top_label
from marketspark.operators.alerts import COOLDOWN_SECONDS, MIN_MOVE, RULE_KEY, crossings, replay, replay_crossings, with_source
from marketspark.operators.sentiment import Classifier, score_texts
from marketspark.session import remove, settle, ship_code
from marketspark.sources.tables import append_sentiment

FIRED_DDL = "symbol string, exchange string, threshold double, condition string, ts timestamp, seq bigint, price double"
CROSSED_DDL = "symbol string, exchange string, threshold double, condition string, ts timestamp, seq bigint, price double, _at bigint"
STATE_DDL = "symbol string, exchange string, threshold double, condition string, at bigint, price double"


def start_alerts(
    quotes: DataFrame,
    rules: DataFrame,
    table: str,
    state: str,
    checkpoint: str,
    cooldown_seconds: int = COOLDOWN_SECONDS,
    min_move: float = MIN_MOVE,
    fallback: bool = False,
    then: Callable[[DataFrame, DataFrame, int], None] | None = None,
    **trigger,
) -> StreamingQuery:
    """Alerts of a quote stream: one row per fire, in ``table`` by batch.

    Every batch is replayed by the batch operator from the last fires that the batch before it left in ``state``,
    so a rule's crossings are cut into parts and never held together, however many a batch brings. A repeated
    batch starts from the same state and replaces its own output. The stream is expected to be in time order
    across batches, as a topic partition is. With ``fallback`` a rule whose exchange has no quote of its symbol in
    a batch is priced by the first of its fallback exchanges that has. ``then`` gets each batch's fires, its quotes
    and its number.
    """
    ship_code(quotes.sparkSession)
    held = settle(rules)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        entry = spark.read.schema(STATE_DDL).parquet(f"{state}/batch={number - 1}") if number else None
        batch = batch.persist()
        try:
            priced = with_source(held, batch) if fallback else held
            fires = settle(replay(batch, priced, cooldown_seconds, min_move, entry=entry))
            fires.write.mode("overwrite").parquet(f"{table}/batch={number}")
            if then:
                then(fires, batch, number)
        finally:
            batch.unpersist()
        _last_fires(entry, fires).write.mode("overwrite").parquet(f"{state}/batch={number}")
        remove(spark, f"{state}/batch={number - 2}")

    return quotes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _last_fires(entry: DataFrame | None, fires: DataFrame) -> DataFrame:
    """The last fire of every rule after these fires."""
    newest = fires.groupBy(*RULE_KEY).agg(F.unix_micros(F.max("ts")).alias("at"), F.max_by("price", F.struct("ts", "seq")).alias("price"))
    if entry is None:
        return newest
    return entry.join(newest.select(*RULE_KEY), RULE_KEY, "left_anti").unionByName(newest)


def start_event_time_alerts(
    quotes: DataFrame,
    rules: DataFrame,
    table: str,
    late: str,
    state: str,
    checkpoint: str,
    lateness_seconds: int = 600,
    cooldown_seconds: int = COOLDOWN_SECONDS,
    min_move: float = MIN_MOVE,
    **trigger,
) -> StreamingQuery:
    """Alerts of a quote stream in event time: quotes may come in any order within ``lateness_seconds``.

    The clock of a batch is the newest quote time seen so far less the lateness. Crossings up to the clock are
    replayed in time order from the last fires; newer ones wait in ``state`` for a later batch; those at or before
    the clock of the batch before came too late to be put in order and go to ``late``, by batch. What fires is
    what ``replay`` finds over all quotes but the late ones, however the stream was cut and shuffled.
    ``finish_alerts`` lets out what still waits. Fires are in ``table`` by batch. A batch reads only the state
    that the one before left and overwrites its own parts, so it can be repeated. What waits is bounded by the
    crossings of one lateness, and rules are replayed in time parts, so none is held by one task.
    """
    ship_code(quotes.sparkSession)
    held = settle(rules)

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            newest = batch.agg(F.max(F.unix_micros("ts"))).first()[0]
            fresh = settle(crossings(batch, held))
        finally:
            batch.unpersist()
        before = _clock(batch.sparkSession, state, number - 1)
        clock = max(x for x in (before, None if newest is None else newest - lateness_seconds * 1_000_000, -1 << 62) if x is not None)
        _advance(batch.sparkSession, fresh, before, clock, number, table, late, state, cooldown_seconds, min_move)

    return quotes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def finish_alerts(spark: SparkSession, table: str, late: str, state: str, cooldown_seconds: int = COOLDOWN_SECONDS, min_move: float = MIN_MOVE) -> None:
    """Replay what still waits, for a stream that has ended: its clock moves beyond all quotes.

    The stream must not go on from there, as its next batch would take the number written here.
    """
    clocks = spark.read.schema("clock bigint, batch int").parquet(f"{state}/clock")
    number = clocks.agg(F.max("batch")).first()[0]
    none = spark.createDataFrame([], CROSSED_DDL)
    _advance(spark, none, _clock(spark, state, number), (1 << 62), number + 1, table, late, state, cooldown_seconds, min_move)


def _clock(spark: SparkSession, state: str, number: int) -> int | None:
    if number < 0:
        return None
    return spark.read.schema("clock bigint").parquet(f"{state}/clock/batch={number}").first().clock


def _advance(spark: SparkSession, fresh: DataFrame, before: int | None, clock: int, number: int, table: str, late: str, state: str, cooldown_seconds: int, min_move: float) -> None:
    """One step of the event-time replay: from the state of the batch before to that of this one."""
    entry, waiting = None, fresh
    if before is not None:
        entry = spark.read.schema(STATE_DDL).parquet(f"{state}/last/batch={number - 1}")
        waiting = fresh.filter(F.col("_at") > before).unionByName(spark.read.schema(CROSSED_DDL).parquet(f"{state}/waiting/batch={number - 1}"))
        fresh.filter(F.col("_at") <= before).drop("_at").write.mode("overwrite").parquet(f"{late}/batch={number}")
    fires = settle(replay_crossings(waiting.filter(F.col("_at") <= clock), cooldown_seconds, min_move, entry=entry))
    fires.write.mode("overwrite").parquet(f"{table}/batch={number}")
    waiting.filter(F.col("_at") > clock).select(*[c.split()[0] for c in CROSSED_DDL.split(", ")]).write.mode("overwrite").parquet(f"{state}/waiting/batch={number}")
    _last_fires(entry, fires).write.mode("overwrite").parquet(f"{state}/last/batch={number}")
    spark.createDataFrame([(clock,)], "clock bigint").coalesce(1).write.mode("overwrite").parquet(f"{state}/clock/batch={number}")
    for part in ("waiting", "last", "clock"):
        remove(spark, f"{state}/{part}/batch={number - 2}")


def with_regimes(fired: DataFrame, patterns: DataFrame) -> DataFrame:
    """Alerts with the regime (``cluster_id``) of the same exchange and symbol, null where none is known."""
    return fired.join(patterns.select("exchange", "symbol", "cluster_id"), ["exchange", "symbol"], "left")


def messages_of(
    fired: DataFrame,
    patterns: DataFrame | None,
    make: Callable[[], Classifier],
    provider: str = "mistral",
    fallback: Callable[[], Classifier] | None = None,
) -> DataFrame:
    """Alert rows to outgoing messages: text, regime of the same exchange and symbol, sentiment."""
    cols = [F.col(c) for c in ("symbol", "exchange", "price", "threshold", "condition", "ts")]
    rows = fired.withColumn("message", X.alert_text(*cols))
    if patterns is not None:
        rows = with_regimes(rows, patterns)
        rows = rows.withColumn("message", X.with_pattern(F.col("message"), F.col("cluster_id")))
    scored = score_texts(rows, "message", make, provider, fallback, "huggingface")
    scored = scored.withColumns({"sentiment_label": top_label(), "confidence": top_confidence()})
    return scored.withColumn("text", F.col("message")).withColumn(
        "message", X.with_sentiment(F.col("message"), F.col("provider"), F.col("sentiment_label"), F.col("confidence"))
    )


def sentiment_records(messages: DataFrame) -> DataFrame:
    """Stored records of the messages that got a sentiment."""
    extras = F.create_map(
        F.lit("alert_condition"), F.col("condition"), F.lit("all_labels"), F.to_json("labels"), F.lit("all_scores"), F.to_json("scores")
    )
    rows = messages.filter(F.col("sentiment_label").isNotNull()).withColumn("timestamp", F.col("ts"))
    return as_record(rows, extras)


def outbox(messages: DataFrame) -> DataFrame:
    """Messages worth sending, long ones as numbered parts within the service's limit."""
    kept = ["symbol", "exchange", "condition", "threshold", "ts", "price"]
    return messages.filter(X.is_sendable(F.col("message"))).select(*kept, F.posexplode(X.parts(F.col("message"))).alias("part", "message"))


def start_alert_cycle(
    quotes: DataFrame,
    rules: DataFrame,
    patterns: DataFrame | Callable[[DataFrame, DataFrame, int], DataFrame] | None,
    make: Callable[[], Classifier],
    sentiment_table: str,
    outbox_table: str,
    fired_table: str,
    state: str,
    checkpoint: str,
    fallback: Callable[[], Classifier] | None = None,
    min_move: float = MIN_MOVE,
    other_exchanges: bool = True,
    **trigger,
) -> StreamingQuery:
    """Fire, enrich, store sentiment, and put messages in an outbox table for a sender.

    ``patterns`` is a table of regimes, stored once, or a function of a batch's fires, quotes and number that
    detects them anew, as ``regimes.RegimeRing`` does from the newest bars.
    Sentiment goes to the same table as ``append_sentiment`` writes, by day and load. All writes of a batch bear
    its number, so a repeated batch replaces itself.
    """
    regimes = settle(patterns) if isinstance(patterns, DataFrame) else patterns

    def send(fires: DataFrame, quotes: DataFrame, number: int) -> None:
        found = settle(regimes(fires, quotes, number)) if callable(regimes) else regimes
        messages = messages_of(fires, found, make, "mistral", fallback).persist()
        try:
            append_sentiment(sentiment_records(messages), sentiment_table, f"cycle-{number:09d}")
            outbox(messages).write.mode("overwrite").parquet(f"{outbox_table}/batch={number}")
        finally:
            messages.unpersist()

    every = trigger or {"processingTime": "60 seconds"}
    return start_alerts(quotes, rules, fired_table, state, checkpoint, min_move=min_move, fallback=other_exchanges, then=send, **every)
