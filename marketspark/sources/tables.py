"""Candle, sentiment and rule tables on files."""

from __future__ import annotations

import uuid
from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.operators.candles import keep_one
from marketspark.schemas import CANDLE_DDL, RULE_DDL
from marketspark.session import new_path, remove

# Rules in force where no rule file exists.
DEFAULT_RULES = [
    ("BTC/USDT", "binance", 70000.0, "above", None),
    ("ETH/USDT", "binance", 4000.0, "above", None),
]


def parse_candle_pages(df: DataFrame, page: str = "value") -> DataFrame:
    """Pages of 12-slot candle arrays (text) to typed rows; the last slot is dropped.

    ``df`` has ``symbol`` and the page text. Slots hold numbers or numeric strings.
    """
    rows = df.select("symbol", F.explode(F.from_json(page, "array<array<string>>")).alias("c"))
    names = [part.strip().split(" ") for part in CANDLE_DDL.split(",")][1:]
    return rows.select("symbol", *[F.col("c").getItem(i).try_cast(kind).alias(name) for i, (name, kind) in enumerate(names)])


def read_tickers(spark: SparkSession, path: str, symbols: list[str] | None = None) -> DataFrame:
    """Snapshot of last prices (JSON lines), for the wanted symbols only."""
    rows = spark.read.schema("symbol string, price double").json(path)
    return rows.filter(F.col("symbol").isin(*symbols)) if symbols else rows


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Alert rules from a JSON array; the default rules where the file does not exist.

    A file that is no JSON or holds values of a wrong type is an error when it is read, as are rules without
    symbol, threshold or condition: a broken rule must not become one that never fires.
    """
    try:
        rules = spark.read.schema(RULE_DDL).option("multiLine", True).option("mode", "FAILFAST").json(path)
        needed = [F.col(c).isNull() for c in ("symbol", "threshold", "condition")]
        broken = F.raise_error(F.concat(F.lit(f"incomplete rule in {path}: "), F.to_json(F.struct(*rules.columns))))
        rules = rules.withColumn("symbol", F.when(needed[0] | needed[1] | needed[2], broken.cast("string")).otherwise(F.col("symbol")))
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        rules = spark.createDataFrame(DEFAULT_RULES, RULE_DDL)
    return rules.withColumn("exchange", F.coalesce("exchange", F.lit("binance")))


def write_candles(df: DataFrame, path: str, whole: bool = False) -> None:
    """Candles partitioned by symbol and day, one row per (symbol, open time), last copy wins.

    Rows are merged with the stored rows of the (symbol, day) partitions that they touch: a new copy of a candle
    replaces the stored one, all other stored candles stay, and a repeated load changes nothing. The merged
    partitions are staged in the shared folder before they replace the old ones, so nothing is read from where it
    is written. ``whole`` replaces the table. Rows are spread over (symbol, day) before the write, so a symbol
    with much history becomes many files, each sorted by time. Copies inside one load are told apart by ``seq``
    where there is one.
    """
    spark = df.sparkSession
    order = [c for c in ("seq", "close_time") if c in df.columns][:1]
    rows = keep_one(df, ["symbol", "open_time"], order).withColumn("open_date", F.timestamp_millis("open_time").cast("date"))
    stage = None
    if not whole and (stored := _stored_candles(spark, path)) is not None:
        touched = rows.select("symbol", "open_date").distinct()
        kept = stored.join(touched, ["symbol", "open_date"], "left_semi").join(rows.select("symbol", "open_time"), ["symbol", "open_time"], "left_anti")
        stage = new_path(spark, "candle-load")
        merged = rows.unionByName(kept, allowMissingColumns=True)
        merged.write.parquet(stage)
        rows = spark.read.schema(merged.schema).parquet(stage)
    rows = rows.repartition("symbol", "open_date").sortWithinPartitions("symbol", "open_date", "open_time")
    mode = "static" if whole else "dynamic"
    rows.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("symbol", "open_date").parquet(path)
    if stage:
        remove(spark, stage)


def _stored_candles(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        found = spark.read.parquet(path)
    except AnalysisException as error:
        if not any(x in str(error) for x in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")):
            raise
        return None
    return found.withColumns({"symbol": F.col("symbol").cast("string"), "open_date": F.col("open_date").cast("date")})


def read_candles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CANDLE_DDL + ", open_date date").parquet(path)


def append_sentiment(df: DataFrame, path: str, load: str | None = None) -> None:
    """Append records to the sentiment table, by day and load; an empty load changes nothing.

    A load that is written again under the same name replaces itself, so a repeated batch doubles nothing.
    """
    rows = df.withColumns({"day": F.col("timestamp").cast("date"), "load": F.lit(load or f"load-{uuid.uuid4().hex}")})
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "load").parquet(path)


def retained(df: DataFrame, now, seconds: int = 365 * 24 * 3600, time: str = "timestamp") -> DataFrame:
    """Rows not older than the retention."""
    return df.filter(F.col(time) > now - F.make_dt_interval(secs=F.lit(seconds)))


def drop_expired(spark: SparkSession, path: str, today: date, days: int = 365) -> int:
    """Remove the day partitions of a table that are wholly older than the retention; how many went."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    names = [x.getPath().getName() for x in listed]
    old = [n for n in names if n.startswith("day=") and n[4:] < (today - timedelta(days=days)).isoformat() and n[4].isdigit()]
    return sum(remove(spark, f"{path}/{n}") for n in old)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def copy_table(spark: SparkSession, source: str, target: str) -> None:
    spark.read.parquet(source).write.mode("errorifexists").parquet(target)
