"""Few large files in place of the many small ones that a stream leaves."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.session import remove

#: Bytes of stored parts that become one file.
TARGET_BYTES = 256 << 20


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _folders(spark: SparkSession, path: str, key: str) -> list[str]:
    """Values of the partition folders ``key=…`` right below a path."""
    where, store = _files(spark, path)
    if not store.exists(where):
        return []
    names = [x.getPath().getName() for x in store.listStatus(where) if x.isDirectory()]
    return sorted(n.split("=", 1)[1] for n in names if n.startswith(f"{key}="))


def _packed_upto(spark: SparkSession, packed: str) -> dict[str, int]:
    """The newest packed part of each day: up to which batch it goes. A part is there as a whole or not at all."""
    found = {day: [int(n) for n in _folders(spark, f"{packed}/open_date={day}", "upto")] for day in _folders(spark, packed, "open_date")}
    return {day: max(parts) for day, parts in found.items() if parts}


def _by_day(rows: DataFrame, how: str = "inner", **facts: dict[str, int]) -> DataFrame:
    """Rows with facts about their day; the list of days goes to all tasks, the calendar bounds it."""
    days = sorted(set().union(*facts.values()))
    table = [(day, *[fact.get(day) for fact in facts.values()]) for day in days]
    listed = rows.sparkSession.createDataFrame(table, "day string, " + ", ".join(f"{name} int" for name in facts))
    listed = listed.withColumn("open_date", F.col("day").cast("date")).drop("day")
    return rows.join(F.broadcast(listed), "open_date", how).select(*rows.columns, *facts)


def _packed_rows(spark: SparkSession, packed: str, upto: dict[str, int]) -> DataFrame:
    return spark.read.option("basePath", packed).parquet(*[f"{packed}/open_date={day}/upto={n}" for day, n in upto.items()]).drop("upto")


def _newer(spark: SparkSession, table: str, packed: str, upto: dict[str, int]) -> DataFrame:
    """The rows of the parts after the packed ones, with their batch."""
    if not upto:
        return spark.read.parquet(table)
    like = _packed_rows(spark, packed, upto).schema.add("batch", "integer")  # all parts may be packed and gone
    rows = spark.read.schema(like).parquet(table)
    after = _by_day(rows, "left", _upto=upto)
    return after.filter(F.col("_upto").isNull() | (F.col("batch") > F.col("_upto"))).drop("_upto")


def read_ingested(spark: SparkSession, table: str, packed: str) -> DataFrame:
    """The rows of a table that ``start_ingest`` writes and ``compact`` packs: of each day its newest packed part
    and the parts of later batches. Each row is there once, whether a compaction is before, in or after its commit."""
    upto = _packed_upto(spark, packed)
    later = _newer(spark, table, packed, upto).drop("batch")
    return later.unionByName(_packed_rows(spark, packed, upto)) if upto else later


def compact(spark: SparkSession, table: str, packed: str, target_bytes: int = TARGET_BYTES, least_parts: int = 2) -> int:
    """Pack every day with at least ``least_parts`` parts newer than its packed one; how many days were packed.

    A day's rows become about one file per ``target_bytes`` of its parts, sorted by symbol and time. They are
    written under a temporary name and moved to ``packed/open_date=…/upto=<newest batch>`` when complete, so
    readers see the state before or after. What a packed part replaces stays for readers that have begun, until
    ``forget_packed``; batches that come while it runs are left to the next compaction. All days are one job;
    only the list of days and batches is on the driver.
    """
    upto = _packed_upto(spark, packed)
    todo: dict[str, int] = {}
    files: dict[str, int] = {}
    for day in _folders(spark, table, "open_date"):
        fresh = [n for n in map(int, _folders(spark, f"{table}/open_date={day}", "batch")) if n > upto.get(day, -1)]
        if len(fresh) >= least_parts:
            paths = [f"{table}/open_date={day}/batch={n}" for n in fresh] + ([f"{packed}/open_date={day}/upto={upto[day]}"] if day in upto else [])
            size = sum(store.getContentSummary(where).getLength() for where, store in (_files(spark, x) for x in paths))
            todo[day], files[day] = max(fresh), max(1, round(size / target_bytes))
    if not todo:
        return 0
    rows = _by_day(_newer(spark, table, packed, upto), _to=todo).filter("batch <= _to").drop("batch", "_to")
    if again := {day: n for day, n in upto.items() if day in todo}:
        rows = rows.unionByName(_packed_rows(spark, packed, again))
    places, total = {}, 0  # every file of every day is a partition of its own
    for day, n in files.items():
        places[day], total = total, total + n
    dealt = _by_day(rows, _files=files, _place=places)
    part = F.col("_place") + F.pmod(F.xxhash64("symbol", F.expr("open_time div 3600000")), F.col("_files"))
    stage = f"{packed}/_staged-{uuid.uuid4().hex}"
    in_order = dealt.repartitionById(total, part.cast("int")).sortWithinPartitions("open_date", "symbol", "open_time")
    in_order.drop("_place", "_files").write.partitionBy("open_date").parquet(stage)
    for day, newest in todo.items():
        source, store = _files(spark, f"{stage}/open_date={day}")
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{packed}/open_date={day}/upto={newest}")
        store.mkdirs(target.getParent())
        if store.exists(target) or not store.rename(source, target):
            raise RuntimeError(f"{target} was packed by another job")
    remove(spark, stage)
    return len(todo)


def forget_packed(spark: SparkSession, table: str, packed: str) -> int:
    """Remove the parts that packed ones replace, when no reader can still hold them; how many went."""
    gone = 0
    for day, newest in _packed_upto(spark, packed).items():
        old = [f"{table}/open_date={day}/batch={n}" for n in _folders(spark, f"{table}/open_date={day}", "batch") if int(n) <= newest]
        old += [f"{packed}/open_date={day}/upto={n}" for n in _folders(spark, f"{packed}/open_date={day}", "upto") if int(n) < newest]
        gone += sum(remove(spark, path) for path in old)
    return gone
