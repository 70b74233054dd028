"""Paged candle reads from a service, as a Spark data source.

The transport is the user's function, so the same reader works over any client:
``transport(symbol, interval, start_ms, end_ms, limit, **settings)`` returns candle arrays in time order.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

from marketspark.operators.joins import join_small
from marketspark.schemas import CANDLE_DDL
from marketspark.session import ship_code

PAGE_ROWS = 1000
STEPS_MS = {"1m": 60_000, "3m": 180_000, "5m": 300_000, "15m": 900_000, "30m": 1_800_000, "1h": 3_600_000}


def paged_rows(transport: str, settings: dict, symbol: str, interval: str, start: int, end: int) -> Iterator[list[tuple]]:
    """Pages of typed candles from ``start`` to ``end``: the next page begins after the last close, an empty one ends."""
    module, name = transport.split(":")
    ask = getattr(importlib.import_module(module), name)
    while start <= end:
        page = ask(symbol, interval, start, end, PAGE_ROWS, **settings)
        if not page:
            return
        yield [
            (symbol, int(c[0]), *(float(x) for x in c[1:6]), int(c[6]), float(c[7]), int(c[8]), float(c[9]), float(c[10]))
            for c in page
        ]
        start = int(page[-1][6]) + 1


class PagedCandles(DataSource):
    """Options: ``transport`` ("module:function"), ``symbols`` (comma list) or ``instruments`` (path of a Parquet
    table with a column ``symbol``, read when the scan is planned), ``interval``, ``start`` and ``end`` (epoch ms),
    ``pages`` (pages per task, default 10); options starting with ``set_`` reach the transport as keyword settings.

    Conditions on ``symbol`` (equal, in) and ``open_time`` (bounds) are pushed down: other instruments and times are
    never asked for. As a stream it reads up to ``end`` and keeps one offset per instrument, the time from which
    it reads on; a query started again with a later ``end`` goes on from there, new instruments from ``start``.
    Between starts ``end`` may not go back, nor an instrument leave and return: that would read it again.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_candles"

    def schema(self) -> str:
        return CANDLE_DDL

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PagedStreamReader(dict(self.options))


class Span(InputPartition):
    def __init__(self, symbol: str, start: int, end: int):
        self.symbol, self.start, self.end = symbol, start, end


class Paged:
    """What the batch and the stream reader share: instruments, spans and pages."""

    def __init__(self, options: dict):
        self.options = options
        self.interval = options.get("interval", "15m")
        self.start, self.end = int(options["start"]), int(options["end"])

    def symbols(self) -> list[str]:
        if "instruments" not in self.options:
            return [s.strip() for s in self.options["symbols"].split(",")]
        import pyarrow.dataset as ds

        names = ds.dataset(self.options["instruments"]).to_table(columns=["symbol"])["symbol"].unique().to_pylist()
        return sorted(n for n in names if n is not None)

    def spans(self, symbol: str, start: int, end: int) -> list[Span]:
        """A long range becomes many tasks: each covers the time of a few full pages."""
        width = STEPS_MS[self.interval] * PAGE_ROWS * int(self.options.get("pages", 10))
        return [Span(symbol, at, min(at + width - 1, end)) for at in range(start, end + 1, width)]

    def read(self, part: Span | None) -> Iterator[tuple]:
        if part is None:  # nothing was planned
            return
        settings = {k[4:]: v for k, v in self.options.items() if k.startswith("set_")}
        for page in paged_rows(self.options["transport"], settings, part.symbol, self.interval, part.start, part.end):
            yield from page


class PagedReader(Paged, DataSourceReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Narrows instruments and times; Spark still applies every condition itself."""
        for f in filters:
            if f_on(f, "symbol", EqualTo, In):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = named if self.wanted is None else self.wanted & named
            elif f_on(f, "open_time", EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.start = max(self.start, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.end = min(self.end, f.value - isinstance(f, LessThan))
        return filters

    def partitions(self) -> list[Span]:
        asked = [s for s in self.symbols() if self.wanted is None or s in self.wanted]
        return [span for symbol in asked for span in self.spans(symbol, self.start, self.end)]


def f_on(condition: Filter, column: str, *kinds: type) -> bool:
    """Whether a pushed condition is of one of these kinds and on this column."""
    return isinstance(condition, kinds) and tuple(condition.attribute) == (column,)


class PagedStreamReader(Paged, DataSourceStreamReader):
    """Offsets hold, for every instrument, the first time that is not read yet."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {symbol: self.end + 1 for symbol in self.symbols()}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return [span for symbol, to in sorted(end.items()) for span in self.spans(symbol, start.get(symbol, self.start), to - 1)]


def _options(spark: SparkSession, transport: str, symbols: list[str] | str, start: int, end: int, interval: str, pages: int, settings: dict) -> dict[str, str]:
    ship_code(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedCandles)
    named = {"instruments": symbols} if isinstance(symbols, str) else {"symbols": ",".join(symbols)}
    options = {"transport": transport, "start": str(start), "end": str(end), "interval": interval, "pages": str(pages), **named}
    return options | {f"set_{k}": v for k, v in settings.items()}


def read_paged(spark: SparkSession, transport: str, symbols: list[str] | str, start: int, end: int, interval: str = "15m", pages: int = 10, **settings: str) -> DataFrame:
    """Candles of several symbols over a closed range of open times, read page by page until caught up.

    ``symbols`` are names, or the path of a Parquet table of instruments. Later filters on symbol and open time
    reach the service.
    """
    return spark.read.format("paged_candles").options(**_options(spark, transport, symbols, start, end, interval, pages, settings)).load()


def stream_paged(spark: SparkSession, transport: str, symbols: list[str] | str, start: int, end: int, interval: str = "15m", pages: int = 10, **settings: str) -> DataFrame:
    """``read_paged`` as a stream that remembers per instrument how far it has read."""
    return spark.readStream.format("paged_candles").options(**_options(spark, transport, symbols, start, end, interval, pages, settings)).load()


def read_instruments(instruments: DataFrame, transport: str, interval: str = "15m", pages: int = 10, tasks: int | None = None, **settings: str) -> DataFrame:
    """Candles of every row of ``instruments`` (``symbol``, ``start``, ``end`` in epoch ms, both included).

    The instruments stay a DataFrame: each becomes spans of a few pages, spans are dealt to ``tasks`` (four per core
    unless given), and a task holds one page at a time. Rows with a null ask for nothing.
    """
    spark = instruments.sparkSession
    ship_code(spark)
    width = STEPS_MS[interval] * PAGE_ROWS * pages
    asked = instruments.filter((F.col("start") <= F.col("end")) & F.col("symbol").isNotNull())
    spans = asked.select("symbol", "end", F.explode(F.sequence("start", "end", F.lit(width).cast("bigint"))).alias("start"))
    spans = spans.select("symbol", "start", F.least("end", F.col("start") + (width - 1)).alias("end"))
    names = [part.strip().split(" ")[0] for part in CANDLE_DDL.split(",")]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for symbol, start, end in batch.itertuples(index=False):
                for page in paged_rows(transport, settings, symbol, interval, int(start), int(end)):
                    yield pd.DataFrame(page, columns=names)

    dealt = spans.repartition(tasks or 4 * spark.sparkContext.defaultParallelism, "symbol", "start")
    return dealt.mapInPandas(ask, CANDLE_DDL)


def resumed(instruments: DataFrame, stored: DataFrame, start: int, end: int) -> DataFrame:
    """Each instrument (``symbol``) with the range it still lacks: after its last stored close, or from ``start``."""
    last = stored.groupBy("symbol").agg((F.max("close_time") + 1).alias("_next"))
    rows = join_small(instruments.select("symbol").distinct(), last, ["symbol"], "left")
    return rows.select("symbol", F.coalesce("_next", F.lit(start).cast("bigint")).alias("start"), F.lit(end).cast("bigint").alias("end"))


def months_back(now_ms: int, months: int = 6) -> int:
    """Start of the history load: 30 days per month before now."""
    return now_ms - months * 30 * 86_400_000


def from_table(symbol: str, interval: str, start_ms: int, end_ms: int, limit: int, store: str) -> list[list]:
    """Transport over a stored candle table (parquet), for replays and tests.

    Each look reads only the time that ``limit`` candles can fill; over gaps it looks on, so that only the end is empty.
    """
    import pyarrow.compute as pc
    import pyarrow.dataset as ds

    names = [part.strip().split(" ")[0] for part in CANDLE_DDL.split(",")][1:]
    table, width = ds.dataset(store), STEPS_MS[interval] * limit
    while start_ms <= end_ms:
        upto = min(start_ms + width - 1, end_ms)
        wanted = (pc.field("symbol") == symbol) & (pc.field("open_time") >= start_ms) & (pc.field("open_time") <= upto)
        page = table.to_table(columns=names, filter=wanted).sort_by("open_time").slice(0, limit)
        if page.num_rows:
            return [[*row.values(), "0"] for row in page.to_pylist()]
        start_ms, width = upto + 1, width * 2
    return []
