"""What the corpus operators share: words as arrays, rolling hashes, bounded chunks, hand-over tables."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.session import new_path, ship_code

#: Bytes of text that are turned into arrays at a time; a longer text is a chunk of its own.
CHUNK_BYTES = 4 << 20

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

_random = np.random.default_rng(20240611)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_STEP = 0x9E3779B97F4A7C15 | 3
_WORD_STEP = 0xD1342543DE82EF95 | 3
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(step: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """step**i and its inverse modulo 2**64, for i below n at least."""
    if step not in _powers or len(_powers[step][0]) < n:
        size = max(n, 1 << 16)
        made = []
        for base in (step, pow(step, -1, 1 << 64)):
            row = np.full(size, base, dtype=np.uint64)
            row[0] = 1
            made.append(np.cumprod(row, dtype=np.uint64))
        if size > 4 * CHUNK_BYTES:
            return made[0], made[1]  # one giant text; not worth keeping
        _powers[step] = made[0], made[1]
    return _powers[step]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 bits of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of some texts as byte ranges.

    ``start`` and ``end`` are positions in ``data``; words ``first[i]:first[i + 1]`` are those of text i. Other
    bytes than blanks can be given as what separates words, as a table of 256 flags.
    """

    def __init__(self, column: pa.Array, separator: np.ndarray = SEPARATOR) -> None:
        self.data, offsets = text_bytes(column)
        inside = ~separator[self.data]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        begin[heads] = inside[heads]
        self.start = np.flatnonzero(begin)
        last = inside
        if len(last):
            last[:-1] &= ~inside[1:] | begin[1:]
        self.end = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, offsets)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes, with A-Z folded if asked."""
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        data = fold(self.data) if lower else self.data
        up, down = powers(_BYTE_STEP, len(data))
        value = _BYTE[data]
        value *= up[: len(data)]
        total = np.cumsum(value, dtype=np.uint64)
        rolled = (total[self.end - 1] - total[self.start] + value[self.start]) * down[self.start]
        return mix(rolled)


class Rolling:
    """Hashes of runs of consecutive words in constant time each."""

    def __init__(self, words: np.ndarray) -> None:
        up, self.down = powers(_WORD_STEP, len(words) + 1)
        self.total = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(words * up[: len(words)], dtype=np.uint64, out=self.total[1:])

    def of(self, start: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        return mix((self.total[start + length] - self.total[start]) * self.down[start])


def fold(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and where each text begins; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(offsets) < 2:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that one holds at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        column = batch.column(text)
        sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def window_starts(first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and text number of every run of ``length`` words inside one text."""
    count = np.maximum(np.diff(first) - length + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[text], text


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Written to the shared folder and read back: cuts lineage, outlives executors, is computed once."""
    spark = df.sparkSession
    ship_code(spark)
    path = new_path(spark, name)
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def quoted(name: str) -> str:
    """A column's name as it stands in expressions, whatever dots or blanks it has."""
    return "`" + name.replace("`", "``") + "`"


def numbered(docs: DataFrame, text_col: str, *leave: str) -> tuple[DataFrame, list[str]]:
    """The columns of ``docs`` but ``leave`` as c0, c1, … with their names, and the text once more as ``text``.

    Names of any form thus pass through, and none clashes with what an operator adds; ``toDF`` brings them back.
    """
    names = [c for c in docs.columns if c not in leave]
    return docs.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(names)], F.col(quoted(text_col)).alias("text")), names


#: Stands for a null id where rows are put in order: after all others.
LAST_ID = (1 << 63) - 1


def range_parts(df: DataFrame, count: int, key: str, tie: Column | None = None, like: DataFrame | None = None, per_part: int = 50) -> DataFrame:
    """``df`` dealt over at most ``count`` partitions by ranges of a long ``key`` (nulls last), with their number in ``part``.

    Unlike Spark's own range partitioning the bounds are a function of the rows alone (quantiles of the keys with
    the smallest hashes, about ``per_part`` a partition), so that every reading of the plan, a repeated stage and
    a later run deal alike. Rows of one key stay together unless ``tie`` (a long) tells them apart. ``like`` has the
    keys to take the bounds from, where it is cheaper to read than ``df``.
    """
    made = {"_k": F.coalesce(F.col(key).cast("long"), F.lit(LAST_ID)), "_t": F.lit(0).cast("long") if tie is None else tie}
    keyed, shown = df.withColumns(made), (df if like is None else like).withColumns(made)
    rows = shown.count()
    draw = F.shiftrightunsigned(F.xxhash64("_k", "_t"), 11) / F.lit(float(1 << 53))
    drawn = shown.filter(draw < min(1.0, per_part * count / max(rows, 1))).select("_k", "_t").toArrow()
    k, t = drawn.column("_k").to_numpy(), drawn.column("_t").to_numpy()
    pick = np.lexsort((t, k))[len(k) * np.arange(1, count) // count] if len(k) else np.zeros(0, dtype=np.int64)
    bounds = sorted({*zip(k[pick].tolist(), t[pick].tolist(), strict=True)})
    high = np.array([k for k, _ in bounds], dtype=np.int64)

    def place(k: pd.Series, t: pd.Series) -> pd.Series:
        """How many bounds are at or below (k, t)."""
        wanted = k.to_numpy()
        left, right = np.searchsorted(high, wanted, "left"), np.searchsorted(high, wanted, "right")
        for i in np.flatnonzero(left < right):
            left[i] = bisect.bisect_right(bounds, (int(wanted[i]), int(t.iloc[i])))
        return pd.Series(left.astype(np.int32))

    part = F.pandas_udf(place, "int")("_k", "_t")
    return keyed.withColumn("part", part).drop("_k", "_t").repartitionById(count, F.col("part"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
