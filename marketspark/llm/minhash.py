"""Near copies by the exact likeness of their shingle sets, found by banded MinHash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketspark.llm.common import chunks, mix, stored
from marketspark.llm.sketches import bottom
from marketspark.operators.joins import join_small
from marketspark.session import ship_code

#: Sets of similarity 0.8 share a band with probability 1 - (1 - 0.8**ROWS)**BANDS = 0.996, those of 0.5 with 0.11.
BANDS = 30
ROWS = 8
#: Rounds in which each bucket is compared with its smallest id; what is then left is joined by its rarest shingles.
ROUNDS = 4
_WHOLE = 1 << 62
_random = np.random.default_rng(20240612)
_FACTORS = _random.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def bands(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Which texts have words, and their BANDS keys each."""
    sets = bottom(texts, _WHOLE, width)
    some = np.array([i for i, s in enumerate(sets) if len(s)], dtype=np.int64)
    keys = np.zeros((len(some), BANDS), dtype=np.uint64)
    if not len(some):
        return some, keys
    first = np.concatenate([[0], np.cumsum([len(sets[i]) for i in some])])[:-1]
    hashes = (np.concatenate([sets[i] for i in some]) >> np.uint64(20)).astype(np.uint32)
    for j, (factor, shift) in enumerate(zip(_FACTORS, _SHIFTS, strict=True)):
        least = np.minimum.reduceat((hashes ^ shift) * factor, first).astype(np.uint64)
        b = j // ROWS
        keys[:, b] = mix(keys[:, b] * np.uint64(31) + least + np.uint64(j))
    return some, keys


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sets; 0 if one is empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _verified(pairs: DataFrame, texts: DataFrame, least: float, width: int) -> DataFrame:
    """The ids of (id, lead) whose texts are alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            one, other = (bottom(batch.column(c), _WHOLE, width) for c in ("text", "other"))
            alike = np.array([similarity(a, b) >= least - 1e-9 for a, b in zip(one, other, strict=True)], dtype=bool)
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(alike))], ["id"])

    joined = pairs.join(texts, "id").join(texts.select(F.col("id").alias("lead"), F.col("text").alias("other")), "lead")
    return joined.select("id", "text", "other").mapInArrow(run, "id long")


def _alike(texts: DataFrame, least: float, width: int) -> DataFrame:
    """(id, lead), lead < id: all pairs of ``texts`` (id, text) that can have the similarity, without comparing all pairs.

    Sets are ordered from their rarest shingle on. Of two sets as alike as ``least`` the larger one has a shingle in
    its first part (what may be missing of it) that is in the shorter first part of the smaller one; and the place
    of the first such shingle leaves room for as many common ones as the similarity needs. Texts that share only
    what all share, such as a heading, thus never meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            sets = bottom(batch.column("text"), _WHOLE, width)
            size = np.array([len(s) for s in sets], dtype=np.int64)
            all_of = np.concatenate([*sets, np.zeros(0, dtype=np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column("id")), size)), pa.array(np.repeat(size, size)), pa.array(all_of)], ["id", "size", "h"])

    shingles = stored(texts.mapInArrow(run, "id long, size long, h long").distinct(), "shingles")
    common = shingles.groupBy("h").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("n", "h"))
    share = 2 * least / (1 + least)
    ranked = shingles.join(common, "h").withColumn("at", place).filter(F.col("at") <= F.col("size") - F.ceil(least * F.col("size") - 1e-9) + 1)
    ranked = stored(ranked.filter("n > 1").select("id", "size", "h", "at"), "first-shingles")
    small = ranked.filter(F.col("at") <= F.col("size") - F.ceil(share * F.col("size") - 1e-9) + 1).selectExpr("id AS id2", "size AS size2", "h", "at AS at2")
    fits = (F.struct("size2", "id2") < F.struct("size", "id")) & (F.col("size2") >= least * F.col("size") - 1e-9)
    room = F.least(F.col("size") - F.col("at"), F.col("size2") - F.col("at2")) + 1 >= share / 2 * (F.col("size") + F.col("size2")) - 1e-9
    return ranked.join(small, "h").filter(fits & room).select(F.greatest("id", "id2").alias("id"), F.least("id", "id2").alias("lead")).distinct()


def later_copies(docs: DataFrame, least: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id): ids whose text has at least the similarity ``least`` with the text of a smaller id.

    Of the ids not given, no two that share a band are that similar: an id goes as soon as it is like the
    smallest id left in one of its buckets, and the others are compared with the next smallest. So a group of
    copies costs one comparison a member; what five rounds leave is joined by rare shingles. Similarities are those of the whole shingle sets. Rows without an id
    or without words are in no bucket; rows that repeat an id are one document.
    """
    ship_code(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            some, keys = bands(batch.column("text"), width)
            ids = np.asarray(batch.column("id"))[some]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, BANDS)), pa.array(keys.view(np.int64).ravel())], ["id", "key"])

    live = stored(texts.mapInArrow(run, "id long, key long"), "bands")
    gone = own = None
    for _ in range(ROUNDS + 1):
        lead = live.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("last")).filter("lead < last").select("key", "lead")
        met = stored(live.join(lead, "key").filter("id > lead"), "met")
        if met.isEmpty():
            return docs.sparkSession.createDataFrame([], "doc_id long") if gone is None else gone.select(F.col("id").alias("doc_id")).distinct()
        if own is None:
            ids = met.select("id").unionAll(met.select(F.col("lead").alias("id"))).distinct()
            own = stored(join_small(texts, ids, ["id"]), "copies")
        found = stored(_verified(met.select("id", "lead").distinct(), own, least, width).distinct(), "later")
        gone = found if gone is None else gone.unionAll(found)
        live = stored(join_small(met.select("id", "key"), found, ["id"], "left_anti"), "left")
    crowded = live.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    rest = _alike(own.join(live.join(crowded, "key").select("id").distinct(), "id", "left_semi"), least, width)
    return gone.unionAll(_verified(rest, own, least, width)).select(F.col("id").alias("doc_id")).distinct()
