"""Document fingerprints: bottom-k sketches of shingle hashes."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketspark.llm.common import CHUNK_BYTES, Rolling, Words, chunks, range_parts

#: Hashes lie in [0, 2**63), so that Spark's longs order them.
SPACE = float(1 << 63)


def bottom(texts: pa.Array, k: int, width: int) -> list[np.ndarray]:
    """The k least distinct hashes of each text's word shingles (A-Z folded), ascending.

    A text of fewer than ``width`` words is one shingle of all its words; without words the sketch is empty.
    """
    words = Words(texts)
    rolling = Rolling(words.hashes(lower=True))
    size = np.diff(words.first)
    span = np.minimum(size, width)
    count = np.where(size > 0, size - span + 1, 0)
    text = np.repeat(np.arange(len(size)), count)
    start = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + words.first[text]
    hashes = rolling.of(start, span[text]) >> np.uint64(1)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    fresh = np.ones(len(hashes), dtype=bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    hashes, text = hashes[fresh], text[fresh]
    first = np.searchsorted(text, np.arange(len(size) + 1))
    return [hashes[a : min(a + k, b)] for a, b in zip(first[:-1], first[1:], strict=True)]


def resemblance(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Estimated Jaccard likeness of two shingle sets; of two empty sets 1, of one 0."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:k]
    return float(np.isin(both, a, assume_unique=True)[np.isin(both, b, assume_unique=True)].sum() / len(both))


def distinct(a: np.ndarray, k: int) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / SPACE)


def containment(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    if not len(a):
        return 1.0
    union = distinct(np.union1d(a, b)[:k], k)
    return min(1.0, resemblance(a, b, k) * union / distinct(a, k))


def encoded(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def decoded(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), dtype=">u8").astype(np.uint64)


def sketch(docs: DataFrame, k: int = 128, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sketch array<long>, n_distinct): one row per row; null and wordless texts have an empty sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            made = bottom(batch.column("text"), k, width)
            lists = pa.array([x.astype(np.int64) for x in made], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array([distinct(x, k) for x in made], pa.float64())], ["doc_id", "sketch", "n_distinct"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, sketch array<long>, n_distinct double")


def merge(parts: DataFrame, key: str, k: int = 128) -> DataFrame:
    """Sketches of parts to one sketch per key: the k least hashes of all, as if the parts were one text's.

    Hashes beyond the k-th of a task are dropped before the shuffle, so a key with very many parts stays small.
    """
    rows = parts.select(key, F.explode("sketch").alias("h"))
    salted = rows.withColumn("salt", F.pmod("h", F.lit(32))).distinct()
    local = salted.withColumn("n", F.row_number().over(Window.partitionBy(key, "salt").orderBy("h"))).filter(F.col("n") <= k)
    rank = F.row_number().over(Window.partitionBy(key).orderBy("h"))
    return local.withColumn("n", rank).filter(F.col("n") <= k).groupBy(key).agg(F.array_sort(F.collect_list("h")).alias("sketch"))


_PAIRS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_distinct double"
_PAIR_NAMES = [x.split()[0] for x in _PAIRS.split(", ")]


def _pairs(ids: list, texts: list[str], k: int, width: int) -> pa.RecordBatch:
    """What is known of each text and of its edit by the next one; the last text only serves as next."""
    own = bottom(pa.array(texts, pa.large_string()), k, width)
    edits = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts[:-1], texts[1:], strict=True)]
    other = bottom(pa.array(edits, pa.large_string()), k, width)
    names = [encoded(x) for x in own[:-1]]
    columns = [
        pa.array(ids[:-1], pa.int64()),
        pa.array([len(t) for t in texts[:-1]], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edits], pa.string()),
        pa.array(names, pa.string()),
        pa.array([encoded(x) for x in other], pa.string()),
        pa.array([resemblance(a, b, k) for a, b in zip(own[:-1], other, strict=True)], pa.float64()),
        pa.array([resemblance(a, b, k) for a, b in zip(own[:-1], own[1:], strict=True)], pa.float64()),
        pa.array([distinct(a, k) for a in own[:-1]], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, _PAIR_NAMES)


def with_next(docs: DataFrame, k: int = 128, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of the text edited by its successor, and their likeness.

    Order: ascending id, null ids last, rows of one id by the hash of their text; after the last row comes the
    first (a lone row follows itself). The edit replaces the last floor(n / 2) code points by as many first ones
    of the next text. Null texts are empty. An empty table gives an empty result.

    Texts are dealt by ranges of the id once. Inside a part the next row is at hand; the last row of each part
    takes the first row of the next part with rows, in a join of one row per part. Where a row belongs is a
    function of the table alone, so both readings of the parts agree even if one is computed again.
    """
    spark = docs.sparkSession
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = range_parts(rows, count, "doc_id", F.xxhash64("text"))
    ranged = rows.sortWithinPartitions("part", F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        part = None
        for batch in _one_part(chunks(batches, limit=CHUNK_BYTES // 2)):
            if batch.column("part")[0].as_py() != part:
                part, ids, texts = batch.column("part")[0].as_py(), [], []
            ids += batch.column("doc_id").to_pylist()
            texts += batch.column("text").to_pylist()
            if len(ids) > 1:
                yield _pairs(ids, texts, k, width)
            ids, texts = ids[-1:], texts[-1:]

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in _one_part(batches):
            if last is None or last.column("part")[0].as_py() != batch.column("part")[0].as_py():
                if last is not None:
                    yield _edge(False, last)
                yield _edge(True, batch.slice(0, 1))
            last = batch.slice(batch.num_rows - 1)
        if last is not None:
            yield _edge(False, last)

    def joints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _pairs([row["doc_id"], None], [row["text"], row["next_text"]], k, width)

    ends = ranged.mapInArrow(edges, "part int, head boolean, doc_id long, text string")
    heads = ends.filter("head")
    order = Window.orderBy("part")  # one row per partition
    after = heads.select("part", F.coalesce(F.lead("part").over(order), F.first("part").over(order)).alias("after"))
    nexts = heads.select(F.col("part").alias("after"), F.col("text").alias("next_text"))
    tails = ends.filter("NOT head").select("part", "doc_id", "text")
    joined = tails.join(after, "part").join(nexts, "after").select("doc_id", "text", "next_text")
    return ranged.mapInArrow(inner, _PAIRS).unionAll(joined.mapInArrow(joints, _PAIRS))


def _one_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut where the part changes; no empty ones."""
    for batch in batches:
        part = batch.column("part").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        yield from (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a)


def _edge(head: bool, row: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([row.column("part"), pa.array([head]), row.column("doc_id"), row.column("text")], ["part", "head", "doc_id", "text"])
