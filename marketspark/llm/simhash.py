"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.llm.common import stored
from marketspark.llm.components import components

BITS = 64
#: Shingles whose bits are added up as bytes before a byte could overflow.
_BLOCK = 255


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of a text's word shingles (A-Z folded); 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(line, seed)], dtype=np.uint64)
    else:
        length = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(length + 1) - 1
        start = end - length
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(line[a:b], seed) for a, b in zip(start.tolist(), end[width - 1 :].tolist(), strict=False)], dtype=np.uint64)
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).view(np.uint64).reshape(-1, BITS // 8)
    sums = np.add.reduceat(bits, np.arange(0, len(bits), _BLOCK), axis=0).view(np.uint8)
    count = sums.reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(count * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the 64 bits as a signed long. A null or wordless text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            made = [fingerprint(t.as_py() or b"", width, seed) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(np.array(made, dtype=np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _ball(value: str, width: int, radius: int) -> str:
    """SQL: ``value`` with up to ``radius`` of its zero bits set.

    Of two segments that differ in one bit, one has the bit unset: setting alone meets each such pair once.
    For a radius above one, pairs that differ both ways meet half-way round only if all changes are made,
    so then every bit is flipped.
    """
    ball = f"array({value})"
    for _ in range(radius):
        step = f"IF(x & shiftleft(1L, i) = 0, x | shiftleft(1L, i), {'NULL' if radius == 1 else 'x ^ shiftleft(1L, i)'})"
        ball = f"array_distinct(concat({ball}, filter(flatten(transform({ball}, x -> transform(sequence(0, {width - 1}), i -> {step}))), y -> y IS NOT NULL)))"
    return ball


def links(fps: DataFrame, distance: int = 2, segments: int = 2) -> DataFrame:
    """Pairs (a, b) of different fingerprints of ``fps`` (fp, distinct) that differ in at most ``distance`` bits.

    Multi-index hashing: with m segments two such fingerprints differ in at most distance // m bits of some
    segment. Every fingerprint is filed in a table per segment and looks up the Hamming ball of its own segment
    there; what it finds is verified over all 64 bits inside the join, so candidates are never written.
    """
    if segments < 2 or BITS % segments:
        raise ValueError("segments must divide 64, and be two or more")
    width, radius = BITS // segments, distance // segments
    mask = (1 << width) - 1
    parts = [f"named_struct('s', {s}, 'v', shiftrightunsigned(fp, {s * width}) & {mask}L)" for s in range(segments)]
    filed = fps.select("fp", F.expr(f"inline(array({', '.join(parts)}))")).select(F.col("fp").alias("b"), "s", "v")
    sought = fps.select("fp", F.expr(f"inline(array({', '.join(parts)}))")).select(F.col("fp").alias("a"), "s", F.explode(F.expr(_ball("v", width, radius))).alias("v"))
    near = F.expr(f"a <> b AND bit_count(a ^ b) <= {distance}")
    return sought.join(filed, ["s", "v"]).filter(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, distance: int = 2, segments: int = 2, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id (smallest id reachable over links, itself included).

    Documents of one fingerprint are one node, so copies are never paired. Null and empty texts share
    fingerprint 0; repeated ids stay as rows and are nodes of their texts; a row with a null id belongs to its
    fingerprint's component (null if no row there has an id). An empty table gives an empty result.
    """
    fps = stored(fingerprints(docs, width, id_col=id_col, text_col=text_col), "simhash")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    pairs = links(nodes.select("fp"), distance, segments)
    named = pairs.join(nodes.select(F.col("fp").alias("a"), F.col("rep").alias("x")), "a").join(nodes.select(F.col("fp").alias("b"), F.col("rep").alias("y")), "b")
    roots = components(named.select(F.col("x").alias("a"), F.col("y").alias("b")))
    labelled = nodes.join(roots, nodes.rep == roots.node, "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return fps.join(labelled, "fp").select("doc_id", "fp", "component_id")
