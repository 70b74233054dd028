"""Substring dedup: winnowed anchors as seeds, extended both ways to every repeated window of words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.llm.common import Rolling, Words, chunks, mix, stored, window_starts

#: Stands for a null id in the order of documents: after all others.
NO_ID = (1 << 63) - 1


class Runs:
    """Windows of ``length`` words and their anchors in some texts.

    A window's anchor is the k-gram of least hash in it, the leftmost of equals: equal windows have equal
    anchors at equal places. The windows of one text with the same anchor stand in a row, a run; ``context``
    is the hash of all words of a run, with its length and the anchor's place.
    """

    def __init__(self, texts: pa.Array, length: int, gram: int) -> None:
        self.words = Words(texts)
        hashes = self.words.hashes()
        rolling = Rolling(hashes)
        self.start, self.text = window_starts(self.words.first, length)
        if not len(self.start):
            self.window = self.anchor = self.context = np.zeros(0, dtype=np.uint64)
            self.run = self.first = np.zeros(0, dtype=np.int64)
            return
        self.window = rolling.of(self.start, length)
        grams = rolling.of(np.arange(len(hashes) - gram + 1), gram)
        place = _leftmost_least(grams, length - gram + 1)[self.start]
        begin = np.ones(len(place), dtype=bool)
        begin[1:] = (place[1:] != place[:-1]) | (self.text[1:] != self.text[:-1])
        self.first = np.flatnonzero(begin)
        self.run = np.cumsum(begin) - 1
        size = np.diff(np.append(self.first, len(place)))
        at = self.start[self.first]
        self.anchor = grams[place[self.first]]
        spot = (place[self.first] - at).astype(np.uint64) << np.uint64(32) | size.astype(np.uint64)
        self.context = mix(rolling.of(at, size + length - 1) + mix(spot))


def _leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least value of ``values[i : i + width]``, for each i that has them all."""
    best, at, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        right, right_at = best[step:], at[step:]
        left, left_at = best[: len(right)], at[: len(right)]
        lower = right < left
        best, at = np.where(lower, right, left), np.where(lower, right_at, left_at)
        have += step
    return at


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _within(values: np.ndarray, text: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Whether each value is in the list of its text."""
    wanted = lists.flatten().to_numpy(zero_copy_only=False)
    if not len(wanted):
        return np.zeros(len(values), dtype=bool)
    size = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    owner = np.repeat(np.arange(len(lists)), size)
    both = np.concatenate([wanted.view(np.uint64), values])
    texts = np.concatenate([owner, text])
    order = np.lexsort((both, texts))  # stable: of equals the wanted ones come first
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (both[order][1:] != both[order][:-1]) | (texts[order][1:] != texts[order][:-1])
    lead = order[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    out = np.zeros(len(both), dtype=bool)
    out[order] = lead < len(wanted)
    return out[len(wanted) :]


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, ctx, doc): the distinct runs of each document, by anchor and content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            made = Runs(batch.column("text"), length, gram)
            doc = batch.column("doc").to_numpy(zero_copy_only=False)[made.text[made.first]]
            if len(doc):
                yield pa.RecordBatch.from_arrays([_signed(made.anchor), _signed(made.context), pa.array(doc)], ["h", "ctx", "doc"])

    return docs.mapInArrow(run, "h long, ctx long, doc long")


def packed(docs: DataFrame) -> DataFrame:
    """(doc, blob): texts compressed for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in chunks(batches):
            texts = batch.column("text").cast(pa.large_binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array([press.compress(t.as_py() or b"") for t in texts], pa.binary())], ["doc", "blob"])

    return docs.mapInArrow(run, "doc long, blob binary")


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """The rows with their texts unpacked, in bounded chunks."""
    press = zstandard.ZstdDecompressor()
    texts, size, at = [], 0, 0
    for i, blob in enumerate(batch.column("blob")):
        text = press.decompress(blob.as_py())
        if texts and size + len(text) > 4 << 20:
            yield batch.slice(at, i - at), pa.array(texts, pa.large_binary()).cast(pa.large_string())
            texts, size, at = [], 0, i
        texts.append(text)
        size += len(text)
    if texts:
        yield batch.slice(at), pa.array(texts, pa.large_binary()).cast(pa.large_string())


def find_repeats(docs: DataFrame, length: int = 20, gram: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, spans (array of (start, end) in words).

    A span is a maximal row of words covered by windows of ``length`` words whose words also start earlier: in a
    document of smaller id or before in the same one. Seeds: each document hands out its winnowed anchors; runs
    of windows that agree with the anchor's first document entirely are settled by their content's hash, runs
    that differ are extended: their windows are compared one by one with those of all documents that differ
    there. Nothing is paired: firsts are minima (partial aggregates), and only they are joined back.

    Words are compared by 64-bit hashes (a wrong match is expected once in some 10**19 comparisons). Null texts
    have no words. Rows without an id come after all others and take nothing from each other, as do rows that
    share an id; such rows share what is known to start earlier. An empty table gives an empty result.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text_col).alias("text"))
    seeds = anchors(rows, length, gram)
    # Only anchors met again are kept, in a table: a join of two plain shuffles is one that Spark can split at a hot anchor.
    firsts = seeds.groupBy("h").agg(F.min("doc").alias("first"), F.min_by("ctx", "doc").alias("fctx"), F.count("*").alias("n")).filter("n > 1").drop("n")
    firsts = stored(firsts, "repeats-firsts")
    met = stored(seeds.join(firsts, "h").filter("doc <> first OR ctx <> fctx").select("doc", "ctx", "first", "fctx", (F.col("ctx") == F.col("fctx")).alias("same")), "repeats-met")
    open_runs = met.filter("NOT same").select("doc", "ctx").unionAll(met.filter("NOT same").select(F.col("first").alias("doc"), F.col("fctx").alias("ctx")).distinct())
    marks = met.filter("same").select("doc", "ctx", F.lit(True).alias("whole")).unionAll(open_runs.withColumn("whole", F.lit(False)))
    marks = stored(marks.groupBy("doc").agg(F.collect_set(F.when(F.col("whole"), F.col("ctx"))).alias("whole"), F.collect_set(F.when(~F.col("whole"), F.col("ctx"))).alias("open")), "repeats-marks")

    texts = packed(rows)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, column in _texts(batch):
                made = Runs(column, length, gram)
                wanted = _within(made.context, made.text[made.first], part.column("open"))[made.run] if len(made.run) else made.run
                doc = part.column("doc").to_numpy(zero_copy_only=False)
                pick = np.flatnonzero(wanted)
                pair = np.unique(np.stack([made.window[pick].view(np.int64), doc[made.text[pick]]]), axis=1)
                if pair.size:
                    yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["w", "doc"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, column in _texts(batch):
                made = Runs(column, length, gram)
                total = len(made.words.start)
                gone = np.zeros(len(made.start), dtype=bool)
                if len(gone):
                    gone = _within(made.context, made.text[made.first], part.column("whole"))[made.run]
                    gone |= _within(made.window, made.text, part.column("later"))
                    order = np.lexsort((made.window, made.text))
                    again = (made.window[order][1:] == made.window[order][:-1]) & (made.text[order][1:] == made.text[order][:-1])
                    gone[order[1:][again]] = True
                cover = np.zeros(total + 1, dtype=np.int64)
                np.add.at(cover, made.start[gone], 1)
                np.add.at(cover, made.start[gone] + length, -1)
                removed = np.cumsum(cover[:-1]) > 0
                yield _verdict(part.column("doc"), made.words, removed)

    found = texts.join(marks.filter(F.size("open") > 0).select("doc", "open"), "doc").mapInArrow(windows, "w long, doc long")
    found = stored(found, "repeats-windows")
    first = found.groupBy("w").agg(F.min("doc").alias("first"))
    later = found.join(first, "w").filter("doc <> first").groupBy("doc").agg(F.collect_set("w").alias("later"))
    last = texts.join(marks.select("doc", "whole"), "doc", "left").join(later, "doc", "left").select("doc", "blob", "whole", "later")
    out = last.mapInArrow(settle, "doc long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start long, end long>>")
    return out.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "n_words", "n_removed", "kept_sha256", "spans")


def _verdict(doc: pa.Array, words: Words, removed: np.ndarray) -> pa.RecordBatch:
    count = np.diff(words.first)
    n_removed, digests, spans = [], [], []
    raw = words.data
    for i, n in enumerate(count.tolist()):
        a, b = int(words.first[i]), int(words.first[i + 1])
        own = removed[a:b]
        k = int(own.sum())
        body = raw[words.start[a] : words.end[b - 1]].tobytes().split() if n and k < n else []
        if k and body:
            keep = np.flatnonzero(~own)
            body = [body[j] for j in keep.tolist()]
        turn = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))) if k else ()
        n_removed.append(k)
        digests.append(hashlib.sha256(b" ".join(body)).hexdigest())
        spans.append([{"start": int(s), "end": int(e)} for s, e in zip(turn[::2], turn[1::2], strict=True)])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.RecordBatch.from_arrays([doc, pa.array(count.astype(np.int64)), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, kind)], ["doc", "n_words", "n_removed", "kept_sha256", "spans"])
