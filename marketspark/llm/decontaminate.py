"""Benchmark decontamination: CGK embeddings, bit-sampling LSH and exact edit verification."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.llm.common import Rolling, Words, chunks, quoted, window_starts
from marketspark.session import ship_code

#: Sampled coordinates per key.
SAMPLES = 3
#: Measured chance that one coordinate of the embeddings agrees at the edit threshold, over all starts of a passage of up to PIECE words.
AGREES = 0.55
#: Longer items are searched by pieces of at most so many words, as walks of long sequences drift apart.
PIECE = 25
#: Items of one class differ in length by less than this factor.
LADDER = 1.15
#: Embedding steps per word of the class; a step moves on by half a word on average.
STEPS = 1.6


def repetitions(recall: float) -> int:
    """Hash tables needed for a recall at the threshold."""
    return math.ceil(math.log(1 - recall) / math.log(1 - AGREES**SAMPLES))


class Matcher:
    """Finds passages within the edit threshold of some items; built once per task from the items' texts."""

    def __init__(self, items: list[tuple[int | None, str]], similarity: float, recall: float, least_words: int, seed: int = 7) -> None:
        self.ids = [i for i, _ in items]
        words = Words(pa.array([t for _, t in items], pa.string()))
        hashes = words.hashes(lower=True)
        own = [hashes[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        self.items = [(k, w) for k, w in enumerate(own) if len(w) >= least_words]
        self.edits = [int((1 - similarity) * len(w) + 1e-9) for w in own]
        self.words = own
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in sorted({len(w) for w in own if 0 < len(w) < least_words}):
            members = np.array([k for k, w in enumerate(own) if len(w) == size])
            keys = Rolling(np.concatenate([own[k] for k in members])).of(np.arange(len(members)) * size, size)
            order = np.argsort(keys, kind="stable")
            self.short[size] = keys[order], members[order]
        # Of a passage within the item's edit rate, some piece has no higher rate.
        self.pieces = []
        for k, w in self.items:
            cuts = np.linspace(0, len(w), -(-len(w) // PIECE) + 1).astype(int).tolist()
            self.pieces += [(k, a, w[a:b], int((1 - similarity) * (b - a) + 1e-9)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.vocabulary = np.unique(np.concatenate([w for _, w in self.items] or [np.zeros(0, np.uint64)]))
        self.flags = np.zeros(1 << 20, dtype=bool)
        self.flags[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True
        random = np.random.default_rng(seed)
        self.rounds = [(np.uint64(int(random.integers(1, 1 << 63)) * 2 + 1), np.sort(random.random(SAMPLES))) for _ in range(repetitions(recall))]
        classes: dict[int, list[int]] = {}
        for n, (_, _, w, _) in enumerate(self.pieces):
            classes.setdefault(int(math.log(len(w), LADDER)), []).append(n)
        self.classes = []
        for members in classes.values():
            parts = [self.pieces[n][2] for n in members]
            low = min(len(w) for w in parts)
            miss = max(self.pieces[n][3] for n in members)
            steps = max(SAMPLES, int(low * STEPS))
            size = max(len(w) for w in parts) + steps
            padded = np.zeros(len(members) * size, dtype=np.uint64)
            for n, w in enumerate(parts):
                padded[n * size : n * size + len(w)] = w
            begin = np.arange(len(members)) * size
            tables = []
            for factor, places in self.rounds:
                keys = self._walk(padded * factor, begin, self._places(places, steps))
                order = np.argsort(keys, kind="stable")
                flags = np.zeros(1 << 16, dtype=bool)
                flags[(keys >> np.uint64(48)).astype(np.int64)] = True
                tables.append((keys[order], np.array(members)[order], flags))
            self.classes.append((low, miss, steps, tables))
        self.longest = max([c[2] for c in self.classes], default=0)

    @staticmethod
    def _places(places: np.ndarray, steps: int) -> list[int]:
        return np.sort((places * steps).astype(int)).tolist()

    @staticmethod
    def _walk(symbols: np.ndarray, begin: np.ndarray, places: list[int]) -> np.ndarray:
        """Sampled coordinates of the CGK embedding of the sequences that start at ``begin``, as one key.

        Step j writes the symbol under the pointer; whether the pointer moves is a random bit of step and symbol.
        """
        at = begin.astype(np.int64)
        key = np.zeros(len(at), dtype=np.uint64)
        for j in range(places[-1] + 1):
            seen = symbols[at]
            for _ in range(places.count(j)):
                key = (key + seen) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            at += ((seen >> np.uint64(63 - j % 40)) & np.uint64(1)).astype(np.int64)
        return key

    def known(self, hashes: np.ndarray) -> np.ndarray:
        found = self.flags[(hashes >> np.uint64(44)).astype(np.int64)]
        some = np.flatnonzero(found)
        if len(some):
            where = np.minimum(np.searchsorted(self.vocabulary, hashes[some]), len(self.vocabulary) - 1)
            found[some] = self.vocabulary[where] == hashes[some]
        return found

    def match(self, column: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, first word, word behind, edits): the passages of each item in each text that do not overlap, best first."""
        words = Words(column)
        if not len(words.start):
            return
        hashes = words.hashes(lower=True)
        yield from self._exact(hashes, words.first)
        if not self.items:
            return
        total = len(hashes)
        text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
        strange = np.concatenate([[0], np.cumsum(~self.known(hashes), dtype=np.int64)])
        near = [np.zeros((0, 2), dtype=np.int64)]
        begins = []
        for low, miss, _, _ in self.classes:
            # No passage within the threshold has more words foreign to all items, or missing at the text's end, than edits.
            wanted = np.arange(total) + low
            behind = np.minimum(wanted, words.first[text + 1])
            begins.append(np.flatnonzero(strange[behind] - strange[:-1] + wanted - behind <= miss))
        for r, (factor, places) in enumerate(self.rounds):
            symbols = np.concatenate([hashes * factor, np.zeros(self.longest + 1, dtype=np.uint64)])
            for begin, (_, _, steps, tables) in zip(begins, self.classes, strict=True):
                if not len(begin):
                    continue
                keys, members, flags = tables[r]
                key = self._walk(symbols, begin, self._places(places, steps))
                maybe = np.flatnonzero(flags[(key >> np.uint64(48)).astype(np.int64)])
                left, right = np.searchsorted(keys, key[maybe], "left"), np.searchsorted(keys, key[maybe], "right")
                count = right - left
                if count.any():
                    source = np.repeat(np.arange(len(maybe)), count)
                    piece = members[left[source] + np.arange(len(source)) - np.repeat(np.cumsum(count) - count, count)]
                    near.append(np.stack([piece, begin[maybe[source]]], axis=1))
        yield from self._verify(np.unique(np.concatenate(near), axis=0), hashes, words.first, text)

    def _exact(self, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """Where the items too short for edits stand word for word, leftmost first."""
        rolling = Rolling(hashes) if self.short else None
        for size, (keys, members) in self.short.items():
            start, text = window_starts(first, size)
            key = rolling.of(start, size)
            left, right = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            free: dict[tuple[int, int], int] = {}
            for i in np.flatnonzero(left < right).tolist():
                own, at = int(text[i]), int(start[i])
                for item in members[left[i] : right[i]].tolist():
                    if at >= free.get((own, item), 0):
                        free[own, item] = at + size
                        yield own, item, at - int(first[own]), at - int(first[own]) + size, 0

    def _verify(self, near: np.ndarray, hashes: np.ndarray, first: np.ndarray, text: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        spots = []
        for piece, at in near.tolist():
            _, _, wanted, edits = self.pieces[piece]
            own = int(text[at])
            spots.append((piece, own, max(int(first[own]), at - edits - 4), min(int(first[own + 1]), at + len(wanted) + edits + 4)))
        around = []
        for piece, own, a, b in joined(spots):
            item, offset, wanted, edits = self.pieces[piece]
            size = len(self.words[item])
            if len(wanted) < size:
                if nearest(wanted.tolist(), hashes[a:b].tolist())[0] > edits:
                    continue
                a = max(int(first[own]), a - offset - self.edits[item])
                b = min(int(first[own + 1]), b + size - offset - len(wanted) + self.edits[item])
            around.append((item, own, a, b))
        for item, own, a, b in joined(sorted(around)):
            for start, end, edits in passages(self.words[item].tolist(), hashes[a:b].tolist(), self.edits[item]):
                yield own, item, a + start - int(first[own]), a + end - int(first[own]), edits


def joined(regions: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Sorted (item or piece, text, from, to) with those that overlap made one."""
    out: list[tuple[int, int, int, int]] = []
    for k, own, a, b in regions:
        if out and out[-1][:2] == (k, own) and a <= out[-1][3]:
            out[-1] = k, own, out[-1][2], max(out[-1][3], b)
        else:
            out.append((k, own, a, b))
    return out


def scores(wanted: list[int], body: list[int], anchored: bool = False) -> Iterator[int]:
    """Least edits between ``wanted`` and a run of ``body`` that ends with each word of ``body``.

    Bit-parallel dynamic programming over one column per word; ``anchored`` runs begin at the start of ``body``.
    """
    masks: dict[int, int] = {}
    for i, w in enumerate(wanted):
        masks[w] = masks.get(w, 0) | 1 << i
    size = len(wanted)
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score = full, 0, size
    for w in body:
        eq = masks.get(w, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(xh | plus))
        down = plus & xh
        score += 1 if up & top else -1 if down & top else 0
        up = (up << 1 | anchored) & full
        down = (down << 1) & full
        plus = down | (full & ~(xv | up))
        minus = up & xv
        yield score


def nearest(wanted: list[int], body: list[int], anchored: bool = False) -> tuple[int, int]:
    """Least edits between ``wanted`` and a run of ``body``, and the run's (first best) end; of an empty run at first."""
    best, end = len(wanted), 0
    for j, score in enumerate(scores(wanted, body, anchored)):
        if score < best:
            best, end = score, j + 1
    return best, end


def passages(wanted: list[int], body: list[int], most: int) -> list[tuple[int, int, int]]:
    """(start, end, edits) of runs of ``body`` within ``most`` edits of ``wanted``: fewest edits first, then the first, none overlapping.

    Of the runs with one end the one of fewest edits is meant, and of those the shortest.
    """
    least = len(wanted) - most  # a run has so many words at least, which tells most overlaps by the ends alone
    ends = sorted((score, j + 1) for j, score in enumerate(scores(wanted, body)) if score <= most)
    found: list[tuple[int, int, int]] = []
    taken: list[tuple[int, int]] = []
    for edits, end in ends:
        k = bisect.bisect_left(taken, (end, 0))  # spans before k begin before this end
        before = taken[k - 1][1] if k else 0
        if k and end < before + least:
            continue
        start = end - nearest(wanted[::-1], body[max(0, end - len(wanted) - most) : end][::-1], anchored=True)[1]
        if start >= before:
            found.append((start, end, edits))
            taken.insert(k, (start, end))
    return found


def item_blocks(benchmark: DataFrame, block_bytes: int = 8 << 20, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int | None, str]]]:
    """The benchmark in blocks of about ``block_bytes`` of text; what a task receives is thus bounded."""
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).filter("t IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    for k in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).collect()
        yield sorted(((r.i, r.t) for r in own), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = 0.98, least_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, start_word, end_word, edits, similarity): passages of ``docs`` close to benchmark items.

    Words are compared with A-Z folded. A passage counts if it is within (1 - similarity) x item length word
    edits of the item; of each item in each row all passages are given that do not overlap a better one. Every start in every text whose next
    words are mostly known to the benchmark (no such passage fails that) is embedded by CGK random walks, which
    bring edit distance to Hamming distance; sampled coordinates are looked up among the items' in as many
    tables as the recall needs, and hits are verified exactly. Items of over PIECE words are looked up by pieces,
    of which one keeps the item's rate of edits, and verified whole. Items of fewer than ``least_words`` words are
    found word for word only, so an item of one word is in every text with that word. Items without an id are
    searched like others (item_id null). Null items, items without words and null or empty texts match nothing, nor
    does an empty table on either side; repeated rows and items are reported each; other columns are not read.
    """
    ship_code(docs.sparkSession)
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    out = None
    for items in item_blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items: list = items) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items, similarity, recall, least_words)
            for batch in chunks(batches):
                ids = batch.column("doc_id").to_pylist()
                found = [(ids[t], matcher.ids[i], a, b, e, 1 - e / len(matcher.words[i])) for t, i, a, b, e in sorted(matcher.match(batch.column("text")))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64() if n == 5 else pa.int64()) for n, x in enumerate(zip(*found, strict=True))], _LEAK_NAMES)

        part = rows.mapInArrow(run, _LEAKS)
        out = part if out is None else out.unionAll(part)
    return docs.sparkSession.createDataFrame([], _LEAKS) if out is None else out


_LEAKS = "doc_id long, item_id long, start_word long, end_word long, edits long, similarity double"
_LEAK_NAMES = [x.split()[0] for x in _LEAKS.split(", ")]


def without_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = 0.98, least_words: int = 5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which ``find_leaks`` finds nothing, columns unchanged; no shuffle.

    Null and wordless texts stay, repeated rows stay or go alike; an empty benchmark leaves all rows.
    """
    ship_code(docs.sparkSession)
    names = docs.columns
    rows, text = docs.toDF(*[f"c{i}" for i in range(len(names))]), f"c{names.index(text_col)}"
    schema = rows.schema
    for items in item_blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items: list = items) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items, similarity, recall, least_words)
            for batch in chunks(batches, text):
                clean = np.ones(batch.num_rows, dtype=bool)
                clean[[t for t, *_ in matcher.match(batch.column(text))]] = False
                yield batch.filter(pa.array(clean))

        rows = rows.mapInArrow(run, schema)
    return rows.toDF(*names)
