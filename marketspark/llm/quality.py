"""Quality from weak labels: EM over overlapping heuristics, then a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.llm.common import SEPARATOR, Words, chunks

GOOD, BAD, ABSTAIN = 1, -1, 0
#: name: (bad below, good from, good to, bad above) of a measure; between them the labeller abstains.
LABELLERS: dict[str, tuple[float, float, float, float]] = {
    "words": (3, 20, np.inf, np.inf),
    "word_length": (2.5, 3.5, 8.5, 11),
    "symbols": (-1, -1, 0.01, 0.04),
    "digits": (-1, -1, 0.02, 0.15),
    "capitals": (-1, -1, 0.12, 0.4),
    "new_words": (0.2, 0.35, 1, np.inf),
    "repeats": (-1, -1, 0.04, 0.15),
    "closed_lines": (0.3, 0.8, np.inf, np.inf),
    "line_length": (2, 6, np.inf, np.inf),
}
#: Buckets of hashed words and of word shapes, and one for a word that repeats the one before.
WORD_BUCKETS, SHAPES = 1 << 15, 8 * 8 * 8 * 16
FEATURES = WORD_BUCKETS + SHAPES + 1

_KIND = np.full(256, 4, dtype=np.int64)
_KIND[ord("a") : ord("z") + 1] = 0
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[[ord(c) for c in ".,;:?'\"()-"]] = 3
_KIND[128:] = 5
_KIND[SEPARATOR] = 6


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def measures(words: Words, hashes: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """What the labellers look at, per text."""
    kind = _KIND[words.data]
    count = np.diff(words.first).astype(float)
    size = np.maximum(count, 1)
    letters = np.maximum(_per_text((kind < 2) | (kind == 5), offsets), 1)
    signs = np.maximum(_per_text(kind != 6, offsets), 1)
    text = np.repeat(np.arange(len(count)), np.diff(words.first))
    order = np.lexsort((hashes, text))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (text[order][1:] != text[order][:-1])
    distinct = np.bincount(text[order][fresh], minlength=len(count))
    again = np.zeros(len(hashes), dtype=bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    line_end = words.data == 10
    ends = words.end
    last = np.ones(len(ends), dtype=bool)  # the word ends its line
    last[:-1] = (text[1:] != text[:-1]) | (np.cumsum(line_end)[np.minimum(words.start[1:], len(line_end) - 1)] > np.cumsum(line_end)[ends[:-1] - 1])
    final, before = words.data[ends - 1], words.data[np.maximum(ends - 2, words.start)]
    closed = last & np.isin(final, [ord(c) for c in ".!?\"'"]) & ((final != before) | (ends - words.start < 2))
    lines = np.maximum(np.bincount(text[last], minlength=len(count)), 1)
    return {
        "words": count,
        "word_length": np.where(count > 0, np.bincount(text, weights=ends - words.start, minlength=len(count)) / size, 0),
        "symbols": _per_text(kind == 4, offsets) / signs,
        "digits": _per_text(kind == 2, offsets) / signs,
        "capitals": _per_text(kind == 1, offsets) / letters,
        # Long texts repeat words by nature; the root levels that out.
        "new_words": np.where(count > 0, distinct / size * np.sqrt(np.maximum(size / 100, 1)), 0),
        "repeats": np.bincount(text[again], minlength=len(count)) / size,
        "closed_lines": np.bincount(text[closed], minlength=len(count)) / lines,
        "line_length": count / lines,
    }


def votes(found: dict[str, np.ndarray]) -> np.ndarray:
    """Votes of all labellers (columns, in the order of LABELLERS) on each text."""
    out = []
    for name, (low, good_low, good_high, high) in LABELLERS.items():
        x = found[name]
        out.append(np.where((x < low) | (x > high), BAD, np.where((x >= good_low) & (x <= good_high), GOOD, ABSTAIN)))
    return np.stack(out, axis=1).astype(np.int8)


def pattern(vote: np.ndarray) -> np.ndarray:
    """The votes as one number in base 3."""
    return (vote.astype(np.int64) + 1) @ 3 ** np.arange(vote.shape[1])


@dataclass
class WeakModel:
    """prior: share of good texts; table[class, labeller, vote + 1]: how labellers vote on bad and good texts."""

    prior: float
    table: np.ndarray

    def posterior(self, vote: np.ndarray) -> np.ndarray:
        """Probability of good given the votes."""
        log = np.stack([np.log(self.table[c])[np.arange(vote.shape[1]), vote.astype(int) + 1].sum(1) for c in (0, 1)], axis=1)
        log += np.log([1 - self.prior, self.prior])
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))

    def accuracy(self) -> dict[str, float]:
        """Chance that a labeller that does not abstain is right."""
        right = self.prior * self.table[1, :, 2] + (1 - self.prior) * self.table[0, :, 0]
        spoken = self.prior * (1 - self.table[1, :, 1]) + (1 - self.prior) * (1 - self.table[0, :, 1])
        return dict(zip(LABELLERS, (right / spoken).tolist(), strict=True))


def fit_weak(vote: np.ndarray, count: np.ndarray, rounds: int = 100) -> WeakModel:
    """Expectation-maximisation over distinct vote patterns and their numbers; begins at the majority vote."""
    good = np.clip(0.5 + vote.sum(1) / (2 * vote.shape[1]), 0.02, 0.98)
    model = WeakModel(0.5, np.full((2, vote.shape[1], 3), 1 / 3))
    for _ in range(rounds):
        table = np.ones((2, vote.shape[1], 3))
        for c, share in ((0, 1 - good), (1, good)):
            for v in (-1, 0, 1):
                table[c, :, v + 1] += (count * share) @ (vote == v)
        prior = float((count @ good + 1) / (count.sum() + 2))
        model = WeakModel(prior, table / table.sum(2, keepdims=True))
        now = model.posterior(vote)
        if np.abs(now - good).max(initial=0) < 1e-9:
            break
        good = now
    return model


def features(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words (three per word) and the text of each."""
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    kind, size = _KIND[words.data], words.end - words.start
    shape = ((kind[words.start] * 8 + kind[words.end - 1]) * 8 + kind[np.maximum(words.end - 2, words.start)]) * 16 + np.minimum(size, 15)
    again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])) + 1
    buckets = [(hashes >> np.uint64(49)).astype(np.int64), WORD_BUCKETS + shape, np.full(len(again), FEATURES - 1)]
    return np.concatenate(buckets), np.concatenate([text, text, text[again]])


def fit_linear(rows: np.ndarray, buckets: np.ndarray, values: np.ndarray, target: np.ndarray, rounds: int = 150, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic weights on sparse rows for soft targets, classes balanced, by Adam over the whole sample."""
    weight, bias = np.zeros(FEATURES), 0.0
    balance = np.where(target >= 0.5, 0.5 / max((target >= 0.5).mean(), 1e-9), 0.5 / max((target < 0.5).mean(), 1e-9))
    m, v = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)
    for t in range(1, rounds + 1):
        raw = bias + np.bincount(rows, weights=values * weight[buckets], minlength=len(target))
        miss = balance * (1 / (1 + np.exp(-np.clip(raw, -50, 50))) - target) / len(target)
        slope = np.append(np.bincount(buckets, weights=values * miss[rows], minlength=FEATURES) + decay * weight, miss.sum())
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        step = 0.5 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        weight, bias = weight - step[:-1], bias - step[-1]
    return weight, float(bias)


def classify(docs: DataFrame, sample_rows: int = 20_000, sample_words: int = 6_000_000, seed: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, votes, weak_good, score, keep.

    Every text is voted on by LABELLERS; EM over the vote patterns of all texts (at most 3**labellers rows reach
    the driver) gives their accuracies and each text's probability of being good (``weak_good``). These
    probabilities train a logistic scorer over hashed words and word shapes, on the texts with the smallest hash
    of text and seed: at most ``sample_rows``, and so many that ``sample_words`` are expected in them (the bounds). ``score`` is its probability, ``keep`` whether it
    is at least one half. Null and empty texts have no features: their score is 0 and they are not kept. An
    empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def voted(batch: pa.RecordBatch) -> tuple[Words, np.ndarray, np.ndarray]:
        words = Words(batch.column("text"))
        hashes = words.hashes(lower=True)
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        return words, hashes, votes(measures(words, hashes, offsets))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            words, _, vote = voted(batch)
            key, at, n = np.unique(pattern(vote), return_inverse=True, return_counts=True)
            size = np.bincount(at, weights=np.diff(words.first), minlength=len(key)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), pa.array(size)], ["pattern", "n", "words"])

    seen = rows.mapInArrow(tally, "pattern long, n long, words long").groupBy("pattern").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).toArrow()
    keys, count = seen.column("pattern").to_numpy(), seen.column("n").to_numpy()
    vote = (keys[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1).astype(np.int8)
    weak = fit_weak(vote, count.astype(float))

    total = int(count.sum())
    size = int(np.sum(seen.column("words").to_numpy()))
    sample_rows = max(1, min(sample_rows, sample_words * total // max(size, 1)))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "text"), 11) / F.lit(float(1 << 53))
    drawn = rows.filter(F.col("text").isNotNull() & (draw < min(1.0, 2.0 * sample_rows / max(total, 1)))).withColumn("draw", draw)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            words, hashes, vote = voted(batch)
            bucket, text = features(words, hashes)
            key, n = np.unique(text * FEATURES + bucket, return_counts=True)
            cut = np.searchsorted(key // FEATURES, np.arange(batch.num_rows + 1)).astype(np.int32)
            size = np.maximum(np.diff(words.first), 1)
            value = (n / size[key // FEATURES]).astype(np.float32)
            lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x)) for x in ((key % FEATURES).astype(np.int32), value)]
            yield pa.RecordBatch.from_arrays([batch.column("draw"), pa.array(weak.posterior(vote)), *lists], ["draw", "good", "buckets", "shares"])

    sample = drawn.mapInArrow(learn, "draw double, good double, buckets array<int>, shares array<float>").orderBy("draw").limit(sample_rows).toArrow().combine_chunks()
    lengths = sample.column("buckets").combine_chunks().value_lengths().to_numpy(zero_copy_only=False) if sample.num_rows else np.zeros(0, np.int64)
    parts = [sample.column(c).combine_chunks().flatten().to_numpy() if sample.num_rows else np.zeros(0) for c in ("buckets", "shares")]
    model = fit_linear(np.repeat(np.arange(len(lengths)), lengths), parts[0].astype(np.int64), parts[1].astype(float), sample.column("good").to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast((weak, *model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weak, weight, bias = shared.value
        for batch in chunks(batches):
            words, hashes, vote = voted(batch)
            bucket, text = features(words, hashes)
            size = np.diff(words.first)
            raw = bias + np.bincount(text, weights=weight[bucket], minlength=len(size)) / np.maximum(size, 1)
            score = np.where(size > 0, 1 / (1 + np.exp(-np.clip(raw, -50, 50))), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(vote.astype(np.int32)), pa.list_(pa.int32())), pa.array(weak.posterior(vote)), pa.array(score), pa.array(score >= 0.5)], ["doc_id", "votes", "weak_good", "score", "keep"])

    return rows.mapInArrow(run, "doc_id long, votes array<int>, weak_good double, score double, keep boolean")
