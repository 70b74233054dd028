"""A hidden Markov language model: Baum-Welch over partitions, exact scores by the scaled forward recursion."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.llm.common import Words, chunks, stored

#: The end of a text is a token like the words; its stand-in among the word hashes, and its class.
END = np.uint64(0x656E64)
#: Classes of the words that are no symbols of their own: their length in bytes, the last for all longer ones.
CLASSES = 32
#: Tokens of a training sequence; later pieces of a text begin in the states' mean distribution.
PIECE = 128


def held_out(id_col: str = "doc_id", parts: int = 7, part: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and classes of the tokens of all texts in a row, and where each text begins."""
    words = Words(texts)
    size = np.diff(words.first)
    first = words.first + np.arange(len(words.first))
    ends = first[1:] - 1
    hashes = np.empty(int(first[-1]), dtype=np.uint64)
    kinds = np.zeros(len(hashes), dtype=np.int32)
    inner = np.ones(len(hashes), dtype=bool)
    inner[ends] = False
    hashes[inner], hashes[ends] = words.hashes(lower=True), END
    kinds[inner] = np.minimum(words.end - words.start, CLASSES - 1)
    assert len(size) == len(ends)
    return hashes, kinds, first


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(w, kind, c): tokens of all texts, words by their 64-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            hashes, kinds, _ = tokens(batch.column("text"))
            w, at, n = np.unique(hashes, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(kinds[at]), pa.array(n)], ["w", "kind", "c"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "w long, kind int, c long")
    return rows.groupBy("w", "kind").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Counts of the frequent words and totals of all; words are symbols, or members of a class of symbols."""

    words: np.ndarray  # sorted hashes
    counts: np.ndarray
    symbol: np.ndarray  # of each word: its own below ``own``, else own + class
    own: int
    total: int
    distinct: int
    class_total: np.ndarray
    class_distinct: np.ndarray

    @property
    def symbols(self) -> int:
        return self.own + CLASSES

    def find(self, hashes: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and count of each token; the count is -1 where a word is not among the frequent ones."""
        asked, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        where = np.minimum(np.searchsorted(self.words, asked), max(0, len(self.words) - 1))
        hit = self.words[where] == asked if len(self.words) else np.zeros(len(asked), dtype=bool)
        symbol = np.where(hit, self.symbol[where], self.own + kinds[at]) if len(self.words) else self.own + kinds[at]
        count = np.where(hit, self.counts[where], -1) if len(self.words) else np.full(len(asked), -1)
        return symbol[back].astype(np.uint16), count[back]


def vocabulary(counts: DataFrame, own: int, frequent: int) -> Vocabulary:
    """From stored ``counts``: the words above the count at which fewer than ``frequent`` remain, the first ``own`` as symbols."""
    band = F.floor(F.log2("c") * 16).cast("int")
    bands = sorted(((r.b, r.n) for r in counts.groupBy(band.alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, room = 1 << 30, frequent
    for b, n in bands:
        if n > room:
            break
        least, room = b, room - n
    top = counts.filter(band >= least).toArrow()
    w = top.column("w").to_numpy().view(np.uint64)
    c, kind = top.column("c").to_numpy(), top.column("kind").to_numpy()
    rank = np.lexsort((w, -c))
    symbol = own + kind.astype(np.int64)
    symbol[rank[:own]] = np.arange(min(own, len(rank)))
    single = np.zeros(len(w), dtype=bool)
    single[rank[:own]] = True
    by = {r.kind: (r.c, r.n) for r in counts.groupBy("kind").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()}
    class_total = np.array([by.get(k, (0, 0))[0] for k in range(CLASSES)], dtype=np.int64)
    class_distinct = np.array([by.get(k, (0, 0))[1] for k in range(CLASSES)], dtype=np.int64)
    total, distinct = int(class_total.sum()), int(class_distinct.sum())
    class_total -= np.bincount(kind[single], weights=c[single], minlength=CLASSES).astype(np.int64)
    class_distinct -= np.bincount(kind[single], minlength=CLASSES)
    order = np.argsort(w)
    return Vocabulary(w[order], c[order], symbol[order], own, total, distinct, class_total, class_distinct)


@dataclass
class Chain:
    """start: states at the first token; middle: at the first token of a later piece; move, emit: as usual."""

    start: np.ndarray
    middle: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # (symbols, states), for lookup by symbol


def first_chain(states: int, weight: np.ndarray, seed: int) -> Chain:
    random = np.random.default_rng(seed)
    emit = weight[:, None] * np.exp(random.normal(size=(len(weight), states)))
    move = random.random((states, states)) + 2 * states * np.eye(states)
    even = np.full(states, 1 / states)
    return Chain(even, even, move / move.sum(1, keepdims=True), emit / emit.sum(0))


def expected(chain: Chain, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts (start, middle, move, emit) of the texts and their log-likelihood piece by piece."""
    states = len(chain.start)
    size = np.diff(first)
    pieces = -(-size // PIECE)
    text = np.repeat(np.arange(len(size)), pieces)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = first[text] + nth * PIECE
    length = np.minimum(first[text + 1] - begin, PIECE)
    order = np.argsort(-length, kind="stable")
    begin, length, nth = begin[order], length[order], nth[order]
    live = [int(np.searchsorted(-length, -t, side="left")) for t in range(int(length[0]) if len(length) else 0)]
    alpha, scale, seen = [], [], []
    likely = 0.0
    for t, n in enumerate(live):
        at = chain.emit[symbols[begin[:n] + t]]
        here = at * (np.where(nth[:, None] == 0, chain.start, chain.middle) if t == 0 else alpha[-1][:n] @ chain.move)
        c = here.sum(1)
        here /= c[:, None]
        likely += float(np.log(c).sum())
        alpha.append(here), scale.append(c), seen.append(at)
    start, middle, move = np.zeros(states), np.zeros(states), np.zeros((states, states))
    emit = np.zeros(chain.emit.shape)
    beta = np.zeros((0, states))
    for t in range(len(live) - 1, -1, -1):
        n, ahead = live[t], len(beta)
        back = np.ones((n, states))
        if ahead:
            flow = seen[t + 1] * beta / scale[t + 1][:, None]
            back[:ahead] = flow @ chain.move.T
            move += alpha[t][:ahead].T @ flow
        gamma = alpha[t] * back
        here = symbols[begin[:n] + t]
        for k in range(states):
            emit[:, k] += np.bincount(here, weights=gamma[:, k], minlength=len(emit)) if n > 500 else 0
        if n <= 500:
            np.add.at(emit, here, gamma)
        if t == 0:
            start, middle = gamma[nth == 0].sum(0), gamma[nth > 0].sum(0)
        beta = back
    return start, middle, move * chain.move, emit, likely


def forward(chain: Chain, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Natural log of each text's exact probability under the chain."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, length = first[:-1][order], -size[order]
    out = np.zeros(len(size))
    here = np.zeros((0, len(chain.start)))
    for t in range(int(-length[0]) if len(length) else 0):
        n = int(np.searchsorted(length, -t, side="left"))
        here = chain.emit[symbols[begin[:n] + t]] * (chain.start if t == 0 else here[:n] @ chain.move)
        c = here.sum(1)
        here /= c[:, None]
        out[:n] += np.log(c)
    back = np.empty_like(out)
    back[order] = out
    return back


def _packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a column of binary lists, and where each begins."""
    _, where, data = column.cast(pa.large_binary()).buffers()
    at = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]].view(np.uint16), (at - at[0]) // 2


def encode(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """Each row's symbols, what its frequent words add to the scores, and its other words with their numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        base = np.log10(known.total + known.distinct + 1)
        member = np.log10(known.class_total + known.class_distinct + 1)
        for batch in chunks(batches):
            hashes, kinds, first = tokens(batch.column("text"))
            symbol, count = known.find(hashes, kinds)
            rare = count < 0
            weight = np.where(rare, 0.0, np.log10(np.maximum(count, 0) + 1.0))
            inside = (symbol >= known.own) & ~rare
            sums = [np.add.reduceat(x, first[:-1]) if len(first) > 1 else x[:0] for x in (np.where(rare, 0.0, weight - base), np.where(inside, weight - member[kinds], 0.0), (~rare).astype(np.int64))]
            text = np.repeat(np.arange(len(first) - 1), np.diff(first))[rare]
            lone, k = hashes[rare], kinds[rare]
            order = np.lexsort((lone, text))
            text, lone, k = text[order], lone[order], k[order]
            fresh = np.ones(len(lone), dtype=bool)
            fresh[1:] = (lone[1:] != lone[:-1]) | (text[1:] != text[:-1])
            head = np.flatnonzero(fresh)
            times = np.diff(np.append(head, len(lone)))
            offsets = pa.array(np.searchsorted(text[head], np.arange(len(first))).astype(np.int32))
            items = pa.StructArray.from_arrays([pa.array(lone[head].view(np.int64)), pa.array(k[head]), pa.array(times.astype(np.int32))], ["w", "kind", "n"])
            raw = symbol.tobytes()
            lists = pa.array([raw[2 * a : 2 * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(first)), lists, *[pa.array(x) for x in sums], pa.ListArray.from_arrays(offsets, items)], ["doc_id", "held_out", "n_tokens", "symbols", "base", "member", "known", "rare"])

    schema = "doc_id long, held_out boolean, n_tokens long, symbols binary, base double, member double, known long, rare array<struct<w long, kind int, n int>>"
    return docs.mapInArrow(run, schema)


def train(coded: DataFrame, words: Vocabulary, states: int, rounds: int, seed: int) -> Chain:
    """Baum-Welch over all rows of ``coded``: tasks sum expected counts, a shuffle by symbol adds them up."""
    p = np.full(words.symbols, 0.5)
    np.add.at(p, words.symbol[words.symbol < words.own], words.counts[words.symbol < words.own])
    p[words.own :] += words.class_total
    p /= p.sum()
    chain = first_chain(states, p, seed)
    context = coded.sparkSession.sparkContext
    for _ in range(rounds):
        shared = context.broadcast(chain)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            model, total = shared.value, None
            for batch in batches:
                symbols, first = _packed(batch.column("symbols"))
                step = max(1, 500 * batch.num_rows // max(500, len(symbols) // 1000))
                for a in range(0, batch.num_rows, step):
                    b = min(a + step, batch.num_rows)
                    made = expected(model, symbols[first[a] : first[b]], first[a : b + 1] - first[a])
                    total = made if total is None else tuple(x + y for x, y in zip(total, made, strict=True))
            if total is not None:
                start, middle, move, emit, likely = total
                used = np.flatnonzero(emit.any(1))
                keys = np.concatenate([used, -1 - np.arange(len(move)), [-1001, -1002, -1003]])
                rows = np.concatenate([emit[used], move, start[None], middle[None], np.full((1, len(move)), likely)])
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), *[pa.array(rows[:, k]) for k in range(rows.shape[1])]], ["s", *[f"e{k}" for k in range(rows.shape[1])]])

        fields = [f"e{k}" for k in range(states)]
        sums = coded.select("symbols").mapInArrow(run, "s int, " + ", ".join(f"{f} double" for f in fields))
        got = sums.groupBy("s").agg(*[F.sum(f).alias(f) for f in fields]).toArrow()
        keys, rows = got.column("s").to_numpy(), np.stack([got.column(f).to_numpy() for f in fields], axis=1) if got.num_rows else np.zeros((0, states))
        emit = p[:, None] * states + np.zeros((words.symbols, states))
        emit[keys[keys >= 0]] += rows[keys >= 0]
        move = np.full((states, states), 0.1)
        states_at = (keys < 0) & (keys > -1000)
        move[-1 - keys[states_at]] += rows[states_at]
        start, middle = np.full(states, 0.1), np.full(states, 0.1)
        start += rows[keys == -1001].sum(0)
        middle += rows[keys == -1002].sum(0)
        chain = Chain(start / start.sum(), middle / middle.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
        shared.unpersist()
    return chain


def score(docs: DataFrame, states: int = 8, rounds: int = 4, own: int = 16_384, frequent: int = 500_000, seed: int = 5, id_col: str = "doc_id", text_col: str = "text", split: Column | None = None) -> DataFrame:
    """One row per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words (A-Z folded) and one end per text. The training rows (``split`` false) give the counts
    of all words and, by Baum-Welch over all their tokens, the chain. Its symbols are the ``own`` most frequent
    words and, for all others, their class (length in bytes); in a class a word has probability
    (c + 1) / (class tokens + class words + 1), so every text has an exact probability: the forward recursion
    over its symbols times the members' probabilities. ``base_score`` is the add-one unigram score.

    Counts of up to ``frequent`` words are broadcast (a bound, not a cut): the other words of a text are joined
    with the stored counts. Words are told apart by 64-bit hashes. Null and empty texts are one end token;
    repeated rows and null ids are scored alike, null ids in training. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (held_out(id_col) if split is None else split).alias("held_out"))
    counts = stored(word_counts(rows.filter("NOT held_out")), "lm-counts")
    words = vocabulary(counts, own, frequent)
    coded = stored(encode(rows, words).withColumn("row", F.monotonically_increasing_id()), "lm-coded")
    chain = docs.sparkSession.sparkContext.broadcast(train(coded.filter("NOT held_out"), words, states, rounds, seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            likely = forward(chain.value, *_packed(batch.column("symbols"))) / np.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(likely)], names=[*batch.schema.names[1:], "likely"])

    fields = ["row", "doc_id", "held_out", "n_tokens", "base", "member", "known"]
    scored = coded.select("symbols", *fields).mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, base double, member double, known long, likely double")
    whole = float(np.log10(words.total + words.distinct + 1))
    members = F.array(*[F.lit(float(x)) for x in np.log10(words.class_total + words.class_distinct + 1)])
    rare = coded.select("row", F.inline("rare")).join(counts.select("w", "c"), "w", "left")
    weight = F.log10(F.coalesce("c", F.lit(0)) + 1)
    rare = rare.groupBy("row").agg(
        F.sum(F.col("n") * (weight - whole)).alias("base2"), F.sum(F.col("n") * (weight - members[F.col("kind")])).alias("member2"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("known2")
    )

    def plus(a: str, b: str) -> Column:
        return F.col(a) + F.coalesce(F.col(b), F.lit(0))

    return scored.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", plus("known", "known2").alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"), plus("base", "base2").alias("base_score"), (F.col("likely") + plus("member", "member2")).alias("score")
    )
