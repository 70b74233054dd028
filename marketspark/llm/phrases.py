"""Phrase collocations: windows of the longest order counted once, shorter phrases as sums over their prefixes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketspark.llm.common import CHUNK_BYTES, Words, chunks, fold, mix, stored
from marketspark.operators.joins import join_small
from marketspark.session import settle, ship_code

#: Bytes that end a piece, and bytes between the words of a piece.
BREAKS, SPACES = [*b".,;:!?", *range(0x0A, 0x0E)], [0x20, 0x09]
#: Heads of windows with at least this share of them (10 000 at most) are dealt over so many parts.
HOT_SHARE, SALTS = 1e-4, 256
#: Score of a cut that joins its parts perfectly (a = l = r).
UNIT = 1_000_000
#: floor(UNIT a² / (l r)) of long columns, by whole decimals of 38 digits.
SCORE = f"(CAST(a AS DECIMAL(19, 0)) * CAST(a AS DECIMAL(19, 0)) * {UNIT}BD) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))"


def _class(members: list[int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[members] = True
    return table


_BREAK, _SPACE = _class(BREAKS), _class(SPACES)


def windows(texts: pa.Array, order: int) -> tuple[pa.Array, list[np.ndarray], np.ndarray]:
    """(distinct words, lead columns, text numbers): a window starts at every word of every piece.

    Column k holds the number of the word k places on, or -1 beyond the end of the piece.
    """
    words = Words(texts, _BREAK | _SPACE)
    data = fold(words.data)
    where = np.append(0, np.cumsum(words.end - words.start))
    spelled = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words.start), [None, pa.py_buffer(where.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[~(_BREAK | _SPACE)[data]]))])
    coded = spelled.dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    piece = np.cumsum(_BREAK[data])[words.start]  # pieces of one text are told apart by this
    columns = [code]
    for k in range(1, order):
        lead = np.full(len(code), -1, dtype=np.int64)
        same = (piece[k:] == piece[:-k]) & (text[k:] == text[:-k])
        lead[:-k][same] = code[k:][same]
        columns.append(lead)
    return coded.dictionary, columns, text


def word_keys(words: pa.Array, seed: int) -> np.ndarray:
    """A 64-bit key of each word, and 0 at the end for the padding (which has number -1)."""
    keys = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words.to_pylist()), dtype=np.uint64, count=len(words))
    return np.append(np.maximum(keys, 1), np.uint64(0))


def _counted(lang: np.ndarray, columns: list[np.ndarray], n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of one window of each kind, in order, and how many there are of it."""
    kind = lang
    for column in columns:
        kind = np.unique(kind * (n_words + 1) + column + 1, return_inverse=True)[1]
    _, first, count = np.unique(kind, return_index=True, return_counts=True)
    return first, count


def _head(columns: list[np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of the words by which windows are dealt (two, or one of two), and the key of the word after them."""
    if len(columns) == 2:
        return keys[columns[0]], keys[columns[1]]
    return mix(keys[columns[0]] * np.uint64(0x9E3779B97F4A7C15) + keys[columns[1]]), keys[columns[2]]


def survey(docs: DataFrame, order: int, seeds: Iterable[int] = range(5), text_col: str = "text") -> tuple[int, DataFrame, np.ndarray]:
    """(seed, (key, word), hot heads): all distinct words with keys of which no two are equal, and the hot heads of windows.

    Keys of 64 bits clash about once in 10^19 pairs of words; the words are compared, and if two share a key the
    next seed is taken, so keys stand for words exactly. A head is hot with HOT_SHARE of all different windows, so
    there are 1 / HOT_SHARE at most; blocks of text report those with half that share in them. Heads that are
    missed or clash are only dealt otherwise; no count depends on it.
    """
    ship_code(docs.sparkSession)
    texts = docs.select(F.col(f"`{text_col}`").alias("text"))
    for seed in seeds:

        def run(batches: Iterator[pa.RecordBatch], seed: int = seed) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches):
                words, columns, _ = windows(batch.column("text"), order)
                keys = word_keys(words, seed)
                first, _ = _counted(np.zeros(len(columns[0]), dtype=np.int64), columns, len(words))
                head, count = np.unique(_head([c[first] for c in columns], keys)[0], return_counts=True)
                many = count >= HOT_SHARE / 2 * len(first)
                heads = pa.array([None, *head[many].view(np.int64).tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([heads, pa.nulls(len(heads), pa.string()), pa.array([len(first), *count[many].tolist()], pa.int64())], ["key", "word", "n"])
                for at in range(0, len(words), 1 << 16):
                    to = slice(at, min(len(words), at + (1 << 16)))
                    spelled = words[to].cast(pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(keys[to].view(np.int64)), spelled, pa.nulls(len(spelled), pa.int64())], ["key", "word", "n"])

        found = stored(texts.mapInArrow(run, "key long, word string, n long").groupBy("key", "word").agg(F.sum("n").alias("n")), "phrase-words")
        words, heads = found.filter("word IS NOT NULL").select("key", "word"), found.filter("word IS NULL")
        if words.groupBy("key").count().filter("count > 1").isEmpty():
            total = heads.filter("key IS NULL").agg(F.sum("n")).first()[0] or 0
            hot = heads.filter(F.col("key").isNotNull() & (F.col("n") >= HOT_SHARE * total)).toArrow().column("key").to_numpy()
            return seed, words, np.sort(hot.view(np.uint64)) if len(hot) else np.zeros(0, dtype=np.uint64)
    raise RuntimeError("words share keys under every seed")


def window_counts(docs: DataFrame, order: int, seed: int, hot: np.ndarray, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, w1 … w<order>, salt, n): padded windows of word keys, counted within 4 MB of text; the padding is 0.

    ``salt`` is 0, or a number that follows from the word after the head where the head is hot, so that equal
    windows always have the same.
    """
    ship_code(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    names = [f"w{k + 1}" for k in range(order)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=CHUNK_BYTES):
            words, columns, text = windows(batch.column("text"), order)
            keys = word_keys(words, seed)
            lang = batch.column("lang").dictionary_encode()
            first, count = _counted(lang.indices.to_numpy().astype(np.int64)[text], columns, len(words))
            columns = [c[first] for c in columns]
            head, after = _head(columns, keys)
            salt = np.where(np.isin(head, hot), after % np.uint64(SALTS) + np.uint64(1), np.uint64(0))
            langs = lang.dictionary.cast(pa.string()).take(pa.array(lang.indices.to_numpy()[text[first]]))
            arrays = [langs, *[pa.array(keys[c].view(np.int64)) for c in columns], pa.array(salt.astype(np.int32)), pa.array(count.astype(np.int64))]
            for at in range(0, len(first), 1 << 16):
                yield pa.RecordBatch.from_arrays([x[at : at + (1 << 16)] for x in arrays], ["lang", *names, "salt", "n"])

    return rows.mapInArrow(run, "lang string, " + ", ".join(f"{x} long" for x in names) + ", salt int, n long")


def phrase_counts(docs: DataFrame, order: int = 3, least: int = 10, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, size, phrase, f): how often each phrase of up to ``order`` words occurs, from ``least`` times on; size 0 counts all words.

    Windows, as keys of words, are dealt once by their first two words (hot ones also by the third). There the
    windows of a rare phrase are cut to their longest prefix that occurs ``least`` times, as no longer one is asked
    for. Every occurrence of a phrase begins one longest window, so ROLLUP over the windows left sums them by
    ever shorter prefixes; prefixes that reach into the padding are no phrases. The words come back for the phrases
    that are left, where the dictionary of frequent words proves small by broadcast, otherwise by shuffles.
    """
    columns = [f"w{k + 1}" for k in range(order)]
    dealt = min(2, order - 1)
    seed, dictionary, hot = survey(docs, order, text_col=text_col)
    placed = window_counts(docs, order, seed, hot, lang_col, text_col).repartition("lang", *columns[:dealt], "salt")
    counted = placed.groupBy("lang", *columns, "salt").agg(F.sum("n").alias("n"))
    kept = F.lit(1) + F.when(F.col("n") >= least, 1).otherwise(0)
    for k in range(dealt, order):
        if k > 1:
            same = Window.partitionBy("lang", "salt", *columns[:k])
            counted = counted.withColumn(f"total{k}", F.sum("n").over(same))
            kept = kept + F.when((F.col(f"total{k}") >= least) | (F.lit(k == dealt) & (F.col("salt") > 0)), 1).otherwise(0)
    counted = counted.withColumn("kept", kept)
    cut = counted.select("lang", *[F.when(F.col("kept") > k, F.col(c)).otherwise(0).alias(c) for k, c in enumerate(columns)], "n")
    summed = cut.sparkSession.sql(
        f"SELECT lang, {', '.join(columns)}, {order} - bit_count(grouping_id()) AS size, sum(n) AS f "
        f"FROM {{cut}} GROUP BY lang, ROLLUP({', '.join(columns)}) HAVING f >= {int(least)} OR size = 0",
        cut=cut,
    )
    last = F.element_at(F.array(F.lit(1).cast("long"), *columns), F.col("size") + 1)
    summed = stored(summed.filter(last != 0), "phrase-keys")
    frequent = settle(dictionary.join(summed.filter("size = 1").select(F.col("w1").alias("key")).distinct(), "key"))
    for c in columns:
        summed = join_small(summed, frequent.select(F.col("key").alias(c), F.col("word").alias(f"word_{c}")), [c], "left")
    return summed.select("lang", "size", F.concat_ws(" ", *[f"word_{c}" for c in columns]).alias("phrase"), "f")


def collocations(docs: DataFrame, order: int = 3, least: int = 10, contained_percent: int = 50, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` collocations of each language.

    Texts, with A-Z in lower case, are cut into pieces at . , ; : ! ? and line ends and these into words at blanks
    and tabs. A candidate is a phrase of 2 to ``order`` words that occurs a >= ``least`` times; cut after k words
    it scores floor(10^6 a² / (l r)), l and r being the counts of its parts; its lowest-scoring cut counts, of
    equals the shortest first part. Products are decimals of 38 digits, exact up to a = 10^16. A candidate inside a
    longer one that occurs at least ``contained_percent`` of a hundred times as often is dropped. Order: score, a
    descending, then the phrase by its bytes.

    Null texts are empty, null languages are "und"; repeated rows count each time; other columns are not read; an
    empty table, or one without candidates, gives an empty result. Windows are counted before the shuffle and only phrases frequent enough are kept for the joins (a part of a candidate occurs as often as it does), which
    are plain shuffles that Spark can split. Each language's order is cut to ``top`` rows in every task first.
    """
    if order < 2:
        raise ValueError("phrases have two words at least")
    counts = stored(phrase_counts(docs, order, least, lang_col, text_col), "phrases")
    found = counts.filter("size >= 2").withColumnRenamed("f", "a")
    part = counts.filter("size >= 1").select("lang", F.col("phrase").alias("part"), F.col("f"))
    words = F.split("phrase", " ")
    cuts = found.select("lang", "phrase", "a", F.explode(F.expr("sequence(1, size - 1)")).alias("k"), words.alias("words"), "size")
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(words, 1, k), ' ')").alias("head"), F.expr("array_join(slice(words, k + 1, size), ' ')").alias("tail"))
    cuts = cuts.join(part.select("lang", F.col("part").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(part.select("lang", F.col("part").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    cuts = cuts.withColumn("score", F.expr(SCORE))
    weakest = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = found.filter("size >= 3").select("lang", "a", words.alias("words"), "size")
    inner = inner.select("lang", "a", "words", "size", F.explode(F.expr("sequence(2, size - 1)")).alias("m"))
    inner = inner.select("lang", "a", F.explode(F.expr("transform(sequence(1, size - m + 1), i -> array_join(slice(words, i, m), ' '))")).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = weakest.join(longer, ["lang", "phrase"], "left").filter(f"longer IS NULL OR CAST(longer AS DECIMAL(20, 0)) * 100 < CAST(a AS DECIMAL(20, 0)) * {int(contained_percent)}")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    ranked = kept.withColumn("rank", rank).filter(F.col("rank") <= top)
    total = counts.filter("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
