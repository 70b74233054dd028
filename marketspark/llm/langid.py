"""Language identification by cross-parsing against suffix automata of labelled text."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from marketspark.llm.common import chunks, numbered
from marketspark.session import ship_code

#: Symbols: 0 is any run of non-letters, then the most frequent letters of training, then any other letter.
ALPHABET = 62
#: Where training has more letters, the others are spelled: 16 first digits, 16 further ones, and the mark of a letter beyond the basic plane.
DIGITS = 33
#: Symbols that are parsed in one go; a new phrase begins at each multiple.
SEGMENT = 256
FAILED = np.int32(1 << 30)
#: The columns that a prediction adds.
PREDICTED = ("lang_pred", "score", "cross_entropy")


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


@dataclass
class Model:
    """Letters of the alphabet and, per language, the parsing table of its automaton.

    ``table[s * width + c]`` is where state s goes on symbol c: a premultiplied state, marked with FAILED where
    the automaton has no such edge and a new phrase begins with c. The last column is the cut between passages.
    """

    letters: str
    langs: list[str]
    tables: list[np.ndarray]
    sizes: list[int]
    digits: int = 0

    @property
    def width(self) -> int:
        return len(self.letters) + 3 + self.digits

    def lookup(self) -> np.ndarray:
        """Symbol of each code point of the basic plane, letters folded to lower case."""
        other = len(self.letters) + 1
        known = {c: i + 1 for i, c in enumerate(self.letters)}
        out = np.zeros(1 << 16, dtype=np.uint8)
        for cp in range(1 << 16):
            c = chr(cp)
            if c.isalpha():
                out[cp] = known.get(c.lower(), other)
        return out


def spelled(point: int, other: int) -> list[int]:
    """The symbols of a letter that has none of its own: a first digit and three more, or a mark and six digits."""
    long = point > 0xFFFF
    rest = [other + 17 + (point >> shift & 15) for shift in range(20 if long else 8, -1, -4)]
    return [other + 33 if long else other + 1 + (point >> 12), *rest]


def symbols(texts: pa.Array, lookup: np.ndarray, other: int, digits: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts in a row, where each text begins, and how many letters it has; a gap behind a letter is one symbol.

    With ``digits``, letters without a symbol of their own are spelled.
    """
    plain = [t or "" for t in texts.to_pylist()]
    points = np.frombuffer("".join(plain).encode("utf-32-le", "replace"), dtype=np.uint32)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in plain], dtype=np.int64)]).astype(np.int64)
    sym = lookup[np.minimum(points, 0xFFFF)]
    for i in np.flatnonzero(points > 0xFFFF):
        sym[i] = other if chr(points[i]).isalpha() else 0
    keep = sym > 0
    gap = ~keep
    gap[1:] &= keep[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    gap[heads] = False
    at = np.concatenate([[0], np.cumsum(keep | gap)])
    letters = np.concatenate([[0], np.cumsum(keep)])
    first, count = at[offsets], letters[offsets[1:]] - letters[offsets[:-1]]
    wanted = keep | gap
    sym = sym[wanted]
    if digits and (sym == other).any():
        points = points[wanted]
        strange = np.flatnonzero(sym == other)
        codes, which = np.unique(points[strange], return_inverse=True)
        low = [chr(c).lower() for c in codes.tolist()]
        made = [spelled(ord(x) if len(x) == 1 else c, other) for x, c in zip(low, codes.tolist(), strict=True)]
        size = np.ones(len(sym), dtype=np.int64)
        size[strange] = np.array([len(m) for m in made])[which]
        begin = np.concatenate([[0], np.cumsum(size)])
        out = np.repeat(sym, size)
        table = np.array([m + [0] * (7 - len(m)) for m in made], dtype=np.uint8)
        for k in range(7):
            has = size[strange] > k
            out[begin[strange[has]] + k] = table[which[has], k]
        sym, first = out, begin[first]
    return sym, first, count


def automaton(sym: np.ndarray, width: int) -> np.ndarray:
    """The parsing table of the suffix automaton of a symbol sequence; ``width - 1`` cuts between passages."""
    link, length, edges = [-1], [0], [{}]
    last = 0
    for c in sym.tolist():
        if c == width - 1:
            last = 0
            continue
        if (q := edges[last].get(c)) is not None:  # the passage begins as an earlier one went on
            if length[q] == length[last] + 1:
                last = q
                continue
            clone = len(link)
            link.append(link[q]), length.append(length[last] + 1), edges.append(dict(edges[q]))
            link[q] = clone
            p = last
            while p >= 0 and edges[p].get(c) == q:
                edges[p][c] = clone
                p = link[p]
            last = clone
            continue
        new = len(link)
        link.append(0), length.append(length[last] + 1), edges.append({})
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(link)
                link.append(link[q]), length.append(length[p] + 1), edges.append(dict(edges[q]))
                link[q] = link[new] = clone
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = clone
                    p = link[p]
        last = new
    # The last state is where a text begins and where a symbol that was never taught leads: any symbol starts anew there.
    table = np.zeros((len(edges) + 1, width), dtype=np.int32)
    restart = np.full(width, len(edges) * width, dtype=np.int32)
    for c, q in edges[0].items():
        restart[c] = q * width
    table[:] = restart | FAILED
    for s, out in enumerate(edges):
        table[s, list(out)] = [q * width for q in out.values()]
    return table.ravel()


def dealt(texts: list[str], room: int, passage: int) -> list[str]:
    """Passages of all texts, ``room`` symbols together: equal shares, what short texts leave going to longer ones.

    Each passage lies in its own stretch of its text, further on from text to text: at the start of it in the first, at the end in the last.
    """
    share = [0] * len(texts)
    for done, i in enumerate(sorted(range(len(texts)), key=lambda i: len(texts[i]))):
        share[i] = min(len(texts[i]), room // (len(texts) - done))
        room -= share[i]
    out = []
    for i, (text, size) in enumerate(zip(texts, share, strict=True)):
        count = max(1, -(-size // passage))
        size //= count
        stretch = len(text) / count
        out += [text[a : a + size] for a in (int(j * stretch + (i + 0.5) / len(texts) * (stretch - size)) for j in range(count)) if size]
    return out


def fit(docs: DataFrame, rows: int = 300, symbols_each: int = 40_000, passage: int = 400, languages: int = 64, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """Automata of a bounded sample of the labelled rows of ``docs``.

    The bound: of each language the ``rows`` rows with the smallest hash of their id, and of each of those,
    passages of at most ``passage`` symbols dealt evenly over the whole texts, ``symbols_each`` symbols together. Rows without text or
    language teach nothing. Beyond ``languages`` languages all share the symbols of so many, as tables take memory.
    Letters beyond the ALPHABET most frequent ones are spelled, and count as the symbols that takes.
    """
    labelled = docs.select(F.col(id_col).cast("string").alias("k"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    counts = [(r.lang, r.n) for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()]
    symbols_each = min(symbols_each, languages * symbols_each // max(1, len(counts)))
    # The smallest hashes lie below this share of all with near certainty; what is above never leaves its task.
    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, 3.0 * rows / n)) for lang, n in counts], "lang string, share double")
    draw = F.shiftrightunsigned(F.xxhash64("k"), 11) / F.lit(float(1 << 53))
    order = Window.partitionBy("lang").orderBy(draw, "k", F.xxhash64("text"))
    sample = labelled.join(F.broadcast(shares), "lang").filter(draw < F.col("share")).drop("share").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= rows)

    def passages(group: pd.DataFrame) -> pd.DataFrame:
        texts = [" ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " " for text in group.sort_values("n")["text"]]
        return pd.DataFrame({"lang": group["lang"].iloc[0], "passages": [dealt(texts, symbols_each, passage)]})

    taught = sample.groupBy("lang").applyInPandas(passages, "lang string, passages array<string>").collect()
    texts = {row["lang"]: [str(p) for p in row["passages"]] for row in sorted(taught)}
    count: dict[str, int] = {}
    for own in texts.values():
        for p in own:
            for c in p:
                count[c] = count.get(c, 0) + 1
    count.pop(" ", None)
    letters = "".join(sorted(sorted(count, key=lambda c: (-count[c], c))[:ALPHABET]))
    model = Model(letters, list(texts), [], [], DIGITS if len(count) > ALPHABET else 0)
    known = {" ": [0]} | {c: [i + 1] for i, c in enumerate(letters)}
    known |= {c: spelled(ord(c), len(letters) + 1) for c in count if c not in known}
    for own in texts.values():
        seq = []
        longer = sum(len(known[c]) for p in own for c in p) / max(1, sum(map(len, own)))
        for p in own:
            seq += [x for c in p[: math.ceil(len(p) / max(1.0, longer))] for x in known[c]] + [model.width - 1]
        model.tables.append(automaton(np.array(seq, dtype=np.int64), model.width))
        model.sizes.append(max(2, len(seq)))
    return model


def phrases(sym: np.ndarray, first: np.ndarray, model: Model) -> np.ndarray:
    """Phrases of each text in each language: greedy longest matches, begun anew every SEGMENT symbols."""
    size = np.diff(first)
    pieces = -(-size // SEGMENT)
    text = np.repeat(np.arange(len(size)), pieces)
    start = first[text] + (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * SEGMENT
    length = np.minimum(first[text + 1] - start, SEGMENT)
    order = np.argsort(-length, kind="stable")
    text, start, length = text[order], start[order], length[order]
    out = np.zeros((len(size), len(model.langs)), dtype=np.int64)
    for g, table in enumerate(model.tables):
        state = np.full(len(text), len(table) - model.width, dtype=np.int32)
        count = np.zeros(len(text), dtype=np.int32)
        live = len(text)
        for j in range(SEGMENT):
            live = int(np.searchsorted(-length[:live], -j, side="left"))
            if not live:
                break
            went = table[state[:live] + sym[start[:live] + j]]
            count[:live] += went >> 30
            np.bitwise_and(went, FAILED - 1, out=state[:live])
        out[:, g] = np.bincount(text, weights=count, minlength=len(size)).astype(np.int64)
    return out


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and cross_entropy, same-named columns replaced.

    The language with the fewest phrases wins, normalised as bits per symbol (phrases x log2(training length) /
    symbols; ties: the first language by name). The score is how much fewer the winner needs than the next
    best, 0 to 1 (1 with one language). Null texts and texts without a letter are ``und`` with score 0 and no
    entropy, as is everything if nothing was taught. Whole texts are parsed; any other column passes through.
    """
    ship_code(docs.sparkSession)
    rows, names_kept = numbered(docs, text_col, *PREDICTED)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        lookup, bits, names = model.lookup(), np.log2(np.array(model.sizes or [2])), np.array([*model.langs, "und"], dtype=object)
        for batch in chunks(batches):
            sym, first, letters = symbols(batch.column("text"), lookup, len(model.letters) + 1, model.digits)
            size = np.maximum(np.diff(first), 1)
            cost = phrases(sym, first, model) * bits / size[:, None] if model.langs else np.full((len(size), 1), np.inf)
            best = np.argmin(cost, axis=1)
            ranked = np.sort(cost, axis=1)
            ok = (letters > 0) & bool(model.langs)
            with np.errstate(invalid="ignore", divide="ignore"):
                score = 1 - ranked[:, 0] / ranked[:, 1] if cost.shape[1] > 1 else np.ones(len(size))
            made = [pa.array(names[np.where(ok, best, len(model.langs))], pa.string()), pa.array(np.where(ok, np.nan_to_num(score), 0.0)), pa.array(ranked[:, 0], mask=~ok)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], *PREDICTED])

    schema = StructType([*rows.schema.fields[:-1], *[StructField(c, StringType() if c == "lang_pred" else DoubleType()) for c in PREDICTED]])
    return rows.mapInArrow(run, schema).toDF(*names_kept, *PREDICTED)
