"""Periodic runs: maximal pairs of the LCP-interval tree, each of which is a run."""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Generator, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.llm.common import Rolling, Words, chunks, window_starts
from marketspark.session import ship_code

#: Stands for the left words of an interval whose positions do not all have the same one.
MIXED = -2


def suffix_ranks(codes: np.ndarray) -> np.ndarray:
    """The place of every suffix in sorted order, by prefix doubling; what is settled is not sorted again."""
    n = len(codes)
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    order = np.argsort(codes, kind="stable")
    fresh = np.flatnonzero(np.diff(codes[order], prepend=-1))
    size = np.diff(np.append(fresh, n))
    rank[order] = np.repeat(fresh, size)
    todo = order[np.repeat(size > 1, size)]
    step = 1
    while len(todo):
        key = rank[todo] * (n + 1) + rank[np.minimum(todo + step, n)] + 1
        order = np.argsort(key, kind="stable")
        todo, key = todo[order], key[order]
        group = np.flatnonzero(np.diff(rank[todo], prepend=-1))  # equal so far
        part = np.flatnonzero(np.diff(key, prepend=-1))  # equal still
        size = np.diff(np.append(part, len(todo)))
        base = group[np.searchsorted(group, part, side="right") - 1]
        rank[todo] = np.repeat(rank[todo[part]] + part - base, size)
        todo = todo[np.repeat(size > 1, size)]
        step *= 2
    return rank[:n]


def _common(codes: array, order: list[int], least: int, same: np.ndarray) -> array:
    """Words that each suffix of ``order`` has in common with the one before it; 0 stands for fewer than ``least``.

    A suffix has at most one word less in common with its neighbour than the suffix before it in the text has.
    """
    common = array("i", bytes(4 * len(order)))
    place = {at: k for k, at in enumerate(order)}
    last, have = -2, 0
    for at in sorted(order):
        k = place[at]
        if not same[k]:
            last = -2
            continue
        have = max(least, have - 1) if last == at - 1 else least
        other = order[k - 1]
        while codes[at + have] == codes[other + have]:
            have += 1
        common[k] = have
        last = at
    return common


class _Interval:
    """Positions whose suffixes share ``depth`` words: one left-word class as a plain list, or a sorted list of several classes."""

    __slots__ = ("at", "depth", "left")

    def __init__(self, depth: int, at: list[int], left: int) -> None:
        self.depth, self.at, self.left = depth, at, left


def maximal_pairs(codes: array, order: list[int], common: array, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """(x, y, words in common) of the maximal pairs that are runs, from the LCP-interval tree bottom up.

    Children are joined smaller into larger. Pairs from one left-word class can be extended to the left, so only
    when different classes meet are neighbours looked at: x and y next to each other in the joined interval, from
    different children (so they end where the interval does) and with different left words. If their distance d
    satisfies l >= (times - 1) d and l + d >= least, the words from x to y + l are a run of smallest period d: a
    smaller period q would put an occurrence at x + q, between them. And a run of period q is such a pair: nothing
    between x and x + q starts with the same words. The smaller child's positions go in descending order, so that
    x + q is there before x.
    """
    def join(depth: int, a: _Interval, b: _Interval) -> Generator[tuple[int, int, int], None, _Interval]:
        """Both as one interval of this depth; yields its pairs."""
        if len(a.at) < len(b.at):
            a, b = b, a
        a.depth = depth
        if a.left == b.left != MIXED:
            a.at += b.at
            return a
        for side in (a, b):
            if side.left != MIXED:
                side.at.sort()
        a.left = MIXED
        into, reach, places, own = a.at, depth // (times - 1), None, set(b.at)
        if len(b.at) * 64 > len(into):
            a.at = into = sorted(into + b.at)
            places = [k for k, x in enumerate(into) if x in own]
        for x in reversed(b.at):
            if places:
                k = places.pop()
            else:
                k = bisect_left(into, x)
                into.insert(k, x)
            for other in (k - 1, k + 1):
                if 0 <= other < len(into) and into[other] not in own:
                    first, second = (into[other], x) if other < k else (x, into[other])
                    gap = second - first
                    if gap <= reach and gap + depth >= least and codes[first + depth] != codes[second + depth] and codes[first - 1] != codes[second - 1]:
                        yield first, second, depth
        return a

    stack: list[_Interval] = []
    for at, depth in chain(zip(order, common, strict=True), [(0, 0)]):
        while stack and stack[-1].depth > depth:
            top = stack.pop()
            if stack and stack[-1].depth >= depth:
                stack.append((yield from join(stack[-1].depth, stack.pop(), top)))
            elif depth:
                top.depth = depth  # the first child of a new interval
                stack.append(top)
        stack.append(_Interval(len(codes), [at], codes[at - 1]))


def runs_of(texts: pa.Array, least: int, times: int) -> tuple[Words, list[tuple[int, int, int, int]]]:
    """The words of some texts and their runs (text, start, length, period), sorted.

    Only suffixes whose first ``gram`` words come again in their text can be in a run, as a run of period q and
    length L repeats L - q >= gram words; they are found by hash (equal words have equal hashes), compared exactly.
    """
    words = Words(texts)
    gram = -(-least * (times - 1) // times)
    start, text = window_starts(words.first, gram)
    if not len(start):
        return words, []
    hashed = Rolling(words.hashes()).of(start, gram)
    order = np.lexsort((hashed, text))
    again = (np.diff(hashed[order]) == 0) & (np.diff(text[order]) == 0)
    marked = np.zeros(len(start), dtype=bool)
    marked[order[1:][again]] = marked[order[:-1][again]] = True
    kept = np.unique(text[marked])
    if not len(kept):
        return words, []
    # The words of the texts left, numbered so that no two texts share one: no suffix is compared beyond its text.
    size = np.diff(words.first)[kept]
    base = np.cumsum(size) - size
    picked = np.concatenate([np.arange(words.first[t], words.first[t + 1]) for t in kept.tolist()])
    owner = np.repeat(np.arange(len(kept)), size)
    raw, begins, ends = words.data, words.start[picked].tolist(), words.end[picked].tolist()
    body = raw.tobytes()
    coded = pa.array([body[a:b] for a, b in zip(begins, ends, strict=True)], pa.large_binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    code = np.unique(owner * (len(coded) + 1) + coded, return_inverse=True)[1].astype(np.int64)
    rank = suffix_ranks(code)
    back = np.zeros(len(words.first), dtype=np.int64)
    back[kept] = base - words.first[kept]
    candidates = start[marked] + back[text[marked]]
    candidates = candidates[np.argsort(rank[candidates])]
    # Neighbours share ``gram`` words if those words are equal, compared word by word.
    same = np.zeros(len(candidates), dtype=bool)
    same[1:] = True
    for k in range(gram):
        same[1:] &= code[candidates[1:] + k] == code[candidates[:-1] + k]
    codes = array("i", np.append(code, -1).astype(np.int32).tobytes())
    ordered = candidates.tolist()
    common = _common(codes, ordered, gram, same)
    found = []
    for x, y, depth in maximal_pairs(codes, ordered, common, least, times):
        t = int(owner[x])
        found.append((int(kept[t]), x - int(base[t]), depth + y - x, y - x))
    return words, sorted(found, key=lambda r: (r[0], r[1], r[3]))


def _strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run (start, length, period) with the greatest length / period, then the smallest start, then the smallest period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def find_runs(docs: DataFrame, least: int = 24, times: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs array<(start, length, period)>, strongest (start, length, period), collapsed): one row per row.

    A run is a stretch of consecutive words `[^\\x20\\x09-\\x0D]+` with smallest period q (words q apart are equal)
    and a length of at least max(``least``, ``times`` q) that no neighbouring word extends; runs are ordered by
    start, then period. ``collapsed`` is the words joined by blanks without those that a run contains after its
    first q words. ``strongest`` has the greatest length / period, of equals the smallest start, then period.

    Null, empty and short texts have no runs (``strongest`` is null) and keep their words; repeated rows have a row
    each; other columns are left out, whatever their names; an empty table gives an empty result. Nothing is
    shuffled: a task holds 4 MB of text or one text, and some hundred bytes per word of texts that repeat themselves.
    """
    if times < 3:
        raise ValueError("runs repeat their period three times at least")
    ship_code(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    run = "struct<start long, length long, period long>"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            words, found = runs_of(batch.column("text"), least, times)
            yield _verdict(batch.column("doc_id"), words, found)

    return rows.mapInArrow(find, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, runs array<{run}>, strongest {run}, collapsed string")


def _verdict(doc: pa.Array, words: Words, found: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    count = np.diff(words.first)
    by_text: dict[int, list[tuple[int, int, int]]] = {}
    for t, *run in found:
        by_text.setdefault(t, []).append(tuple(run))
    runs, best, collapsed = [], [], []
    body = words.data.tobytes()
    for t, n in enumerate(count.tolist()):
        a, b = int(words.first[t]), int(words.first[t + 1])
        own = by_text.get(t, [])
        kept = body[int(words.start[a]) : int(words.end[b - 1])].split() if n else []
        if own:
            gone = np.zeros(n + 1, dtype=np.int64)
            for start, length, period in own:
                gone[start + period] += 1
                gone[start + length] -= 1
            kept = [kept[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
        named = [dict(zip(("start", "length", "period"), x, strict=True)) for x in own]
        top = _strongest(own)
        runs.append(named)
        best.append(None if top is None else dict(zip(("start", "length", "period"), top, strict=True)))
        collapsed.append(b" ".join(kept).decode())
    kind = pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])
    return pa.RecordBatch.from_arrays([doc, pa.array(count.astype(np.int64)), pa.array(runs, pa.list_(kind)), pa.array(best, kind), pa.array(collapsed, pa.string())], ["doc_id", "n_words", "runs", "strongest", "collapsed"])
