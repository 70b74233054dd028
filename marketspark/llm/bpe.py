"""Byte-level BPE: exact ids by dynamic programming over prefixes, and back to text."""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.llm.common import chunks
from marketspark.session import ship_code

#: A place where any text may be cut without changing its pieces: no piece goes on with a space after something else.
CUT = regex.compile(r"\S(?=\s)")
#: Code points of a text that are cut and encoded at a time, so that a giant text needs little beside its ids.
SLICE = 1 << 18
#: Pieces of at most so many bytes are encoded together, step by step; a worker remembers so many of them.
SHORT, KEPT_PIECES = 64, 200_000
#: Slots in which a worker remembers pairs of tokens found compatible or not.
PAIR_SLOTS = 1 << 20
#: Stand-ins for characters that this machine's Unicode tables class otherwise than the tokenizer does.
LETTER, NUMBER, SPACE, OTHER = "z", "0", "\t", "-"
#: The class of letters, numbers and white space in ``Vocabulary.classes``; all others have 0.
CLASSES = {LETTER: 1, NUMBER: 2, SPACE: 3, OTHER: 0}


@dataclass
class Vocabulary:
    """A tokenizer as arrays, a few MB that depend on its vocabulary alone.

    A merge number orders tokens by when they are made (single bytes -1, before all); ``left`` and ``right`` are
    the two parts of a merged token. ``edge_keys`` (state * 256 + byte) and ``edge_to`` are the suffix automaton
    of all tokens, ``link`` its suffix links, ``size`` the longest string of a state, ``token`` the token that this
    string is (or -1), and ``shorter`` the next state up the links whose string is a token. ``classes`` has the class
    of every code point, that of its stand-in where it is ``odd``.
    """

    texts: list[bytes]
    merge: np.ndarray
    left: np.ndarray
    right: np.ndarray
    edge_keys: np.ndarray
    edge_to: np.ndarray
    link: np.ndarray
    size: np.ndarray
    token: np.ndarray
    shorter: np.ndarray
    special: list[tuple[str, int]]
    odd: dict[int, str]
    classes: np.ndarray


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable bytes are themselves, others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def suffix_automaton(words: list[bytes]) -> tuple[list[dict[int, int]], list[int], list[int], list[int]]:
    """(edges, links, sizes, the state of each word): one automaton of the suffixes of all words.

    Words are added one after another from the root; where a prefix is known already its state is taken over or split.
    """
    edges: list[dict[int, int]] = [{}]
    link, size = [-1], [0]

    def split(p: int, byte: int, q: int) -> int:
        clone = len(edges)
        edges.append(dict(edges[q]))
        link.append(link[q])
        size.append(size[p] + 1)
        link[q] = clone
        while p >= 0 and edges[p].get(byte) == q:
            edges[p][byte] = clone
            p = link[p]
        return clone

    ends = []
    for word in words:
        last = 0
        for byte in word:
            known = edges[last].get(byte)
            if known is not None:
                last = known if size[known] == size[last] + 1 else split(last, byte, known)
                continue
            p, made = last, len(edges)
            edges.append({})
            size.append(size[last] + 1)
            link.append(0)
            while p >= 0 and byte not in edges[p]:
                edges[p][byte] = made
                p = link[p]
            if p >= 0:
                q = edges[p][byte]
                link[made] = q if size[q] == size[p] + 1 else split(p, byte, q)
            last = made
        ends.append(last)
    return edges, link, size, ends


def odd_characters(cut) -> dict[int, str]:
    """Code points that ``cut`` (the tokenizer's own splitting, text to end positions) classes otherwise than PIECES, with a stand-in of its class.

    All code points of one class in a row are one piece; where ``cut`` sees several, each is looked at on its own.
    """
    points = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and c != 0x20)
    odd = {}
    for stand_in, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s"), (OTHER, r"[^\s\p{L}\p{N}]")):
        same = "".join(regex.findall(pattern, points))
        at = 0
        for end in cut(same):
            x = same[at]
            ends = cut(f"a{x}1{x}-")
            theirs = LETTER if 1 not in ends else NUMBER if 3 not in ends else OTHER if 4 not in ends else SPACE
            odd |= {ord(c): theirs for c in same[at:end] if theirs != stand_in}
            at = end
    return odd


def character_classes(odd: dict[int, str]) -> np.ndarray:
    """The class of every code point as the tokenizer sees it."""
    points = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    classes = np.zeros(0x110000, dtype=np.uint8)
    for stand_in, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        classes[np.frombuffer("".join(regex.findall(pattern, points)).encode("utf-32-le"), dtype=np.uint32)] = CLASSES[stand_in]
    classes[list(odd)] = [CLASSES[x] for x in odd.values()]
    return classes


def piece_starts(points: np.ndarray, sizes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where the pieces begin that byte-level tokenizers cut texts into before merging, for texts one after another.

    ``points`` are their code points, ``sizes`` how many each has. The cuts are those of ``'s|'t|'re|'ve|'m|'ll|'d|
    ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``, a fixed value of the format: a piece is a run of one class
    with the blank before it; the last space of a run is no piece with the others where a text goes on.
    """
    n = len(points)
    kind, blank = classes[points], points == 0x20
    space = kind == CLASSES[SPACE]
    first = np.zeros(n + 1, dtype=bool)
    ends = np.cumsum(sizes)
    first[ends - sizes] = True
    first[n] = True
    goes_on = ~first[1:]  # the next code point is of the same text
    begins = first[:n].copy()
    begins[1:] |= (kind[1:] != kind[:-1]) & ~(blank[:-1] & ~first[1:n])
    begins[:-1] |= space[:-1] & ~space[1:] & goes_on[:-1]
    quote = np.flatnonzero((points == 0x27) & begins & goes_on)
    second = points[quote + 1]
    long = goes_on[quote + 1]
    third = points[np.minimum(quote + 2, n - 1)]
    long &= np.isin(second, [ord("r"), ord("v")]) & (third == ord("e")) | (second == ord("l")) & (third == ord("l"))
    short = np.isin(second, [ord(x) for x in "stmd"])
    begins[quote[short | long] + 1] = False
    after = np.concatenate([quote[short] + 2, quote[long] + 3])
    begins[after[after < n]] = True
    return np.flatnonzero(begins)


class Numbers(dict):
    """Numbers pieces in the order in which they are met, from ``kept`` on; ``new`` has those met since it was emptied."""

    def __init__(self, kept: int) -> None:
        super().__init__()
        self.kept, self.new = kept, []

    def __missing__(self, piece: str) -> int:
        number = self[piece] = self.kept + len(self.new)
        self.new.append(piece)
        return number


def load(path: str) -> Vocabulary:
    """Read a tokenizer file of the byte-level BPE kind; an error if it asks for anything that is not handled here."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or spec["normalizer"] or spec["post_processor"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError(f"{path} has added tokens that take in their surroundings")
    letters = byte_letters()
    ids = model["vocab"]
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    size = max([*ids.values(), *added.values()]) + 1
    texts = [b""] * size
    for word, i in ids.items():
        if word not in added:
            texts[i] = bytes(letters[x] for x in word)
    for word, i in added.items():
        texts[i] = word.encode()
    merge, left, right = (np.full(size, fill, dtype=np.int32) for fill in (-2, 0, 0))
    for letter in letters:
        merge[ids[letter]] = -1
    for n, pair in enumerate(model["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        made = ids[a + b]
        if merge[made] != -2:
            raise ValueError(f"{path} makes the token {a + b!r} in two ways")
        merge[made], left[made], right[made] = n, ids[a], ids[b]
    made = np.flatnonzero(merge > -2)
    edges, link, length, ends = suffix_automaton([texts[i] for i in made])
    token = np.full(len(edges), -1, dtype=np.int32)
    token[ends] = made
    shorter = np.zeros(len(edges), dtype=np.int32)
    for state in np.argsort(length, kind="stable")[1:].tolist():
        shorter[state] = link[state] if token[link[state]] >= 0 else shorter[link[state]]
    keys = np.fromiter((s << 8 | b for s, e in enumerate(edges) for b in e), dtype=np.int64)
    to = np.fromiter((t for e in edges for t in e.values()), dtype=np.int32)
    odd = odd_characters(_library_cut())
    found = Vocabulary(texts, merge, left, right, keys, to, np.array(link, np.int32), np.array(length, np.int32), token, shorter, sorted(added.items()), odd, character_classes(odd))
    words = [texts[i] for i in made.tolist()]
    if Encoder(found).encode_pieces(words) != [(i,) for i in made.tolist()]:
        raise ValueError(f"{path} has tokens that its own merges do not reach")
    return found


def _library_cut():
    from tokenizers import pre_tokenizers

    splitter = pre_tokenizers.ByteLevel(add_prefix_space=False)
    return lambda text: [end for _, (_, end) in splitter.pre_tokenize_str(text)]


class Encoder:
    """The ids of texts, for one vocabulary in one worker."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        v = self.vocabulary = vocabulary
        order = np.argsort(v.edge_keys)
        self.edge_keys, self.edge_to = v.edge_keys[order], v.edge_to[order]
        merged = np.flatnonzero(v.merge >= 0)
        pairs = v.left[merged].astype(np.int64) * len(v.merge) + v.right[merged]
        order = np.argsort(pairs)
        self.pairs, self.pair_merge = pairs[order], v.merge[merged][order]
        self.special = {x: number for number, (x, _) in enumerate(v.special)}
        names = sorted((regex.escape(x) for x in self.special if x), key=len, reverse=True)
        self.split = regex.compile("|".join(names)) if names else None
        self.lengths = np.array([len(x) for x in v.texts])
        self.forget()
        self.lists: dict[str, array] = {}
        self.met = np.full(PAIR_SLOTS, -1, dtype=np.int64)
        self.met_fits = np.zeros(PAIR_SLOTS, dtype=bool)

    def forget(self) -> None:
        """Keep the ids of no pieces but the added tokens, which come first."""
        self.known = Numbers(len(self.special))
        self.kept = np.array([i for _, i in self.vocabulary.special], dtype=np.int32)
        self.kept_sizes = np.ones(len(self.special), dtype=np.int64)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of tokens a and b leaves exactly these two, for many pairs at once.

        Merges are taken back, the latest first (of equal ones the right-hand, as merging goes from left to right);
        whenever the two parts at the border could themselves be merged before that, the border would not have held.
        """
        v = self.vocabulary
        fits = np.ones(len(a), dtype=bool)
        todo, before = np.arange(len(a)), np.full(len(a), len(v.merge), dtype=np.int32)  # merges below it came first
        while len(todo):
            wanted = a.astype(np.int64) * len(v.merge) + b
            at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
            crossed = (self.pairs[at] == wanted) & (self.pair_merge[at] < before)
            fits[todo[crossed]] = False
            of_a, of_b = v.merge[a], v.merge[b]
            go = ~crossed & ((of_a >= 0) | (of_b >= 0))
            todo, a, b, of_a, of_b = todo[go], a[go], b[go], of_a[go], of_b[go]
            first = of_a > of_b
            before = np.where(first, of_a, of_b + 1)
            a, b = np.where(first, v.right[a], a), np.where(first, b, v.left[b])
        return fits

    def remembered(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``compatible`` through a table of pairs met before."""
        pair = a.astype(np.int64) * len(self.vocabulary.merge) + b
        slot = pair * 0x9E3779B1 >> 7 & PAIR_SLOTS - 1
        new = np.flatnonzero(self.met[slot] != pair)
        fits = self.met_fits[slot]
        if len(new):
            _, first, back = np.unique(pair[new], return_index=True, return_inverse=True)
            fits[new] = self.compatible(a[new[first]], b[new[first]])[back]
            self.met[slot[new]] = pair[new]
            self.met_fits[slot[new]] = fits[new]
            clash = self.met[slot[new]] != pair[new]  # two new pairs in one slot: forget both
            self.met[slot[new[clash]]] = -1
        return fits

    def fits(self, a: int, b: int) -> bool:
        """``compatible`` for one pair."""
        v, before = self.vocabulary, len(self.lists["merge"])
        merge, left, right = self.lists["merge"], self.lists["left"], self.lists["right"]
        while self.merge_of.get(a * len(v.merge) + b, before) >= before:
            if merge[a] > merge[b]:
                before, a = merge[a], right[a]
            elif merge[b] >= 0:
                before, b = merge[b] + 1, left[b]
            else:
                return True
        return False

    def encode_piece(self, data: bytes) -> tuple[int, ...]:
        """``encode_pieces`` for one long piece, byte by byte in plain Python."""
        if not self.lists:
            v = self.vocabulary
            self.lists = {k: array("i", getattr(v, k).astype(np.int32).tobytes()) for k in ("merge", "left", "right", "link", "size", "token", "shorter")}
            self.edges = dict(zip(self.edge_keys.tolist(), self.edge_to.tolist(), strict=True))
            self.merge_of = dict(zip(self.pairs.tolist(), self.pair_merge.tolist(), strict=True))
        link, size, token, shorter = (self.lists[k] for k in ("link", "size", "token", "shorter"))
        edges, last, pairs, state, length = self.edges, array("i", bytes(4 * len(data) + 4)), {}, 0, 0
        for end, byte in enumerate(data, 1):
            while (to := edges.get(state << 8 | byte)) is None:
                state = link[state]
                length = size[state]
            state, length = to, length + 1
            at = state if size[state] == length and token[state] >= 0 else shorter[state]
            while start := end - size[at]:
                pair = (last[start], token[at])
                if pair not in pairs:
                    pairs[pair] = self.fits(*pair)
                if pairs[pair]:
                    break
                at = shorter[at]
            last[end] = token[at]
            if len(pairs) > PAIR_SLOTS // 4:
                pairs.clear()
        ids, end = array("i"), len(data)
        while end:
            ids.append(last[end])
            end -= len(self.vocabulary.texts[last[end]])
        return tuple(reversed(ids))

    def encode_pieces(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each piece."""
        ids, sizes = self.encode_together(pieces)
        ends, ids = np.cumsum(sizes).tolist(), ids.tolist()
        return [tuple(ids[a:b]) for a, b in pairwise([0, *ends])]

    def encode_together(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after another and how many each has: for every prefix the one token that its encoding ends with, then back from the end.

        Tokens that end a prefix are found along the suffix links of the automaton's longest match, so the work is
        a small multiple of the bytes however long a piece is. All pieces move on by a byte together, and back by a token.
        """
        v = self.vocabulary
        sizes = np.array([len(x) for x in pieces], dtype=np.int64)
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        longest = int(sizes[0]) if len(sizes) else 0
        begin = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(pieces[i] for i in order.tolist()), dtype=np.uint8).astype(np.int64)
        last = np.zeros(len(data), dtype=np.int32)
        state, length = np.zeros(len(pieces), dtype=np.int64), np.zeros(len(pieces), dtype=np.int32)
        for step in range(longest):
            n = int(np.searchsorted(-sizes, -step))  # pieces of more than ``step`` bytes
            byte = data[begin[:n] + step]
            todo = np.arange(n)
            while len(todo):  # the root has an edge for every byte
                wanted = state[todo] << 8 | byte[todo]
                at = np.minimum(np.searchsorted(self.edge_keys, wanted), len(self.edge_keys) - 1)
                found = self.edge_keys[at] == wanted
                state[todo[found]] = self.edge_to[at[found]]
                length[todo[found]] += 1
                todo = todo[~found]
                state[todo] = v.link[state[todo]]
                length[todo] = v.size[state[todo]]
            at, todo = state[:n].copy(), np.arange(n)
            at = np.where((v.size[at] == length[:n]) & (v.token[at] >= 0), at, v.shorter[at])
            while len(todo):
                one, start = v.token[at], step + 1 - v.size[at]
                fits = start == 0
                rest = np.flatnonzero(~fits)
                fits[rest] = self.remembered(last[begin[todo[rest]] + start[rest] - 1], one[rest])
                last[begin[todo[fits]] + step] = one[fits]
                todo, at = todo[~fits], v.shorter[at[~fits]]
        end, todo, found = begin + sizes, np.flatnonzero(sizes), []
        while len(todo):
            one = last[end[todo] - 1]
            found.append((order[todo], one))
            end[todo] -= self.lengths[one]
            todo = todo[end[todo] > begin[todo]]
        counts = np.zeros(len(pieces), dtype=np.int64)
        for piece, _ in found:
            counts[piece] += 1
        ids, at = np.empty(counts.sum(), dtype=np.int32), np.cumsum(counts)
        for piece, one in found:
            at[piece] -= 1
            ids[at[piece]] = one
        return ids, counts

    def parts(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Slices of a text and the number of the added token, if any, that follows each."""
        at = 0
        for m in chain(self.split.finditer(text) if self.split else (), [None]):
            end = m.start() if m else len(text)
            while end - at > SLICE and (cut := CUT.search(text, at + SLICE, end)):
                yield text[at : cut.end()], None
                at = cut.end()
            yield text[at:end], self.special[m.group()] if m else None
            at = m.end() if m else end

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text. New pieces of many slices are encoded together."""
        open_parts: list[tuple[str, int | None]] = []
        ends, begun, size = [], [], 0
        for text in texts:
            for part in self.parts(text):
                open_parts.append(part)
                size += len(part[0])
                if size > 4 * SLICE:
                    yield from self._close(open_parts, ends, begun)
                    open_parts, ends, size = [], [], 0
            ends.append(len(open_parts))
        yield from self._close(open_parts, ends, begun)

    def _close(self, parts: list[tuple[str, int | None]], ends: list[int], begun: list[np.ndarray]) -> Iterator[np.ndarray]:
        """The ids of texts that end after ``ends`` of ``parts``; ``begun`` has those of a text that does not end yet."""
        if len(self.known) > KEPT_PIECES:
            self.forget()
        text = "".join(part for part, _ in parts)
        sizes = np.array([len(part) for part, _ in parts], dtype=np.int64)
        starts = piece_starts(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), sizes[sizes > 0], self.vocabulary.classes)
        pieces = (text[a:b] for a, b in pairwise([*starts.tolist(), len(text)]))
        numbers = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(starts))
        numbers, ids, counts = self._encode_new(numbers)
        added = np.array([special is not None for _, special in parts], dtype=bool)
        until = np.searchsorted(starts, np.cumsum(sizes))
        numbers = np.insert(numbers, until[added], [special for _, special in parts if special is not None])
        until = np.concatenate([[0], until + np.cumsum(added)])
        counts, first = counts[numbers], (np.cumsum(counts) - counts)[numbers]
        at = np.concatenate([[0], np.cumsum(counts)])
        ids = ids[np.repeat(first - at[:-1], counts) + np.arange(at[-1])]
        start = 0
        for end in at[until[ends]].tolist():
            yield np.concatenate([*begun, ids[start:end]])
            begun.clear()
            start = end
        begun.append(ids[start:])

    def _encode_new(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers, ids, counts): the ids of all numbered pieces, the new ones encoded; long ones are last and not remembered."""
        known, old = self.known, self.known.kept
        new, known.new = known.new, []
        data = [p.encode() for p in new]
        size = np.array([len(x) for x in data], dtype=np.int64)
        short, long = np.flatnonzero(size <= SHORT).tolist(), np.flatnonzero(size > SHORT).tolist()
        ids, counts = self.encode_together([data[i] for i in short])
        self.kept, self.kept_sizes = np.concatenate([self.kept, ids]), np.concatenate([self.kept_sizes, counts])
        known.kept = old + len(short)
        if not long:
            return numbers, self.kept, self.kept_sizes
        for i in long:
            del known[new[i]]
        known.update((new[i], old + n) for n, i in enumerate(short))
        place = np.arange(old + len(new))
        place[old + np.array([*short, *long])] = np.arange(old, old + len(new))
        more = [np.array(self.encode_piece(data[i]), dtype=np.int32) for i in long]
        return place[numbers], np.concatenate([self.kept, *more]), np.concatenate([self.kept_sizes, [len(x) for x in more]])


_encoders: dict[str, Encoder] = {}


def _encoder(key: str, shared) -> Encoder:
    """One encoder per worker process, whatever number of tasks it runs."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(shared.value)
    return _encoders[key]


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): the ids of every whole text, one row per row of ``docs``.

    Null and empty texts have no ids. Rows that repeat an id or a text have a row each; other columns are left
    out, whatever their names; an empty table gives an empty result. Nothing is shuffled; tasks hold the
    vocabulary (its size depends on the tokenizer alone), bounded memories of pieces and pairs, and 4 MB of text
    or one text.
    """
    ship_code(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    key = f"{docs.sparkSession.sparkContext.applicationId}-{shared._jbroadcast.id()}"
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(key, shared)
        for batch in chunks(batches):
            made = [*encoder.ids([text or "" for text in batch.column("text").to_pylist()])]
            offsets = np.concatenate([[0], np.cumsum([len(ids) for ids in made])])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(made) if made else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, ids, decoded): the text that ``ids`` stand for, added tokens included.

    Ids that the vocabulary does not have, and nulls, are passed over; bytes that are no UTF-8 become U+FFFD. Null
    and empty lists give the empty text; an empty table gives an empty result.
    """
    ship_code(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary.texts)
    kept = rows.select("doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array([*shared.value, b""], pa.large_binary())
        for batch in batches:
            lists = batch.column("ids")
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ids = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
            ids = np.where((ids >= 0) & (ids < len(tokens) - 1), ids, len(tokens) - 1)
            offsets = np.concatenate([[0], np.cumsum(size)])
            for a, b in _bounded(offsets):
                parts = pa.LargeListArray.from_arrays(pa.array(offsets[a : b + 1] - offsets[a], pa.int64()), tokens.take(pa.array(ids[offsets[a] : offsets[b]])))
                texts = pc.binary_join(parts, pa.scalar(b"", pa.large_binary()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], lists[a:b], pa.array([x.as_py().decode("utf-8", "replace") for x in texts], pa.string())], ["doc_id", "ids", "decoded"])

    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def _bounded(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` ids, or one row."""
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, to
        at = to
