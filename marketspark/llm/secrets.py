"""Secret scanning with a trigram index per block of documents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from marketspark.llm.common import chunks, fold, numbered, quoted, text_bytes
from marketspark.session import ship_code

try:
    from re import _constants as sre_kinds
    from re import _parser as sre_parse
except ImportError:  # Python before 3.11
    import sre_constants as sre_kinds
    import sre_parse


@dataclass(frozen=True)
class Rule:
    """A pattern over UTF-8 bytes; a match counts if the bytes of ``group`` number ``least`` or more."""

    kind: str
    pattern: bytes
    group: int = 0
    least: int = 1


# The base rules in the order in which they are listed.
BASE_RULES = (
    Rule("assign", rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", rb"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", rb"[0-9a-f]+", 0, 32),
)
#: Spans that the method adds.
MORE_RULES = (
    Rule("pem", rb"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", rb"gh[oprsu]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", rb"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("jwt", rb"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("bearer", rb"(?i:bearer)\x20+([A-Za-z0-9+/_.=-]+)", 1, 20),
)

#: A Boolean query: any of these sets of trigrams, all of a set. None: no mandatory trigram, scan fully.
Query = frozenset[frozenset[bytes]] | None
#: Strings of an alternation beyond which a part counts as unknown.
_MOST = 64


def trigram_query(pattern: bytes) -> Query:
    """The trigrams (A-Z folded) of which every match of a pattern must contain all of at least one set."""
    exact, need = _walk(sre_parse.parse(pattern))
    if exact is not None:
        need = _either(*(_grams(x) for x in exact))
    return need


def _grams(text: bytes) -> Query:
    found = frozenset(text[i : i + 3] for i in range(len(text) - 2))
    return frozenset([found]) if found else None


def _either(*queries: Query) -> Query:
    if not queries or any(q is None for q in queries):
        return None
    sets = frozenset().union(*queries)
    return frozenset(x for x in sets if not any(y < x for y in sets))


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    return frozenset(x | y for x in a for y in b) if len(a) * len(b) <= _MOST else a


def _walk(parsed) -> tuple[set[bytes] | None, Query]:
    """The strings that a part stands for, if they are few, and what it requires otherwise."""
    need: Query = None


    run: set[bytes] | None = {b""}  # what the string has ended with since the last unknown part
    whole = True
    for op, value in parsed:
        part, asked = _one(op, value)
        if part is None or len(run) * len(part) > _MOST:
            need = _both(need, _either(*(_grams(x) for x in run)))
            need = _both(need, asked if part is None else _either(*(_grams(x) for x in part)))
            run, whole = {b""}, False
        else:
            run = {x + y for x in run for y in part}
    if whole:
        return run, None
    return None, _both(need, _either(*(_grams(x) for x in run)))


def _one(op, value) -> tuple[set[bytes] | None, Query]:
    kinds = sre_kinds
    if op is kinds.LITERAL:
        return ({bytes([value]).lower()}, None) if value < 256 else (None, None)
    if op is kinds.IN:
        if all(k is kinds.LITERAL for k, _ in value):
            return {bytes([v]).lower() for _, v in value}, None
        return None, None
    if op is kinds.AT:
        return {b""}, None
    if op is kinds.SUBPATTERN:
        return _walk(value[-1])
    if op is kinds.BRANCH:
        parts = [_walk(x) for x in value[1]]
        if all(e is not None for e, _ in parts):
            return set().union(*(e for e, _ in parts)), None
        return None, _either(*(q if e is None else _either(*(_grams(x) for x in e)) for e, q in parts))
    if op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT):
        low, high, inner = value
        exact, need = _walk(inner)
        if (low, high) == (0, 1) and exact is not None:
            return exact | {b""}, None
        if low == high == 1:
            return exact, need
        return None, (need if exact is None else _either(*(_grams(x) for x in exact))) if low else None
    return None, None


def _code(gram: bytes) -> int:
    return gram[0] << 16 | gram[1] << 8 | gram[2]


class BlockIndex:
    """Postings (text numbers in order) of the wanted trigrams in one block of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> None:
        low = fold(data).astype(np.int32)
        codes = low[:-2] << 16 | low[1:-1] << 8 | low[2:]
        hit = np.flatnonzero(_isin(codes, wanted))
        text = np.searchsorted(offsets, hit, side="right") - 1
        inside = hit + 3 <= offsets[text + 1]
        pair = np.unique(np.stack([codes[hit[inside]].astype(np.int64), text[inside]]), axis=1) if inside.any() else np.zeros((2, 0), np.int64)
        self.all = np.arange(len(offsets) - 1)
        cut = np.flatnonzero(np.diff(pair[0])) + 1
        self.postings = {int(g[0]): t for g, t in zip(np.split(pair[0], cut), np.split(pair[1], cut), strict=True) if len(g)}

    def candidates(self, query: Query) -> np.ndarray:
        """Texts that satisfy a Boolean query; all texts if it asks for nothing."""
        if query is None:
            return self.all
        none = self.all[:0]
        found = none
        for grams in query:
            lists = sorted((self.postings.get(_code(g), none) for g in grams), key=len)
            rest = lists[0]
            for more in lists[1:]:
                rest = np.intersect1d(rest, more, assume_unique=True)
            found = np.union1d(found, rest)
        return found


def _isin(codes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Membership by a table over hashed codes, then exactly."""
    table = np.zeros(1 << 16, dtype=bool)
    table[(wanted ^ (wanted >> 8)) & 0xFFFF] = True
    maybe = table[(codes ^ (codes >> 8)) & 0xFFFF]
    maybe[maybe] = np.isin(codes[maybe], wanted)
    return maybe


def hex_like(rule: Rule) -> bool:
    """Whether a rule is one repeated byte class, so that its matches are the maximal runs of the class."""
    parsed = list(sre_parse.parse(rule.pattern))
    return len(parsed) == 1 and parsed[0][0] is sre_kinds.MAX_REPEAT and parsed[0][1][:2] == (1, sre_kinds.MAXREPEAT) and len(parsed[0][1][2]) == 1


def runs(data: np.ndarray, offsets: np.ndarray, member: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(text, start, end) of the maximal runs of member bytes that are long enough, in bytes of the text."""
    inside = member[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin[heads] = inside[heads]
    stop = inside
    stop[:-1] &= ~inside[1:] | begin[1:]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    long = end - start >= least
    start, end = start[long], end[long]
    text = np.searchsorted(offsets, start, side="right") - 1
    yield from zip(text.tolist(), (start - offsets[text]).tolist(), (end - offsets[text]).tolist(), strict=True)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id and spans, array of (kind, start, end) in code points, end exclusive.

    Per kind the leftmost non-overlapping matches, less those too short, by start and then rule order. Each
    block of texts gets an inverted index of the trigrams that the rules' queries name; posting lists are
    intersected as the queries say and only candidates are matched. Rules without mandatory trigrams run over
    every text. Blocks stay in their task, so nothing is shuffled. Null and empty texts have no spans; repeated
    rows are scanned alike. With ``keep`` all columns of ``docs`` stay and ``spans`` is added (or replaced).
    """
    order = {r.kind: i for i, r in enumerate(rules)}
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = np.array(sorted({_code(g) for q in queries if q for grams in q for g in grams}), dtype=np.int32)
    compiled = [re.compile(r.pattern) for r in rules]
    plain = [hex_like(r) for r in rules]
    ship_code(docs.sparkSession)
    if keep:
        rows, names = numbered(docs, text_col, "spans")
    else:
        rows, names = docs.select(F.col(quoted(id_col)).cast("long").alias("c0"), F.col(quoted(text_col)).alias("text")), ["doc_id"]

    def scan(column: pa.Array) -> list[list[tuple[str, int, int]]]:
        data, offsets = text_bytes(column)
        index = BlockIndex(data, offsets, wanted)
        found: list[list[tuple[str, int, int]]] = [[] for _ in range(len(column))]
        for rule, query, pattern, run in zip(rules, queries, compiled, plain, strict=True):
            if run:
                member = np.array([bool(pattern.fullmatch(bytes([b]))) for b in range(256)])
                for text, a, b in runs(data, offsets, member, rule.least):
                    found[text].append((rule.kind, a, b))
                continue
            for text in index.candidates(query).tolist():
                body = data[offsets[text] : offsets[text + 1]].tobytes()
                found[text] += [(rule.kind, m.start(), m.end()) for m in pattern.finditer(body) if m.end(rule.group) - m.start(rule.group) >= rule.least]
        for text, spans in enumerate(found):
            if spans:
                body = data[offsets[text] : offsets[text + 1]]
                points = np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])
                found[text] = sorted(((k, int(points[a]), int(points[b])) for k, a, b in spans), key=lambda x: (x[1], order[x[0]]))
        return found

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in own] for own in scan(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(spans, kind)], names=[*batch.schema.names[:-1], "spans"])

    shape = ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())]))
    return rows.mapInArrow(work, StructType([*rows.schema.fields[:-1], StructField("spans", shape)])).toDF(*names, "spans")


def posting_table(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(trigram, doc_id): the postings of the rules' trigrams, to be stored and searched again."""
    grams = sorted({g.decode("latin-1") for r in rules if (q := trigram_query(r.pattern)) for s in q for g in s})
    low = F.expr(f"translate(`{text_col}`, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    rows = docs.select(F.col(id_col).alias("doc_id"), low.alias("low"))
    return rows.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))).alias("trigram")).select("trigram", "doc_id")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, mark: str = "[redacted]", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by ``mark`` (overlapping spans by one), columns otherwise unchanged.

    ``size_col``, where it exists, becomes the length of a changed text. Null texts stay null.
    """
    names = docs.columns
    rows, text = docs.toDF(*[f"c{i}" for i in range(len(names))]), f"c{names.index(text_col)}"
    found = find_secrets(rows, rules, text_col=text, keep=True)
    cut = F.expr(f"""aggregate(spans, named_struct('out', '', 'at', 0L), (done, x) -> named_struct(
        'out', IF(x.start < done.at, done.out, concat(done.out, substring({text}, CAST(done.at + 1 AS INT), CAST(x.start - done.at AS INT)), '{mark}')),
        'at', greatest(done.at, x.end)), done -> concat(done.out, substring({text}, CAST(done.at + 1 AS INT))))""")
    changed = found.withColumn(text, F.when(F.size("spans") > 0, cut).otherwise(F.col(text)))
    if size_col in names:
        size = f"c{names.index(size_col)}"
        changed = changed.withColumn(size, F.when(F.size("spans") > 0, F.char_length(text).cast(rows.schema[size].dataType)).otherwise(F.col(size)))
    return changed.drop("spans").toDF(*names)
