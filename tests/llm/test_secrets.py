"""Spans against plain matching, trigram queries against what their patterns match."""

import random
import re

import pytest

from marketspark.llm import secrets

PLAIN = {
    "assign": (r"""(?a:(?i:(password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}


def brute(text):
    found = []
    for at, (kind, (pattern, group, least)) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            if len(m[group]) >= least:
                found.append((m.start(), at, m.end(), kind))
    return [(k, a, b) for a, _, b, k in sorted(found)]


def noise(seed, n):
    rng = random.Random(seed)
    parts = ["password", "PassWd", "secret", "toKen", "api_key", "apikey", ":", "=", " ", "'", '"', "é", "ſecret", "toKen", "AKIA", "ABCDEFGH12", "deadbeef", "0123456789abcdef", "x", "\n", "long-Value_123", "ab"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_base_spans(spark):
    texts = noise(1, 400)
    got = secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), secrets.BASE_RULES).collect()
    assert {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in got} == {i: brute(t) for i, t in enumerate(texts)}
    assert sum(map(len, (r.spans for r in got))) > 150


@pytest.mark.parametrize(("pattern", "matches"), [(rb"(foo|ba+r)_?baz", [b"foobaz", b"FOO_baz", b"baaar_baz"]), (rb"[xy]abc?d{2}e", [b"xabdde", b"yabcdde"]), (rb"(?i:token)[0-9]+end", [b"TOKEN55end"]), (rb"a.b|cdefg", [b"axb", b"cdefg"])])
def test_queries_hold_for_every_match(pattern, matches):
    query = secrets.trigram_query(pattern)
    for m in matches:
        grams = {m.lower()[i : i + 3] for i in range(len(m) - 2)}
        assert query is None or any(s <= grams for s in query)


def test_rules_without_trigrams_scan_fully():
    assert secrets.trigram_query(rb"[0-9a-f]+") is None and secrets.trigram_query(rb"ab|cdefg") is None
    assert secrets.trigram_query(rb"AKIA[A-Z0-9]+") == {frozenset([b"aki", b"kia"])}


def test_redaction(spark):
    key = "AKIA" + "Z" * 16
    rows = [(1, f"é {key} end", 100), (2, "nothing", 7), (3, f"token = '{'a' * 40}' x", 50), (4, None, 0)]
    got = {r.doc_id: (r.text, r.n_chars) for r in secrets.redact(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()}
    assert got == {1: ("é [redacted] end", 16), 2: ("nothing", 7), 3: ("[redacted]' x", 13), 4: (None, 0)}


def test_postings(spark):
    rows = [(1, "my TOKEN here"), (2, "akia"), (3, None)]
    got = {(r.trigram, r.doc_id) for r in secrets.posting_table(spark.createDataFrame(rows, "doc_id long, text string"), secrets.BASE_RULES).collect()}
    assert got == {("tok", 1), ("oke", 1), ("ken", 1), ("aki", 2), ("kia", 2)}
