"""Collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketspark.llm import phrases


def plain(rows, order, least, percent, top):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = re.findall("[^ \t]+", piece)
            total[lang or "und"] += len(words)
            for m in range(1, order + 1):
                counts.update((lang or "und", tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    found = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in found.items():
        if any(100 * b >= percent * a for (other, q), b in found.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))):
            continue
        score, _, left, right = min((10**6 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), left, right))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted(x for x in out if x[0] == lang)[:top]
        ranked += [(lang, i + 1, p.decode(), -a, le, ri, total[lang], -s) for i, (_, s, a, p, le, ri) in enumerate(own)]
    return sorted(ranked)


def texts(seed, n):
    rng = random.Random(seed)
    made = []
    for _ in range(n):
        words = [rng.choice(["The", "cat", "sat", "on", "é", "mat", "Été", "x"]) + rng.choice(["", "", ",", ".", "\n", "\x0b", " ;"]) for _ in range(rng.randint(0, 60))]
        made.append((rng.choice(["en", "de", None, "und"]), rng.choice([" ", "  ", "\t"]).join(words)))
    return made


def test_against_plain_counting(spark):
    rows = texts(1, 150) + [("en", None), ("fr", ""), ("fr", "one two")] + [("en", "hot spot of words")] * 40
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    for order, least, percent, top in ((3, 10, 50, 2000), (2, 3, 50, 5), (4, 5, 80, 30)):
        got = sorted(tuple(r) for r in phrases.collocations(docs, order, least, percent, top).collect())
        assert got == plain(rows, order, least, percent, top)


def test_chunks_do_not_matter(spark, monkeypatch):
    rows = texts(2, 60)
    docs = spark.createDataFrame(rows, "lang string, text string")
    want = sorted(phrases.phrase_counts(docs, 3, 1).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(phrases.phrase_counts(docs.repartition(9), 3, 1).collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_odd_tables(spark):
    docs = spark.createDataFrame([("en", None, 1), (None, "", 2), ("en", "a b", 3), ("en", "a b", 3)], "lang string, text string, w1 long")
    docs = docs.withColumn("n", F.lit("x")).withColumn("a.b", F.lit("x")).withColumn("phrase", F.lit("x"))
    assert phrases.collocations(docs).count() == 0
    assert [tuple(r) for r in phrases.collocations(docs, least=2).collect()] == [("en", 1, "a b", 2, 2, 2, 4, 1_000_000)]
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_products_beyond_64_bits(spark):
    """Counts whose squares pass 64 bits: the score's expression on made-up counts."""
    a, left, right = 4 * 10**12, 5 * 10**12 + 1, 9 * 10**12
    got = spark.createDataFrame([(a, left, right)], "a long, l long, r long").selectExpr(phrases.SCORE).first()[0]
    assert got == 10**6 * a * a // (left * right)


def test_long_text(spark):
    text = "one two three " * 700_000  # beyond one chunk
    docs = spark.createDataFrame([("en", text)], "lang string, text string")
    counts = {r.phrase: r.f for r in phrases.phrase_counts(docs, 3, 10).filter("size > 0").collect()}
    assert counts["one two three"] == 700_000 and counts["three one"] == 699_999 and len(counts) == 9


def test_hot_heads(spark, monkeypatch):
    """Windows of hot pairs of words are dealt by their third word; counts stay the same."""
    monkeypatch.setattr(phrases, "HOT_SHARE", 0.05)
    rows = [("en", f"buy now item{i % 40} or buy now item{i % 3} x{i}") for i in range(400)] + texts(5, 50)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    seed, _, hot = phrases.survey(docs, 3)
    assert phrases.window_counts(docs, 3, seed, hot).filter("salt > 0").select("w1", "w2").distinct().count() >= 1
    for order in (2, 3, 4):
        got = sorted(tuple(r) for r in phrases.collocations(docs, order, 10).collect())
        assert got == plain(rows, order, 10, 50, 2000)


def test_words_that_share_a_key(spark, monkeypatch):
    """The next seed is taken where two words have one key; with none left it is an error."""
    rows = spark.createDataFrame([("en", "a b a b c")], "lang string, text string")
    seed, words, hot = phrases.survey(rows, 3)
    assert seed == 0 and sorted(r.word for r in words.collect()) == ["a", "b", "c"] and len(hot) > 0
    monkeypatch.setattr(phrases, "word_keys", lambda words, seed: np.full(len(words) + 1, 7 if seed else 8, dtype=np.uint64))
    with pytest.raises(RuntimeError):
        phrases.survey(rows, 3, seeds=[0, 1])
