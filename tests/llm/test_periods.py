"""Runs against all stretches tried one by one; the query against the contract in plain Python."""

import hashlib
import random
import zlib

import pytest

from marketspark.llm import periods, queries
from tests.conftest import SF


def plain_runs(words, least, times):
    """For every period the maximal stretches in which words that far apart are equal, but for multiples of a smaller one."""
    found = {}
    n = len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)  # the smallest period comes first
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts(seed, n):
    rng = random.Random(seed)
    made = []
    for _ in range(n):
        words = []
        while len(words) < rng.randint(0, 160):
            unit = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
            words += unit * rng.randint(1, 14) + unit[: rng.randint(0, 4)] + [rng.choice("abx") for _ in range(rng.randint(0, 3))]
        made.append(" ".join(words))
    return made


def of(rows):
    return {r.doc_id: [tuple(x) for x in r.runs] for r in rows}


@pytest.mark.parametrize("least,times", [(24, 3), (9, 3), (1, 3), (20, 4), (60, 5)])
def test_against_all_stretches(spark, least, times):
    made = texts(least, 400) + ["a " * 300, "a b " * 100 + "a", "", "x"]
    got = periods.find_runs(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(3), least, times).collect()
    assert len(got) == len(made)
    for r in got:
        words = made[r.doc_id].split()
        want = plain_runs(words, least, times)
        assert [tuple(x) for x in r.runs] == want
        assert (r.n_words, r.collapsed) == (len(words), collapsed(words, want))
        if want:
            best = min(want, key=lambda x: (-x[1] * 10**9 // x[2], x[0], x[2]))
            assert tuple(r.strongest) == best
        else:
            assert r.strongest is None


def test_many_meetings_of_one_passage(spark):
    """A passage that comes again after ever other words joins intervals of many left-word classes."""
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(30)]
    words = []
    for i in range(400):
        words += [f"l{rng.randrange(200)}", *passage, f"r{rng.randrange(50)}"] * rng.choice([1, 1, 1, 3])
    got = periods.find_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string"))
    assert of(got.collect())[1] == plain_runs(words, 24, 3)


def test_one_word_over_and_over(spark):
    got = periods.find_runs(spark.createDataFrame([(1, "spam " * 60_000 + "end"), (2, ("spam " * 50 + "ham ") * 900)], "doc_id long, text string"))
    rows = {r.doc_id: r for r in got.collect()}
    assert [tuple(x) for x in rows[1].runs] == [(0, 60_000, 1)] and rows[1].collapsed == "spam end"
    assert (0, 51 * 900, 51) in of(rows.values())[2] and len(rows[2].runs) == 901
    assert tuple(rows[2].strongest) == (0, 51 * 900, 51)


def test_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 1), (3, " \t ", 1), (None, "a " * 30, 1), (4, "é " * 30, 2), (4, "é " * 30, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int").selectExpr("*", "runs AS `a.b`", "text AS __text")
    got = periods.find_runs(docs).collect()
    assert sorted((str(r.doc_id), r.n_words, len(r.runs), r.collapsed) for r in got) == [("1", 0, 0, ""), ("2", 0, 0, ""), ("3", 0, 0, ""), ("4", 30, 1, "é"), ("4", 30, 1, "é"), ("None", 30, 1, "a")]
    assert periods.find_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periods.find_runs(docs, times=2)


def test_query_over_the_table(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op13_periodic_runs(spark, SF).collect()
    assert len(rows) == len(docs)
    n_found = 0
    for r in rows:
        words = docs[r.doc_id].encode().split()
        words = [w.decode() for w in words]
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words, 24, 3) if n < 4000 else None
        if runs is None:
            continue
        n_found += len(runs)
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
        best = min(runs, key=lambda x: (-x[1] * 10**9 // x[2], x[0], x[2])) if runs else (None, None, None)
        assert (r.start, r.length, r.period) == best
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
    assert n_found > 5
