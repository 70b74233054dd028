"""Against all windows compared one by one."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from marketspark.llm import substrings


def brute(docs, length):
    seen, out = set(), {}
    for doc, text in sorted(docs):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - length + 1):
            key = tuple(words[i : i + length])
            if key in seen:
                gone[i : i + length] = [True] * length
            seen.add(key)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out[doc] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 40))] for _ in range(6)]
    docs = []
    for doc in range(n):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += [rng.choice(vocabulary) for _ in range(rng.randint(0, 25))]
            passage = list(rng.choice(passages))
            if rng.random() < 0.4:
                passage[rng.randrange(len(passage))] = rng.choice(vocabulary)
            words += passage
        docs.append((doc, rng.choice([" ", "\n", " \t"]).join(words)))
    return docs + [(n + k, docs[k][1]) for k in range(8)]


@pytest.mark.parametrize(("seed", "length", "gram"), [(1, 20, 8), (2, 8, 3), (3, 12, 12)])
def test_same_as_brute_force(spark, seed, length, gram):
    docs = corpus(seed)
    got = substrings.find_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), length, gram)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()} == brute(docs, length)


def test_spans_are_the_removed_words(spark):
    got = substrings.find_repeats(spark.createDataFrame(corpus(4), "doc_id long, text string"), 20).collect()
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)
    assert any(r.spans for r in got)


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(0)
    words = [f"a{i}" for i in rng.integers(0, 5, 400)]
    made = substrings.Runs(pa.array([" ".join(words), " ".join(words[37:])]), 10, 4)
    by = {}
    for window, run in zip(made.window.tolist(), made.run.tolist()):
        by.setdefault(window, set()).add(int(made.anchor[run]))
    assert all(len(x) == 1 for x in by.values())
