"""Counts and base scores against plain Python, the recursions against sums over all paths."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from marketspark.llm import hmm
from marketspark.llm.common import documents

SF = "/root/testdata/sf0.001"


def chain(seed, states=2, symbols=4):
    rng = np.random.default_rng(seed)
    draw = lambda *n: (x := rng.random(n)) / x.sum(-1, keepdims=True)
    return hmm.Chain(draw(states), draw(states), draw(states, states), draw(states, symbols).T)


def paths(model, text):
    """Every state path with its joint probability."""
    for path in itertools.product(range(len(model.start)), repeat=len(text)):
        p = model.start[path[0]] * model.emit[text[0], path[0]]
        for a, b, s in zip(path, path[1:], text[1:]):
            p *= model.move[a, b] * model.emit[s, b]
        yield path, p


def test_forward_is_the_sum_over_paths():
    model, rng = chain(1), random.Random(1)
    texts = [[rng.randrange(4) for _ in range(n)] for n in (1, 5, 3, 8)]
    symbols, first = np.array(sum(texts, []), dtype=np.uint16), np.cumsum([0, *map(len, texts)])
    want = [math.log(sum(p for _, p in paths(model, t))) for t in texts]
    assert np.allclose(hmm.forward(model, symbols, first), want)


def test_expected_counts():
    model, text = chain(2), [0, 3, 1, 1, 2, 0]
    start, middle, move, emit, likely = hmm.expected(model, np.array(text, dtype=np.uint16), np.array([0, 6]))
    total = sum(p for _, p in paths(model, text))
    want_move, want_emit = np.zeros((2, 2)), np.zeros((4, 2))
    for path, p in paths(model, text):
        for a, b in zip(path, path[1:]):
            want_move[a, b] += p / total
        for s, k in zip(text, path):
            want_emit[s, k] += p / total
    assert np.allclose(move, want_move) and np.allclose(emit, want_emit) and np.isclose(likely, math.log(total))
    assert np.isclose(start.sum(), 1) and middle.sum() == 0


@pytest.mark.parametrize("frequent", [50, 500_000])
def test_scores(spark, frequent):
    docs = documents(spark, SF)
    got = {r.doc_id: r for r in hmm.score(docs, states=3, rounds=2, own=40, frequent=frequent).collect()}
    tokens = {r.doc_id: [w.lower() for w in (r.text or "").encode().split()] + [None] for r in docs.collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    count = Counter(t for d, own in tokens.items() if not held[d] for t in own)
    total, distinct = sum(count.values()), len(count)
    for d, own in tokens.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(own), sum(t in count for t in own), total)
        assert math.isclose(r.base_score, sum(math.log10((count[t] + 1) / (total + distinct + 1)) for t in own), rel_tol=1e-9)
        assert r.score < 0


def test_broadcast_bound_does_not_change_scores(spark):
    docs = documents(spark, SF).limit(60)
    a, b = ({r.doc_id: r.score for r in hmm.score(docs, states=2, rounds=2, own=20, frequent=n).collect()} for n in (30, 10**6))
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], rel_tol=1e-9) for k in a)


def test_probabilities_of_all_words_sum_to_one():
    rng = np.random.default_rng(0)
    words = hmm.Vocabulary(np.arange(10, dtype=np.uint64), np.arange(10) + 1, np.r_[np.arange(4), np.full(6, 4 + 3)], 4, 55, 10, np.bincount([3], [45], hmm.CLASSES).astype(int), np.bincount([3], [6], hmm.CLASSES).astype(int))
    known = sum((c + 1) / (words.class_total[3] + words.class_distinct[3] + 1) for c in words.counts[4:])
    unseen = 1 / (words.class_total[3] + words.class_distinct[3] + 1)
    assert math.isclose(known + unseen, (45 + 6 + 1) / 52) and rng is not None


def test_learns_more_than_the_base(spark):
    got = hmm.score(documents(spark, "/root/testdata/sf0.01"), states=4, rounds=3, own=2000).filter("held_out")
    row = got.selectExpr("sum(score) / sum(n_tokens) AS model", "sum(base_score) / sum(n_tokens) AS base").first()
    assert row.model > row.base + 0.05
