"""The mixture against plain Python."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest

from marketspark.llm import mixing


def rows(seed, n=300):
    rng = random.Random(seed)
    return [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 30))), rng.choice(["a"] * 12 + ["b"] * 4 + ["c", None])) for i in range(n)]


def unit(*parts):
    return int(hashlib.md5(":".join("" if p is None else str(p) for p in parts).encode()).hexdigest()[:12], 16)


def plain(docs, exponent, seed, budget=None):
    size = {d: len(t.split()) for d, t, _ in docs}
    own = defaultdict(list)
    for d, _, s in docs:
        own[s].append(d)
    tokens = {s: sum(size[d] for d in ds) for s, ds in own.items()}
    weight = {s: t**exponent for s, t in tokens.items()}
    spend = budget or max(t ** (1 - exponent) for t in tokens.values()) * sum(weight.values())
    out = Counter()
    for s, ds in own.items():
        target = math.floor(spend * weight[s] / sum(weight.values()) + 0.5)
        epochs, rest = divmod(target, tokens[s])
        for d in ds:
            out[d] += epochs
        blocks = math.ceil(math.sqrt(len(ds)))
        block = {d: unit(f"b{seed}", d) % blocks for d in ds}
        deck = sorted((unit(f"p{seed}", epochs, s, block[d]), block[d], unit(f"d{seed}", epochs, d), d) for d in ds if size[d])
        for *_, d in deck:
            if rest <= 0:
                break
            out[d] += 1
            rest -= size[d]
    return Counter({d: n for d, n in out.items() if n})


@pytest.mark.parametrize("repeats", [1.0, 2.0, 5.0, 100.0])
def test_repetition_limit(spark, repeats):
    docs = rows(int(repeats))
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    counts = mixing.source_counts(frame.withColumn("n_tokens", mixing.n_tokens()))
    tokens = [r.tokens for r in counts.collect()]
    exponent = mixing.fit_exponent(counts, repeats=repeats)
    limit = max(0.0, 1 - math.log(repeats) / math.log(max(tokens) / min(tokens)))
    assert abs(exponent - limit) < 1e-9
    got = mixing.mix(frame, repeats=repeats, seed=3)
    assert Counter(r.doc_id for r in got.collect()) == plain(docs, exponent, 3)
    copies = Counter((r.doc_id, r.copy) for r in got.collect())
    assert set(copies.values()) == {1}


def test_entropy_target(spark):
    frame = spark.createDataFrame(rows(9), "doc_id long, text string, source string")
    counts = mixing.source_counts(frame.withColumn("n_tokens", mixing.n_tokens()))
    tokens = [r.tokens for r in counts.collect()]

    def entropy(a):
        w = [t**a for t in tokens]
        return -sum(x / sum(w) * math.log(x / sum(w)) for x in w)

    exponent = mixing.fit_exponent(counts, entropy=0.9)
    assert 0 < exponent < 1 and math.isclose(entropy(exponent), 0.9 * math.log(len(tokens)), rel_tol=1e-6)
    assert mixing.fit_exponent(counts, entropy=0.1) == 1.0


def test_budget(spark):
    docs = rows(4)
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    exponent = mixing.fit_exponent(mixing.source_counts(frame.withColumn("n_tokens", mixing.n_tokens())), entropy=0.95)
    got = Counter(r.doc_id for r in mixing.mix(frame, entropy=0.95, budget=2500, seed=8).collect())
    assert got == plain(docs, exponent, 8, 2500)
    spent = sum(len(t.split()) * got[d] for d, t, _ in docs)
    assert 2500 - 4 <= spent <= 2500 + 4 * 30
