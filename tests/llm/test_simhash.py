"""Fingerprints against their definition, links against all pairs, components against a search."""

import random

import pytest
import xxhash

from marketspark.llm import simhash
from marketspark.llm.components import components


def slow(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprint():
    rng = random.Random(1)
    texts = ["", "A", "a  B", "É x", "a b c"] + [" ".join(rng.choice("abcdeXYZ") for _ in range(rng.randint(1, 700))) for _ in range(40)]
    assert [simhash.fingerprint(t.encode()) for t in texts] == [slow(t) for t in texts]


@pytest.mark.parametrize(("distance", "segments"), [(2, 2), (1, 2), (3, 4), (3, 2)])
def test_links_are_all_pairs(spark, distance, segments):
    rng = random.Random(distance)
    values = set()
    for _ in range(25):
        x = rng.getrandbits(64)
        values |= {x} | {x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(6)}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if bin((a ^ b) & (1 << 64) - 1).count("1") <= distance}
    got = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), distance, segments)
    assert {(r.a, r.b) for r in got.collect()} == want


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(200, k) for k in range(201, 260)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in got} and all(find(a) == a or a in got for a, _ in edges)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups(spark):
    base = " ".join(f"w{i}" for i in range(400))
    docs = [(5, base), (3, base), (9, base + " end"), (7, "quite another text altogether with words"), (8, None), (2, "")]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {5: 3, 3: 3, 9: 3, 7: 7, 8: 2, 2: 2}
