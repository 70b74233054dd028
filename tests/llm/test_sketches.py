"""Edited texts exactly, likeness within the sketch's error, merged sketches equal to whole ones."""

import hashlib
import random

import numpy as np
import pyarrow as pa

from marketspark.llm import sketches


def texts(seed, n):
    rng = random.Random(seed)
    return [" ".join(rng.choice(["à", "bb", "c", "dé"]) + str(rng.randrange(30)) for _ in range(rng.randint(0, 300))) for _ in range(n)]


def shingles(text, width=5):
    words = text.encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def test_successors_and_edits(spark):
    made = texts(1, 90)
    docs = [(7 * i, t) for i, t in enumerate(made)]
    random.Random(2).shuffle(docs)
    got = {r.doc_id: r for r in sketches.with_next(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), k=256).collect()}
    assert len(got) == len(made)
    for i, text in enumerate(made):
        after = made[(i + 1) % len(made)]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        r = got[7 * i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b = shingles(text), shingles(edited)
        assert abs(r.near_edited - (len(a & b) / len(a | b) if a | b else 1.0)) < 0.12
        assert (r.fingerprint == r.edited_fingerprint) == (a == b)


def test_estimates():
    rng = random.Random(3)
    base = [f"w{i}" for i in range(5000)]
    part = base[:2500]
    rng.shuffle(part)
    a, b = sketches.bottom(pa.array([" ".join(base), " ".join(base[:2504])]), 512, 5)
    assert abs(sketches.distinct(a, 512) - 4996) < 500
    assert abs(sketches.resemblance(a, b, 512) - 0.5) < 0.07
    assert sketches.containment(b, a, 512) > 0.9 and abs(sketches.containment(a, b, 512) - 0.5) < 0.12
    assert (sketches.decoded(sketches.encoded(a)) == a).all()


def test_merged_parts_equal_the_whole(spark):
    parts = spark.createDataFrame([(i, i % 3, t) for i, t in enumerate(texts(4, 40))], "doc_id long, g int, text string")
    merged = sketches.merge(sketches.sketch(parts, k=64).join(parts.select("doc_id", "g"), "doc_id"), "g", 64)
    for r in merged.collect():
        own = sketches.bottom(pa.array([t for i, t in enumerate(texts(4, 40)) if i % 3 == r.g]), 10**9, 5)
        assert r.sketch == np.unique(np.concatenate(own))[:64].astype(int).tolist()
