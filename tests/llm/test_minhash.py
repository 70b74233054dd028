"""Near copies against the likeness of all pairs, and the pipeline's stage on edited copies."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from marketspark.llm import minhash


def shingles(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def like(a, b):
    return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))


def edited(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(rng):
    texts = []
    for _ in range(25):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 400))]
        texts.append(" ".join(base))
        texts += [edited(rng, base, max(1, len(base) * share // 100)) for share in (1, 2, 4, 8)]
    base = [f"v{i}" for i in range(300)]
    return texts + [edited(rng, base, 3) for _ in range(60)]


def test_bands_meet_like_sets():
    rng = random.Random(2)
    pairs = []
    while len(pairs) < 200:
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        a, b = " ".join(base), edited(rng, base, rng.randint(3, 4))
        pairs += [(a, b)] if like(a, b) >= 0.8 else []
    keys = [minhash.bands(pa.array(side))[1] for side in zip(*pairs, strict=True)]
    assert (keys[0] == keys[1]).any(axis=1).mean() >= 0.98


def test_stage_leaves_no_near_copies(spark):
    texts = corpus(random.Random(3))
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[1]), (0, texts[0])], "doc_id long, text string")
    kept = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert kept.count(None) == 1 and kept.count(0) == 2
    ids = sorted({i for i in kept if i is not None})
    assert not [(a, b) for a in ids for b in ids if a < b and like(texts[a], texts[b]) >= 0.8]
    for gone in set(range(len(texts))) - set(ids):
        assert any(like(texts[gone], texts[k]) >= 0.8 for k in range(gone))


def test_crowded_bucket_of_unlike_texts(spark):
    rng = random.Random(8)
    heading = [f"head{i}" for i in range(60)]
    texts = [" ".join(heading + [f"own{k}x{i}" for i in range(rng.randint(18, 26))]) for k in range(1500)]
    texts += [f"{t} more" for t in texts[::300]]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert minhash._alike(docs, 0.8, 5).count() == 5  # of 1.1 million pairs
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    few = [k for k in range(len(texts)) if k % 5 == 0][:120]
    some = {(b, a) for a in few for b in few if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.56}
    got = {(r.id, r.lead) for r in minhash._alike(docs.filter(F.col("id").isin(few)), 0.56, 5).collect()}
    assert some and some <= got
