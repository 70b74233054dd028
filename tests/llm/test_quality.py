"""EM against known labellers, the scorer against labels that it never saw."""

import numpy as np

from marketspark.llm import quality
from marketspark.llm.common import documents

SF = "/root/testdata/sf0.01"


def test_em_finds_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < 0.7
    right = [0.95, 0.9, 0.8, 0.75, 0.6, 0.85, 0.7, 0.65, 0.9]
    vote = np.stack([np.where(rng.random(len(good)) < 0.2, 0, np.where((rng.random(len(good)) < p) == good, 1, -1)) for p in right], axis=1).astype(np.int8)
    model = quality.fit_weak(vote, np.ones(len(vote)))
    assert abs(model.prior - 0.7) < 0.02
    assert np.abs(np.array(list(model.accuracy().values())) - right).max() < 0.03
    assert ((model.posterior(vote) >= 0.5) == good).mean() > 0.95


def test_patterns_stand_for_their_votes():
    vote = np.array([[1, -1, 0] * 3, [0] * 9, [-1] * 9], dtype=np.int8)
    keys = quality.pattern(vote)
    assert ((keys[:, None] // 3 ** np.arange(9) % 3 - 1) == vote).all()


def test_agrees_with_labels(spark):
    found = quality.classify(documents(spark, SF))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = found.join(labels, "doc_id").select("keep", "quality").collect()
    assert sum(r.keep == (r.quality == 1) for r in rows) / len(rows) > 0.93
    good = [r.keep for r in rows if r.quality == 1]
    assert sum(good) / len(good) > 0.96
