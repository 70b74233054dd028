"""Scaling, embedding, clustering and prediction against direct computations."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketspark.operators import density as D
from marketspark.operators import patterns as M
from marketspark.operators.features import FEATURES
from marketspark.plans.training import train


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id bigint, v array<double>")


def wide(spark, x):
    names = [f"c{i}" for i in range(x.shape[1])]
    return spark.createDataFrame(pd.DataFrame(x, columns=names)), names


def blobs(n=30, noise=6, seed=0):
    rng = np.random.default_rng(seed)
    return np.vstack([rng.normal(0, 0.3, (n, 2)), rng.normal(6, 0.3, (n + 5, 2)), rng.uniform(-20, 25, (noise, 2))])


def test_scaling(spark):
    x = np.random.default_rng(0).normal(5, 3, (40, 3))
    x[:, 1] = 7
    df, names = wide(spark, x)
    got = M.scale(df, names).toPandas().to_numpy()
    sd = x.std(axis=0)
    want = (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1)
    np.testing.assert_allclose(got, want, atol=1e-12)


def test_embedding_equals_svd_and_survives_saving(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(60, 5)) @ np.random.default_rng(2).normal(size=(5, 5))
    df, names = wide(spark, x)
    model = M.fit_embedder(df, 3, names)
    model.save(spark, str(tmp_path / "m"))
    again = M.Embedder.load(spark, str(tmp_path / "m"))
    assert again == model
    got = np.array([r.embedding for r in again.embed(df).collect()])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    _, _, vt = np.linalg.svd(z, full_matrices=False)
    np.testing.assert_allclose(np.abs(got), np.abs(z @ vt[:3].T), atol=1e-9)
    assert all(max(row, key=abs) > 0 for row in model.components)
    hole = df.limit(1).withColumn(names[0], F.lit(None).cast("double"))
    assert model.embed(hole).first().embedding is None
    with pytest.raises(ValueError):
        M.fit_embedder(df.limit(1), 2, names)


def test_nearest_centroid(spark):
    df = frame(spark, np.array([[0, 0], [5, 5], [1, 0]])).unionByName(
        spark.createDataFrame([(9, None)], "id bigint, v array<double>")
    )
    got = {r.id: (r.cluster_id, r.distance) for r in M.nearest_centroid(df, [[0, 0], [5, 4], [2, 0]], "v").collect()}
    assert got[0] == (0, 0.0) and got[1] == (1, 1.0) and got[2][0] == 0  # a tie goes to the lower index
    assert got[9] == (-1, None)
    assert {r.cluster_id for r in M.nearest_centroid(df, None, "v").collect()} == {-1}


@pytest.mark.parametrize("k,dim,scale", [(1, 3, 1.0), (40, 8, 1.0), (300, 64, 1e6), (60, 2, 1e-3)])
def test_nearest_is_that_of_measuring_all(k, dim, scale):
    rng = np.random.default_rng(k)
    table = np.round(rng.normal(0, 2, (k, dim)), 1) * scale
    table[k // 2] = table[0]  # equal centroids
    x = np.round(rng.normal(0, 2, (700, dim)), 1) * scale
    x[:k:3] = table[: len(x[:k:3])]  # on a centroid
    x[7], x[8, 0], x[9, 0] = np.nan, np.inf, np.nan
    with np.errstate(all="ignore"):
        every = np.sqrt(((x[:, None, :] - table[None, :, :]) ** 2).sum(axis=2))
    every = np.where(np.isnan(every), np.inf, every)
    chosen, best = M._nearest(x, table)
    np.testing.assert_array_equal(best, every.min(axis=1))
    np.testing.assert_array_equal(chosen, every.argmin(axis=1))


def test_centroids(spark, tmp_path):
    x = blobs()
    labels = [0] * 30 + [1] * 35 + [-1] * 6
    df = spark.createDataFrame([(row.tolist(), n) for row, n in zip(x, labels)], "embedding array<double>, label int")
    centres = sorted(M.fit_centroids(df.filter("label >= 0"), k=2, starts=3))
    np.testing.assert_allclose(centres, [x[:30].mean(axis=0), x[30:65].mean(axis=0)], atol=1e-9)
    M.save_centroids(spark, centres, str(tmp_path / "c"))
    assert M.load_centroids(spark, str(tmp_path / "c")) == centres
    assert M.fit_centroids(df, k=1) is None
    with pytest.raises(ValueError):
        M.fit_centroids(df, k=M.MAX_CLUSTERS + 1)
    assert M.fit_centroids(df.limit(9)) is None
    M.save_centroids(spark, None, str(tmp_path / "none"))
    assert M.load_centroids(spark, str(tmp_path / "none")) is None


def test_census(spark):
    df = spark.createDataFrame([(0,), (0,), (1,), (-1,)], "label int")
    got = sorted(tuple(r) for r in M.census(df).collect())
    assert got == [(-1, 1, 2, 1), (0, 2, 2, 1), (1, 1, 2, 1)]
    assert sorted(r.label for r in M.cluster_labels(df).collect()) == [0, 1]


# ---- neighbour distances --------------------------------------------------------------------


def reachability(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, k - 1]
    return np.maximum(d, np.maximum(core[:, None], core[None])), core


@pytest.mark.parametrize("block", [2000, 25])
def test_core_distance_and_spanning_tree(spark, block):
    x = blobs()
    got = {r.id: r.core for r in D.core_distances(frame(spark, x), 4, block).collect()}
    np.testing.assert_allclose([got[i] for i in range(len(x))], reachability(x, 4)[1], atol=1e-12)


@pytest.mark.parametrize(("scale", "shift"), [(1, 0), (1e-3, 50), (1e30, 0), (1e-20, 0)])
def test_few_distances_are_computed(monkeypatch, scale, shift):
    rng = np.random.default_rng(3)
    x, y = (rng.normal(size=(n, 9)) * scale + shift for n in (400, 311))
    x[5:60], y[3] = x[4], x[9]
    counts, computed = [], D._distances

    def counting(a, b):
        counts.append(len(a))
        return computed(a, b)

    monkeypatch.setattr(D, "_distances", counting)
    for step in (1000, 60, 7):
        for got, a, b in zip([*D.nearest_distances(x, y, 4, step), *D.nearest_distances(x, None, 4, step)], (x, y, x), (y, x, x), strict=True):
            np.testing.assert_array_equal(got, np.sort(np.sqrt(((a[:, None] - b) ** 2).sum(axis=2)), axis=1)[:, :4])
    if scale in (1, 1e-3):  # of the others single precision holds no squares
        assert sum(counts) < 3 * (400 * 311 + 400 * 400) / 5


def test_points_are_copied_once_per_tile(spark, monkeypatch):
    x = blobs()
    cells = D._cells(frame(spark, x).repartition(3), 2)
    assert cells.groupBy("_a", "_b").count().count() == 36  # pairs of eight tiles, not of all blocks
    assert cells.selectExpr("sum(size(ids))").first()[0] == 8 * len(x)
    monkeypatch.setattr(D, "TILE", 10)  # five points
    assert D._cells(frame(spark, x), 2).selectExpr("max(_b)").first()[0] == -(-len(x) // 5) - 1


@pytest.mark.parametrize("block", [2000, 3])
def test_core_distance_of_odd_rows(spark, block):
    """Rows without a vector, of one id or of none, with unknown, infinite and huge coordinates; too few points."""
    nan, inf = math.nan, math.inf
    rows = [(1, [0.0, 0.0]), (2, [0.0, 1.0]), (3, [3.0, 0.0]), (3, [3.0, 4.0]), (None, [9.0, 0.0]), (None, [9.0, 9.0]), (4, None), (5, [nan, 0.0]), (6, [inf, 0.0]), (7, [1e200, 0.0]), (8, [0.0, 1.0])]
    want = {}
    for i in {i for i, _ in rows}:
        with np.errstate(all="ignore"):
            found = np.sort([np.sqrt(((np.array(a) - np.array(b)) ** 2).sum()) for j, a in rows for _, b in rows if j == i and a and b])
        want[i] = found[2] if len(found) else None
    schema = "id long, v array<double>"
    got = {r.id: r.core for r in D.core_distances(spark.createDataFrame(rows, schema), 3, block).collect()}
    assert got.keys() == want.keys()
    for i, core in want.items():
        assert got[i] is core is None or np.array_equal(got[i], core, equal_nan=True), i
    assert [tuple(r) for r in D.core_distances(spark.createDataFrame(rows[:1], schema), 3, block).collect()] == [(1, None)]
    assert D.core_distances(spark.createDataFrame([], schema), 3, block).count() == 0


def test_training_and_detection(spark):
    rng = np.random.default_rng(7)
    n = 260
    calm, wild = rng.normal(0, 0.001, n // 2), rng.normal(0, 0.05, n // 2)
    close = 100 * np.exp(np.concatenate([calm, wild]).cumsum())
    bars = pd.DataFrame({"symbol": "BTC/USDT", "exchange": "binance", "open_time": np.arange(n) * 60_000, "open": close, "close": close, "high": close * 1.001, "low": close * 0.999, "volume": rng.integers(1, 9, n).astype(float)})
    df = spark.createDataFrame(bars)
    model = train(df, "BTCUSDT", dim=4, k=3, starts=2)
    assert len(model.centroids) == 3 and train(df, dim=4, k=3, starts=1).labelled.count() == n - 30
    assert model.labelled.count() == n - 30
    out = M.detect(df, model.embedder, model.centroids).first()
    assert len(out.feature_vector) == len(FEATURES) and len(out.embedding) == 4
    few = M.detect(df.limit(9), model.embedder, model.centroids).first()
    assert (few.cluster_id, few.feature_vector, few.embedding) == (-1, None, None)
    bare = M.detect(df, None, None).first()
    assert bare.cluster_id == -1 and bare.embedding is None and len(bare.feature_vector) == len(FEATURES)
    with pytest.raises(ValueError):
        train(df, "NONE")
