"""Price regimes: scaling, embedding, clustering and prediction.

Fitted models are small fixed-size objects (per-feature numbers, component rows, centroids):
they are computed by distributed aggregates and then travel inside the plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketspark.operators.features import FEATURES, MIN_ROWS, newest_features
from marketspark.session import settle, ship_code

NOISE = -1


@dataclass(frozen=True)
class Embedder:
    """Standardisation followed by a projection on principal components."""

    columns: list[str]
    means: list[float]
    deviations: list[float]
    components: list[list[float]]
    variance: list[float]

    def scaled(self) -> list[Column]:
        return [standard(F.col(c), m, s) for c, m, s in zip(self.columns, self.means, self.deviations)]

    def embed(self, df: DataFrame, out: str = "embedding") -> DataFrame:
        """Append the embedding; null where a feature is missing."""
        z = self.scaled()
        coordinates = []
        for row in self.components:
            total = F.lit(0.0)
            for loading, value in zip(row, z):
                total = total + F.lit(loading) * value
            coordinates.append(total)
        known = ~F.greatest(*[F.col(c).isNull().cast("int") for c in self.columns]).cast("boolean")
        return df.withColumn(out, F.when(known, F.array(*coordinates)))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [("mean", -1, self.means), ("deviation", -1, self.deviations), ("variance", -1, self.variance)]
        rows += [("component", i, row) for i, row in enumerate(self.components)]
        frame = spark.createDataFrame(
            [(kind, i, [float(v) for v in values], self.columns) for kind, i, values in rows],
            "kind string, i int, values array<double>, columns array<string>",
        )
        frame.coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Embedder:
        rows = spark.read.parquet(path).orderBy("kind", "i").collect()  # one row per component, plus three
        pick = {kind: [list(r["values"]) for r in rows if r["kind"] == kind] for kind in ("mean", "deviation", "variance", "component")}
        return Embedder(list(rows[0]["columns"]), pick["mean"][0], pick["deviation"][0], pick["component"], pick["variance"][0])


def standard(value: Column, mean: float, deviation: float) -> Column:
    return (value - F.lit(mean)) / F.lit(deviation) if deviation > 0 else value * 0.0


def fit_scaler(df: DataFrame, columns: Sequence[str] = FEATURES) -> tuple[list[float], list[float]]:
    """Mean and population deviation per column, in one pass."""
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    k = len(columns)
    if row[0] is None:
        raise ValueError("no rows to fit")
    return [float(v) for v in row[:k]], [float(v) for v in row[k:]]


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without a null or NaN in the columns; the input is computed once and stored.

    Stored before the test because over a plan full of computed columns the optimizer would
    restate a condition on many columns once for every combination of them.
    """
    return settle(df).dropna(subset=list(columns))


def scale(df: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """Columns replaced by their standard scores; a constant column becomes 0."""
    means, deviations = fit_scaler(df, columns)
    return df.withColumns({c: standard(F.col(c), m, s) for c, m, s in zip(columns, means, deviations)})


def fit_embedder(df: DataFrame, dim: int = 16, columns: Sequence[str] = FEATURES) -> Embedder:
    """Standardise, then principal components with the largest loading of each made positive."""
    columns = list(columns)
    known = complete(df.select(*columns), columns)
    means, deviations = fit_scaler(known, columns)
    z = known.select(*[standard(F.col(c), m, s).alias(c) for c, m, s in zip(columns, means, deviations)])
    if z.limit(2).count() < 2:
        raise ValueError("need at least 2 rows to fit")
    vectors = VectorAssembler(inputCols=columns, outputCol="x").transform(z)
    model = PCA(k=dim, inputCol="x", outputCol="y").fit(vectors)
    loadings = model.pc.toArray().T
    signs = np.sign(loadings[np.arange(len(loadings)), np.abs(loadings).argmax(axis=1)])
    components = loadings * np.where(signs == 0, 1, signs)[:, None]
    return Embedder(columns, means, deviations, components.tolist(), model.explainedVariance.toArray().tolist())


# ---- centroids -----------------------------------------------------------------------------


#: Most clusters of a model: what is kept on the driver and sent to tasks is bounded by it.
MAX_CLUSTERS = 1000
#: Starts that run side by side, so that the tasks of one fill the waits of another.
STARTS_AT_ONCE = 4


def fit_centroids(rows: DataFrame, vector: str = "embedding", k: int = 5, starts: int = 10, seed: int = 42) -> list[list[float]] | None:
    """K-means centroids of all rows, best of several starts, run until nothing moves.

    ``k`` clusters, but at least five rows for each; None (no centroids) with fewer than 10 rows or 2 clusters.
    """
    if k > MAX_CLUSTERS:
        raise ValueError(f"more than {MAX_CLUSTERS} clusters")
    valid = settle(rows.filter(F.col(vector).isNotNull()).select(vector))
    n = valid.count()
    k = min(k, n // 5)
    if n < 10 or k < 2:
        return None
    points = valid.select(array_to_vector(vector).alias("x")).cache()
    try:
        points.count()  # cached before several starts read it at once

        def fit(i: int) -> KMeansModel:
            return KMeans(k=k, featuresCol="x", seed=seed + i, maxIter=200, tol=0.0).fit(points)

        with ThreadPoolExecutor(min(starts, STARTS_AT_ONCE)) as pool:
            models = list(pool.map(inheritable_thread_target(fit), range(starts)))
        best = min(models, key=lambda m: m.summary.trainingCost)
        return [c.tolist() for c in best.clusterCenters()]
    finally:
        points.unpersist()


BLOCK = 4096


def _nearest(x: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and distance to each row's nearest centroid, the lowest index on ties; cluster 0 without a distance.

    One matrix product gives all distances up to rounding; those that rounding could make the least are measured
    exactly, so the result is that of measuring all.
    """
    lengths, sizes = (x * x).sum(axis=1), (table * table).sum(axis=1)
    with np.errstate(all="ignore"):
        rough = lengths[:, None] + sizes[None, :] - 2 * (x @ table.T)
        slack = 1e-12 * x.shape[1] * (lengths + sizes.max())
        close = ~(rough > rough.min(axis=1, keepdims=True) + slack[:, None])  # all, where a value is no number
    row, index = np.nonzero(close)
    pieces = [slice(i, i + 16 * BLOCK) for i in range(0, len(row), 16 * BLOCK)]
    exact = np.concatenate([np.sqrt(((x[row[p]] - table[index[p]]) ** 2).sum(axis=1)) for p in pieces])
    exact = np.where(np.isnan(exact), np.inf, exact)
    order = np.lexsort((index, exact, row))
    first = order[np.unique(row[order], return_index=True)[1]]
    chosen, best = index[first].astype("int32"), exact[first]
    return np.where(np.isinf(best), 0, chosen).astype("int32"), best


def nearest_centroid(df: DataFrame, centroids: Sequence[Sequence[float]] | None, vector: str = "embedding") -> DataFrame:
    """Append ``cluster_id`` (lowest index on ties, -1 without centroids or vector) and ``distance``."""
    if not centroids:
        return df.withColumns({"cluster_id": F.lit(NOISE), "distance": F.lit(None).cast("double")})
    ship_code(df.sparkSession)
    table = np.asarray(centroids, dtype=float)

    def assign(vectors: pd.Series) -> pd.DataFrame:
        known = vectors.notna().to_numpy()
        cluster = np.full(len(vectors), NOISE, dtype="int32")
        distance = np.full(len(vectors), np.nan)
        if known.any():
            x = np.stack(vectors[known].to_numpy()).astype(float)
            parts = [_nearest(x[i : i + BLOCK], table) for i in range(0, len(x), BLOCK)]
            chosen, best = (np.concatenate(p) for p in zip(*parts))
            cluster[known], distance[known] = chosen, best
        return pd.DataFrame({"cluster_id": cluster, "distance": pd.Series(distance).where(known, None)})

    udf = F.pandas_udf(assign, "cluster_id int, distance double")
    return df.withColumn("_near", udf(vector)).withColumns(
        {"cluster_id": F.col("_near.cluster_id"), "distance": F.col("_near.distance")}
    ).drop("_near")


def save_centroids(spark: SparkSession, centroids: Sequence[Sequence[float]] | None, path: str) -> None:
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centroids or [])]
    spark.createDataFrame(rows, "cluster_id int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load_centroids(spark: SparkSession, path: str) -> list[list[float]] | None:
    rows = spark.read.parquet(path).orderBy("cluster_id").collect()  # one row per cluster of the model
    return [list(r["centroid"]) for r in rows] or None


def census(labelled: DataFrame, label: str = "label") -> DataFrame:
    """Rows per label, with the number of clusters and of outliers beside each."""
    sizes = labelled.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("size"))
    every = Window.partitionBy(F.lit(0))  # one row per cluster here
    return sizes.withColumns(
        {
            "clusters": F.count_if(F.col("label") >= 0).over(every),
            "outliers": F.coalesce(F.sum(F.when(F.col("label") < 0, F.col("size"))).over(every), F.lit(0)),
        }
    )


def cluster_labels(labelled: DataFrame, label: str = "label") -> DataFrame:
    """Distinct labels without noise."""
    return labelled.select(F.col(label).alias("label")).filter(F.col(label) >= 0).distinct()


def detect(
    bars: DataFrame,
    embedder: Embedder | None,
    centroids: Sequence[Sequence[float]] | None,
    keys: Sequence[str] = ("exchange", "symbol"),
    n: int = 60,
) -> DataFrame:
    """Regime of each key's newest bars: features, embedding, cluster id and distance to its centroid.

    Too few bars or no model give cluster -1; features are kept where they exist.
    """
    features = newest_features(bars, keys, n)
    out = features.withColumn(
        "feature_vector", F.when(F.col("bars") >= MIN_ROWS, F.array(*FEATURES))
    )
    if embedder is None:
        out = out.withColumn("embedding", F.lit(None).cast("array<double>"))
        return nearest_centroid(out, None).drop(*FEATURES)
    return nearest_centroid(embedder.embed(out), centroids).drop(*FEATURES)
