"""Model queries: scaling, embedding, clusters, prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketspark.catalog.base import query, rounded
from marketspark.catalog.indicators import _W9_SQL, MINUTES, minute_bars
from marketspark.operators import density as D
from marketspark.operators import patterns as M
from marketspark.operators.features import FEATURES, MIN_ROWS, rolling_features
from marketspark.plans.training import train
from marketspark.session import new_path
from marketspark.views import points, stored_candles, with_views

POINTS = with_views("points")
DIMS = 64


def _wide(spark, sf_dir):
    return points(spark, sf_dir).select("id", *[F.col("v").getItem(i).alias(f"x{i}") for i in range(DIMS)])


@query(
    "m1_standardise",
    POINTS + ", s AS (SELECT " + ", ".join(f"avg(v[{i + 1}]) AS m{i}, stddev_pop(v[{i + 1}]) AS s{i}" for i in range(DIMS)) + " FROM points) SELECT id, "
    + ", ".join(f"round((v[{i + 1}] - m{i}) / s{i}, 6) AS x{i}" for i in range(DIMS)) + " FROM points, s",
)
def _(spark, sf_dir):
    names = [f"x{i}" for i in range(DIMS)]
    return rounded(M.scale(_wide(spark, sf_dir), names), *names)


@query("m2_components", f"SELECT CAST(a AS INTEGER) AS i, CAST(b AS INTEGER) AS j, CASE WHEN a = b THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS product FROM range({DIMS}) x(a), range({DIMS}) y(b)")
def _(spark, sf_dir):
    """All components: each has length one and stands at right angles to the others."""
    model = M.fit_embedder(_wide(spark, sf_dir), DIMS, [f"x{i}" for i in range(DIMS)])
    path = new_path(spark, "components")
    model.save(spark, path)
    rows = spark.read.parquet(path).filter(F.col("kind") == "component")
    left = rows.select("i", F.posexplode("values").alias("feature", "a"))
    right = rows.select(F.col("i").alias("j"), F.posexplode("values").alias("feature", "b"))
    product = F.round(F.sum(F.col("a") * F.col("b")), 6) + 0.0
    return left.join(right, "feature").groupBy("i", "j").agg(product.alias("product"))


@query(
    "m4a_core_distance",
    POINTS + """, d AS (SELECT a.id, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v)) AS rn FROM points a, points b)
  SELECT id, round(d, 6) AS core FROM d WHERE rn = 5""",
)
def _(spark, sf_dir):
    return rounded(D.core_distances(points(spark, sf_dir), 5, 500), "core")


CLUSTERS = 10


def _fixpoint(spark, sf_dir):
    """Points with their cluster after k-means on all embeddings, the centroids as a table and as a list."""
    rows = points(spark, sf_dir)
    centroids = M.fit_centroids(rows, "v", k=CLUSTERS, starts=2)
    path = new_path(spark, "centroids")
    M.save_centroids(spark, centroids, path)
    return M.nearest_centroid(rows, M.load_centroids(spark, path), "v"), spark.read.parquet(path), centroids


def _squares(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda done, x: done + x)


@query("m4_clusters", POINTS + " SELECT id, true AS own_is_nearest FROM points")
def _(spark, sf_dir):
    """Every point is no nearer to any other centre than to its own."""
    labelled, _, centroids = _fixpoint(spark, sf_dir)
    others = F.array(*[F.array(*[F.lit(x) for x in c]) for c in centroids])
    least = F.array_min(F.transform(others, lambda c: F.sqrt(_squares(F.col("v"), c))))
    return labelled.select("id", (F.abs(least - F.col("distance")) < 1e-6).alias("own_is_nearest"))


@query("f11_without_noise", POINTS + " SELECT id, label - 1 AS label FROM points WHERE label - 1 >= 0")
def _(spark, sf_dir):
    rows = points(spark, sf_dir).select("id", (F.col("label") - 1).alias("label"))
    return rows.filter(F.col("label") >= 0)


@query(
    "a16_census",
    POINTS + """, s AS (SELECT label - 1 AS label, count(*) AS size FROM points GROUP BY 1)
  SELECT label, size, (SELECT count(*) FROM s WHERE label >= 0) AS clusters, (SELECT CAST(sum(size) AS BIGINT) FROM s WHERE label < 0) AS outliers FROM s""",
)
def _(spark, sf_dir):
    return M.census(points(spark, sf_dir).withColumn("label", F.col("label") - 1))


@query("u3_label_set", POINTS + " SELECT DISTINCT label - 1 AS label FROM points WHERE label > 0")
def _(spark, sf_dir):
    return M.cluster_labels(points(spark, sf_dir).withColumn("label", F.col("label") - 1))


def _label_means(spark, sf_dir):
    """Mean vector per label, in label order: ten centroids of the given labels."""
    mean = F.array(*[F.avg(F.col("v").getItem(i)) for i in range(DIMS)])
    rows = points(spark, sf_dir).groupBy("label").agg(mean.alias("c")).orderBy("label").collect()
    return [list(r["c"]) for r in rows]


_NEAREST = POINTS + ", c AS (SELECT label, [" + ", ".join(f"avg(v[{i + 1}])" for i in range(DIMS)) + """] AS c FROM points GROUP BY label),
  k AS (SELECT CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS cluster_id, c FROM c),
  p AS (SELECT id, arg_min(cluster_id, (list_distance(v, c), cluster_id)) AS cluster_id, min(list_distance(v, c)) AS distance FROM points, k GROUP BY id)"""


@query("j8_nearest_centroid", _NEAREST + " SELECT id, cluster_id, round(distance, 6) AS distance FROM p")
def _(spark, sf_dir):
    out = M.nearest_centroid(points(spark, sf_dir), _label_means(spark, sf_dir), "v")
    return rounded(out.select("id", "cluster_id", "distance"), "distance")


@query("m6_predict", _NEAREST + " SELECT id, cluster_id FROM p")
def _(spark, sf_dir):
    path = new_path(spark, "centroids")
    M.save_centroids(spark, _label_means(spark, sf_dir), path)
    return M.nearest_centroid(points(spark, sf_dir), M.load_centroids(spark, path), "v").select("id", "cluster_id")


@query("m5_centroids", f"SELECT CAST(c AS INTEGER) AS cluster_id, true AS is_mean FROM range({CLUSTERS}) t(c)")
def _(spark, sf_dir):
    """One row per cluster; its centre is the mean of its points."""
    labelled, centres, _ = _fixpoint(spark, sf_dir)
    mean = F.array(*[F.avg(F.col("v").getItem(i)) for i in range(DIMS)])
    means = labelled.groupBy("cluster_id").agg(mean.alias("m"))
    return centres.join(means, "cluster_id").select("cluster_id", (_squares(F.col("m"), F.col("centroid")) < 1e-9).alias("is_mean"))


_FINITE = " AND ".join(f"isfinite({c})" for c in FEATURES)
_COMPLETE = _W9_SQL[: _W9_SQL.rindex(") SELECT symbol, open_time")] + f"), z AS (SELECT * FROM f WHERE {_FINITE})"


@query("m8_training", _COMPLETE + " SELECT 5::BIGINT AS clusters, count(*) AS rows FROM z")
def _(spark, sf_dir):
    """Every bar with a full window is labelled, over all symbols."""
    labelled = train(stored_candles(spark, sf_dir), k=5, starts=2).labelled
    return labelled.filter("label >= 0").agg(F.count_distinct("label").alias("clusters"), F.count("*").alias("rows"))


@query("m7_detect", MINUTES + f" SELECT exchange, symbol, count(*) AS bars, count(*) >= {MIN_ROWS} AS detected FROM newest GROUP BY 1, 2")
def _(spark, sf_dir):
    """The regime of each instrument's newest bars, where there are enough of them."""
    model = train(stored_candles(spark, sf_dir), k=5, starts=2)
    out = M.detect(minute_bars(spark, sf_dir), model.embedder, model.centroids)
    found = (F.col("cluster_id") >= 0) & (F.col("distance") >= 0)
    return out.select("exchange", "symbol", F.col("bars").cast("bigint").alias("bars"), F.coalesce(found, F.lit(False)).alias("detected"))


_LENGTHS = _COMPLETE + ", s AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in FEATURES) + " FROM z) SELECT symbol, open_time, round(" + " + ".join(
    f"CASE WHEN s_{c} > 0 THEN (({c} - m_{c}) / s_{c}) ** 2 ELSE 0 END" for c in FEATURES
) + ", 4) AS squared_length FROM z, s"


def _lengths(out):
    square = F.aggregate("embedding", F.lit(0.0), lambda done, x: done + x * x)
    return out.select("symbol", "open_time", F.round(square, 4).alias("squared_length"))


@query("m3_embedding", _LENGTHS)
def _(spark, sf_dir):
    """With all components an embedding is as long as the scaled features."""
    rows = M.complete(rolling_features(stored_candles(spark, sf_dir)), FEATURES)
    return _lengths(M.fit_embedder(rows, len(FEATURES)).embed(rows))


@query("s15_model_store", _LENGTHS)
def _(spark, sf_dir):
    rows = M.complete(rolling_features(stored_candles(spark, sf_dir)), FEATURES)
    path = new_path(spark, "embedder")
    M.fit_embedder(rows, len(FEATURES)).save(spark, path)
    return _lengths(M.Embedder.load(spark, path).embed(rows))
