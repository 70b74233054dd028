"""Connected components by alternating stars; every step is a shuffle of edges, none gathers a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.session import settle


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges`` (a, b: long) to (node, root), root being the smallest node reachable.

    Large-star then small-star: each node hands its smallest neighbour on until every component is a
    star around its smallest node, in a number of rounds that grows with the logarithm of its diameter.
    Null ends and self-loops are left out; nodes without edges have no row. A hub's edges are rows like
    any others: its minimum is a partial aggregate, and the join that hands it on can be split.
    """
    links = settle(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(links)
    for _ in range(rounds):
        links = settle(_small_star(_large_star(links)))
        before, state = state, _state(links)
        if state == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    handed = links.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return handed.unionAll(least.select("u", F.col("m").alias("v"))).distinct()
