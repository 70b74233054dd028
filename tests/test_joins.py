"""The guarded join gives the same rows on both of its ways, also with a hot key."""

import pytest

from marketspark.operators.joins import join_small


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("max_bytes", [0, 1000])
def test_both_ways(spark, how, max_bytes):
    big = spark.createDataFrame([("hot", i) for i in range(500)] + [("a", 1), ("none", 2), (None, 3)], "k string, x int")
    small = spark.createDataFrame([("hot", 1.0), ("a", 2.0), ("b", 3.0)], "k string, y double")
    out = join_small(big, small, ["k"], how, max_bytes)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert ("strategy=broadcast" in plan) == (max_bytes == 1000)
    rows = out.collect()
    assert len(rows) == (501 if how == "inner" else 503)
    assert {r.k: r.y for r in rows}.get("none", "absent") == ("absent" if how == "inner" else None)
