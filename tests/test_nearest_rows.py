"""Nearest minority rows by blocks: exact, and far blocks are not compared."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from buildlens.operators import balance as B


def clustered(spark, n, dims, centres):
    rng = np.random.default_rng(5)
    middle = rng.uniform(0, 1000, (centres, dims))
    points = np.round(middle[rng.integers(0, centres, n)] + rng.normal(0, 1, (n, dims)), 1)
    points[: n // 10] = points[0]  # equal rows, equal distances
    data = [("k", i, p.tolist(), 1) for i, p in enumerate(points)] + [("k", n + i, [0.0] * dims, 0) for i in range(n + 1)]
    return points, spark.createDataFrame(data, "k string, i long, v array<double>, y int").withColumnRenamed("y", B.LABEL)


@pytest.mark.parametrize("dims", [3, 9])
def test_equals_all_pairs_and_skips_far_blocks(spark, monkeypatch, dims):
    points, df = clustered(spark, 800, dims, 20)
    seen = []

    def counted(*args):
        seen.append(visits(*args).persist())
        return seen[-1]

    visits = B.block_visits
    monkeypatch.setattr(B, "block_visits", counted)
    got = {r["id"]: [n["neighbour"] for n in r["neighbours"]] for r in B.minority_knn(
        df, ["k"], "v", "i", block=20).collect()}
    assert len(got) == len(points)
    for i, p in enumerate(points):
        d = np.zeros(len(points))
        for j in range(dims):
            d += (points[:, j] - p[j]) ** 2
        d[i] = np.inf
        assert got[i] == np.argsort(np.sqrt(d), kind="stable")[:5].tolist()
    # 40 blocks: 1,560 ordered pairs of different ones
    assert seen[0].count() < 1560 / 3
    assert seen[0].filter(F.col("_a") == F.col("_b")).isEmpty()


def test_rows_that_are_not_numbers_have_no_neighbours(spark):
    data = [("k", i, [float(i), float("nan") if i == 3 else 1.0], 1) for i in range(12)]
    data += [("k", 100 + i, [0.0, 0.0], 0) for i in range(20)]
    df = spark.createDataFrame(data, f"k string, i long, v array<double>, {B.LABEL} int")
    got = {r["id"]: [n["neighbour"] for n in r["neighbours"]] for r in B.minority_knn(
        df, ["k"], "v", "i", block=4, k=2).collect()}
    assert 3 not in got and got[0] == [1, 2] and got[4] == [5, 2] and got[11] == [10, 9]
