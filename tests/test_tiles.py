"""Neighbours over tiles against all pairs: small tiles, clusters, equal points, groups of very different sizes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import joins, kernels, tiles


def drawn(seed, n, dims):
    """A third of the points in one small cluster, a third on a coarse grid with many equal points, the rest spread."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)) * 10
    x[: n // 3] = rng.normal(size=(n // 3, dims)) / 1000
    x[n // 3 : 2 * n // 3] = rng.integers(0, 4, (n // 3, dims))
    return x


def frame(spark, groups, dims):
    rows = [(g, 1000 * k + i, *map(float, p)) for k, (g, x) in enumerate(groups.items()) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "g string, id long, " + ", ".join(f"x{i} double" for i in range(dims))).cache()


@pytest.mark.parametrize("dims", [1, 2, 3])
def test_distances_and_counts_are_those_of_all_pairs(spark, dims):
    groups = {"a": drawn(1, 400, dims), "b": drawn(2, 90, dims), "c": drawn(3, 3, dims)}
    points, columns = frame(spark, groups, dims), [f"x{i}" for i in range(dims)]
    near = {r["id"]: r["near"] for r in tiles.nearest_distances(points, ["g"], columns, 5, size=20).collect()}
    asked = points.withColumn("r", F.when(F.col("id") % 3 == 0, 0.5).when(F.col("id") % 3 == 1, 3.0).otherwise(F.lit(float("inf"))))
    n = {r["id"]: r["n"] for r in tiles.counts_within(points, asked, ["g"], columns, "r", size=20).collect()}
    slices = tiles.sliced(points, ["g"], columns, 20)
    assert len(slices.count) > 12 and slices.count.sum() == 493
    for k, x in enumerate(groups.values()):
        d = np.abs(x[:, None] - x[None]).max(2)
        for i in range(len(x)):
            assert near[1000 * k + i] == sorted(np.delete(d[i], i))[:5]
            assert n[1000 * k + i] == (d[i] < (0.5, 3.0, np.inf)[(1000 * k + i) % 3]).sum()
    points.unpersist()


def test_pooled_information_is_that_of_the_quadratic_kernel(spark):
    rng = np.random.default_rng(4)
    rows = [("ab"[k % 3 == 0], k, float(a), float(int(3 * b)), float(a + b)) for k, (a, b) in enumerate(rng.normal(size=(600, 2)))] + [("few", k, 1.0, 2.0, float(k)) for k in range(4)] + [("a", 9999, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, i long, a double, b double, y double")
    small, pooled = (sorted(map(tuple, f(df, ["g"], ["a", "b"], "y", F.col("i"), [3, 4], **more).collect())) for f, more in ((kernels.mutual_information, {}), (kernels.pooled_information, {"size": 25})))
    assert len(small) == len(pooled) == 6
    for x, y in zip(small, pooled):
        assert x[:3] == y[:3] and (x[3] is None) == (y[3] is None) and (x[3] is None or (x[3], x[4]) == pytest.approx((y[3], y[4]), abs=1e-9))
    assert dict((r[:2], r[3]) for r in pooled)["few", 3] is None and sum(r[2] for r in pooled if r[1] == 3) == 604


def test_nearest_at_any_distance(spark):
    rng = np.random.default_rng(7)
    t = [(k, k % 3, float(x), float(y)) for k, (x, y) in enumerate(np.concatenate([rng.uniform(0, 100, (150, 2)), rng.uniform(-1e6, 1e6, (30, 2)), [[5, 5]] * 3]))] + [(900, 0, None, 1.0)]
    s = [(k, k % 2, float(x), float(y)) for k, (x, y) in enumerate(np.concatenate([rng.integers(0, 20, (200, 2)) * 5, rng.normal(50, 1e-3, (100, 2))]))] + [(900, 0, 1.0, None)]
    targets, sources = spark.createDataFrame(t, "target_id long, g int, x double, y double"), spark.createDataFrame(s, "source_id long, g int, x double, y double")
    for by in (["g"], []):
        got = {r["target_id"]: (r["source"], r["distance"]) for r in joins.nearest_at_any_distance(targets, sources, by=by, size=10).collect()}
        assert len(got) == len(t)
        for k, g, x, y in t:
            c = [(((x - a) ** 2 + (y - b) ** 2) ** 0.5, m) for m, h, a, b in s if (h == g or not by) and b is not None] if x is not None else []
            assert got[k] == ((min(c)[1], pytest.approx(min(c)[0])) if c else (-1, None))
    assert {r["source"] for r in joins.nearest_at_any_distance(targets, sources.limit(0)).collect()} == {-1}


def test_points_at_one_place_are_one_point(spark, monkeypatch):
    met = []
    plain = tiles.nearest_point

    def counted(targets, sources, *rest):
        met.append((targets.count(), sources.count()))
        return plain(targets, sources, *rest)

    monkeypatch.setattr(tiles, "nearest_point", counted)
    t = spark.createDataFrame([(k, float(k % 3), 0.0) for k in range(90)], "target_id long, x double, y double")
    s = spark.createDataFrame([(k, float(k % 4) + 0.4, 0.0) for k in range(10, 90)], "source_id long, x double, y double")
    want = {k: ({0: 12, 1: 13, 2: 10}[k % 3], pytest.approx(0.4)) for k in range(90)}
    got = joins.nearest_at_any_distance(t, s).collect()
    assert {r.target_id: (r.source, r.distance) for r in got} == want and len(got) == 90 and met == [(3, 4)]
    got = joins.nearest(t, s, 1.0, 0.5).collect()
    assert {r.target_id: (r.source, r.distance) for r in got} == want and len(got) == 90
