"""Boosted trees of a season against an exhaustive search, and the oracle's sums against plain folds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import oracles


def plain_tree(x, y, leaves, least):
    """Leaf-wise growth by trying every split of every leaf; (masks of the leaves)."""
    held = [np.ones(len(y), bool)]

    def best(m):
        found = (0.0, None)
        for j in range(x.shape[1]):
            for b in np.unique(x[m, j]):
                left, right = m & (x[:, j] <= b), m & (x[:, j] > b)
                if min(left.sum(), right.sum()) >= least:
                    sse = sum(((y[s] - y[s].mean()) ** 2).sum() for s in (left, right))
                    gain = ((y[m] - y[m].mean()) ** 2).sum() - sse
                    if gain > found[0] + 1e-9:
                        found = (gain, (left, right))
        return found

    while len(held) < leaves:
        gains = [best(m) for m in held]
        k = max(range(len(held)), key=lambda i: gains[i][0])
        if gains[k][1] is None:
            break
        del held[k]
        held += gains[k][1]
    return held


def test_trees_are_those_of_an_exhaustive_search():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 9, (120, 3)).astype(float)
    y = (x[:, 0] > 4) * (x[:, 1] > 3) * 3.0 + x[:, 2] / 7 + rng.normal(size=120) / 9
    got = oracles.Boosted(rounds=4, rate=0.5, leaves=6, least=8, bins=32, columns=1.0, rows=1.1).fit_predict(x, y, x)
    p = np.full(120, y.mean())
    for _ in range(4):
        e = y - p
        for m in plain_tree(x, e, 6, 8):
            p = p + 0.5 * m * e[m].mean()
    assert np.allclose(got, p)


def test_missing_values_and_tiny_sets():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    x[:80, 0] = np.nan
    y = np.isnan(x[:, 0]) * 5.0 + rng.normal(size=200) / 10
    got = oracles.Boosted(rounds=60, rate=0.2).fit_predict(x, y, np.array([[np.nan, 0.0], [0.0, np.nan]]))
    assert got[0] > 4 and got[1] < 1
    assert oracles.Boosted().fit_predict(x[:10], y[:10], x[:3]).tolist() == [y[:10].mean()] * 3
    assert np.isfinite(oracles.ridge_predict(x, y, x)).all() and oracles.ridge_predict(np.full((60, 1), np.nan), y[:60], x[:, :1]) == pytest.approx(y[:60].mean())


def test_sums_are_within_and_out_of_fold(spark):
    rng = np.random.default_rng(2)
    rows = [("ab"[k % 2], int(k // 2 % 5), float(k // 2 // 16), float(k // 2 % 16), float(v), float(2 * v + 40 * (k % 2) + e)) for k, (v, e) in enumerate(rng.normal(size=(512, 2)))] + [("few", 0, 0.0, 0.0, 1.0, 1.0)] * 9 + [("a", 0, 0.0, 0.0, 1.0, None)]
    df = spark.createDataFrame(rows, "g string, fold int, r double, c double, x double, y double")
    got = {(r.g, r.method): r for r in oracles.season_oracle(df, ["g"], "fold", ["x"], ["r", "c"], "y", rounds=100).collect()}
    assert set(got) == {(g, m) for g in "ab" for m in ("boosted", "ridge", "coordinates")} and all(r.n == 256 for r in got.values())
    for g in "ab":
        own = np.array([r[1:] for r in rows if r[0] == g and r[-1] is not None])
        f, x, y = own[:, 0], own[:, 3], own[:, 4]
        p = np.zeros(len(y))
        for k in range(5):
            t = f != k
            z, zt = (x[t] - x[t].mean()) / x[t].std(), (x[~t] - x[t].mean()) / x[t].std()
            p[~t] = y[t].mean() + zt * (z @ (y[t] - y[t].mean())) / (z @ z + t.sum())
        pc, yc = p - p.mean(), y - y.mean()
        assert (got[g, "ridge"].sse, got[g, "ridge"].sst) == pytest.approx((((pc - yc) ** 2).sum(), (yc**2).sum()))
        assert got[g, "boosted"].sse < 0.5 * got[g, "boosted"].sst and got[g, "coordinates"].sse > 0.8 * got[g, "coordinates"].sst
    again = oracles.season_oracle(df.orderBy(F.rand(3)), ["g"], "fold", ["x"], ["r", "c"], "y", rounds=100).collect()
    assert all(r.sse == pytest.approx(got[r.g, r.method].sse) for r in again)


def test_models_grown_together_are_those_grown_alone():
    rng = np.random.default_rng(4)
    models, alone = [], []
    for k, (n, width) in enumerate([(150, 3), (90, 2), (30, 2), (400, 3)]):
        x, y = rng.integers(0, 12, (n, width)).astype(float), rng.normal(size=n)
        cells = np.stack([oracles.bins_of(v, np.argsort(v, kind="stable"), np.arange(n) < n - 10, 32) for v in x.T], 1)
        models.append((cells[:-10], y[:-10], cells[-10:], k))
        alone.append(oracles.Boosted(rounds=9, rate=0.3, leaves=5, seed=k).fit_predict(x[:-10], y[:-10], x[-10:]))
    for got, want in zip(oracles.Boosted(rounds=9, rate=0.3, leaves=5).together(models), alone):
        assert np.allclose(got, want, atol=1e-12)


def test_boosted_oracle_reads_its_plan_once(spark):
    from gridloom.operators import kernels

    read = spark.sparkContext.accumulator(0)
    made = [("g", k % 5, float(k % 7), float(k % 7 > 3)) for k in range(300)]

    def seen(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    df = spark.createDataFrame(made, "g string, fold int, x double, y double").mapInPandas(seen, "g string, fold int, x double, y double")
    got = kernels.boosted_oracle(df, ["g"], "fold", ["x"], "y", rounds=2).collect()
    assert [(r.g, r.n) for r in got] == [("g", 300)] and got[0].sse < got[0].sst
    assert read.value <= 3 * 300  # the rows, their groups' sizes and means
