"""Steps whose work must not outgrow the input: results against brute force, and the shape of the plan or of the work."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import joins as J
from gridloom.operators import sampling as T
from gridloom.operators import splits as G
from gridloom.operators import stats as S
from gridloom.operators import tiles


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_copies_of_a_box_are_linked_without_their_pairs(spark, monkeypatch):
    spots = [("g", 0, 0, 10, 10), ("g", 2, 0, 10, 10), ("g", 500, 0, 10, 10), ("h", 0, 0, 10, 10), ("g", 3, 0, 0, 10), (None, 0, 0, 10, 10)]
    rows = [(i, *spots[i % 6]) for i in range(120, 0, -1)]
    met, plain = [], G.overlaps
    monkeypatch.setattr(G, "overlaps", lambda boxes, *a, **k: met.append(boxes.count()) or plain(boxes, *a, **k))
    got = dict(map(tuple, G.connected_boxes(spark.createDataFrame(rows, "id long, grp string, x0 int, y0 int, w int, h int"), ["grp"]).collect()))
    assert met == [5]
    assert got == {i: {0: 1, 1: 1, 2: 2, 3: 3}.get(i % 6, i) for i in range(1, 121)}


def test_negatives_shuffle_no_pairs(spark):
    def mixed(k, seed):
        x = (k % 2**31 * T.KNUTH + seed * 40503) % 2**32
        return ((x ^ (x >> 15)) % 2**31 * T.KNUTH + 12345) % 2**32

    rows = [(k, None if k % 11 == 0 else f"f{k % 4}") for k in range(300)] + [(7, "f1")]
    df = spark.createDataFrame(rows, "k long, f string")
    for n in (1, 3):
        want = []
        for k in {r[0] for r in rows}:
            bucket = -(-len(rows) // 50)
            pairs = [(mixed(k * 31 + b, 5), b) for a, f in rows if a == k for b, g in rows if f and g and f != g and mixed(k, 5) % bucket == mixed(b, 5) % bucket]
            want += [(k, b) for _, b in sorted(pairs)[:n]]
        out = T.negatives(df, "k", "f", 50, n, 5)
        assert sorted(map(tuple, out.collect())) == sorted(want)
        assert "Window" not in plan(out)


def test_a_tile_is_not_compared_whole(monkeypatch):
    """Distances and counts equal brute force, ties and clusters included, and a query meets few of a tile's points."""
    rng = np.random.default_rng(3)
    for dims in (1, 2, 3):
        x = np.concatenate([rng.normal(size=(700, dims)), rng.integers(0, 3, (500, dims)) + rng.normal(size=(500, dims)) * 1e-9, np.repeat(rng.normal(size=(3, dims)), 40, 0)])
        a = np.concatenate([x[::3], rng.normal(size=(200, dims)) * 2])
        d = lambda p: np.abs(p[:, None] - x[None]).max(2)
        assert (tiles.Leaves(x).own_nearest(x, 6) == np.sort(d(x), 1)[:, :6]).all()
        r = np.sort(d(a), 1)[np.arange(len(a)), rng.integers(1, 60, len(a))]
        near = np.sort(np.where(d(a) < r[:, None], d(a), np.inf), 1)[:, :5]
        assert (tiles.Leaves(x).nearest(a, 5, r) == near).all()
        assert (tiles.closer(x, a, r) == (d(a) < r[:, None]).sum(1)).all()
    few = tiles.Leaves(x[:3])
    assert np.isfinite(few.own_nearest(x[:3], 6)).sum() == 9
    met, plain, x = [], tiles.Leaves.distances, rng.normal(size=(20_000, 2))
    monkeypatch.setattr(tiles.Leaves, "distances", lambda self, q, leaf: met.append(len(q) * self.x.shape[1]) or plain(self, q, leaf))
    tiles.Leaves(x).own_nearest(x, 4)
    assert sum(met) < 20_000 * 400


def _cells(spark):
    rng = np.random.default_rng(4)
    rows = {(s, e, int(r), int(c)): None if i % 9 == 0 else float(round(v, 1)) for s in (1, 2) for e in "ab" for i, (r, c, v) in enumerate(zip(rng.integers(-9, 80, 900), rng.integers(60, 70, 900), rng.normal(size=900)))}
    rows[3, "a", 0, 0] = 5.0
    return rows, spark.createDataFrame([(*k, v) for k, v in rows.items()], "season_id long, e string, grid_row int, grid_col int, target double")


def test_box_means_copy_border_cells_only(spark):
    rows, df = _cells(spark)
    out = J.neighbourhood_mean(df, "target", 2, ["e"])
    got = {tuple(r)[:4]: r.neighbour_mean for r in out.collect()}
    near = {k: [v for a in range(-2, 3) for b in range(-2, 3) if (a or b) and (v := rows.get((k[0], k[1], k[2] + a, k[3] + b))) is not None] for k in rows}
    assert got == {k: pytest.approx(np.mean(v)) if v else None for k, v in near.items()}
    assert "Window" not in plan(out) and "Join" not in plan(out)


def test_semivariogram_without_windows_of_cells(spark):
    rows, df = _cells(spark)
    rows = {(k[0], *k[2:]): v for k, v in rows.items() if k[1] == "a"}
    rows[4, 0, 0], rows[4, 0, 2], rows[4, 50, 50] = 1.0, 4.0, float("inf")
    df = df.filter("e = 'a'").drop("e").unionByName(spark.createDataFrame([(*k, v) for k, v in rows.items() if k[0] == 4], "season_id long, grid_row int, grid_col int, target double"))
    want = {}
    for (s, r, c), v in rows.items():
        for h in (1, 2, 3):
            for there in ((s, r + h, c), (s, r, c + h)):
                if v is not None and rows.get(there) is not None:
                    g, n = want.get((s, h), (0, 0))
                    want[s, h] = g + (rows[there] - v) ** 2 / 2, n + 1
    want[4, 2] = float("nan"), 1
    out = S.semivariogram(df, lags=3)
    assert {(r.season_id, r.h): (r.gamma_sum, r.n_pairs) for r in out.collect()} == {k: pytest.approx(v, nan_ok=True) for k, v in want.items()}
    assert plan(out).count("RunningWindowFunction") == 0 and "specifiedwindowframe(RangeFrame" not in plan(out)


def test_audit_takes_percentiles_without_one_list_of_values(spark):
    rng = np.random.default_rng(5)
    v = [*(float(round(x, 2)) for x in rng.normal(size=400)), -1.0, -1.0, 0.0, None, float("nan"), float("inf"), float("-inf")]
    df = spark.createDataFrame([(i // 2, x) for i, x in enumerate(v)], "k long, target double")
    out = S.table_audit(df, ["k"])
    (row,) = out.collect()
    known = np.array([x for x in v if x is not None and np.isfinite(x)])
    nan_is_large = sum(x is not None and x <= 0 for x in v)
    assert tuple(row)[:6] == (407, 204, 203, 4, 2, nan_is_large)
    assert tuple(row)[6:] == pytest.approx(np.quantile(known, [0, 0.01, 0.5, 0.99, 1]).tolist())
    assert "percentile" not in plan(out)
    (none,) = S.table_audit(df.limit(0), ["k"]).collect()
    assert tuple(none) == (0, 0, 0, 0, 0, 0, *[None] * 5)
