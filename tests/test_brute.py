"""Queries that SQL can't express, against plain Python over the same small tables."""

import hashlib
import math
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import kernels, shift
from gridloom.plans import registry, views

SF = "/root/testdata/sf0.001"


def run(spark, name):
    return registry.queries()[name](spark, SF).collect()


@pytest.fixture(scope="module")
def panel(spark):
    return [r.asDict() for r in views.panel(spark, SF).collect()]


def by(rows, *keys):
    out = defaultdict(list)
    for r in rows:
        out[tuple(r[k] for k in keys)].append(r)
    return out


def test_fingerprints(spark):
    for r in run(spark, "s11_fingerprints"):
        raw = Path(SF, r.file).read_bytes()
        assert r.length == len(raw) and r.digest == hashlib.sha256(raw[: 1 << 16] + raw[-(1 << 16) :]).hexdigest() and r.stale == r.file.startswith("region")


def test_weighted_quantiles(spark, panel):
    """Seasons weigh one; quantiles by linear interpolation of the mid-cumulated weights."""
    got = by([r.asDict() for r in run(spark, "a36_weighted_quantiles")], "crop")
    assert len(got) > 1
    for (crop,), rows in by(panel, "crop").items():
        size = {k: len(v) for k, v in by(rows, "season_id").items()}
        weight = defaultdict(float)
        for r in rows:
            weight[float(r["target"])] += 1 / size[r["season_id"],]
        count = {k: len(v) for k, v in by(rows, "target").items()}
        v, at, past = [], [], 0.0
        for x in sorted(weight):  # equal values share their weight; the first and the last of them are places
            each = weight[x] / count[x,]
            v += [x, x]
            at += [past + each / 2, past + weight[x] - each / 2]
            past += weight[x]
        mine = sorted(got[crop,], key=lambda r: r["k"])
        assert [r["k"] for r in mine] == list(range(101))
        assert np.allclose([r["value"] for r in mine], np.interp(np.arange(101) / 100, np.array(at) / past, v), atol=1e-4)


def test_effective_rank(spark):
    e = np.array([r[0] for r in views.table(spark, SF, "embeddings").select("embedding").collect()], float)
    spectrum = np.clip(np.linalg.eigvalsh(np.cov(e.T, bias=True)), 0, None)
    p = spectrum / spectrum.sum()
    (row,) = run(spark, "a42_effective_rank")
    assert row.n == len(e) and row.effective_rank == pytest.approx(math.exp(-sum(x * math.log(x) for x in p if x > 0)), abs=1e-3) and row.top_share == pytest.approx(p.max(), abs=1e-4)


def test_scale_bands(spark, panel):
    """Bands of a grid by a convolution written out cell by cell along each axis."""

    def smooth(g, mask, s):
        reach = int(4 * s + 0.5)
        k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / s) ** 2)
        k /= k.sum()
        line = lambda v: np.convolve(np.pad(v, reach), k, "valid")
        both = [np.array([line(r) for r in np.array([line(c) for c in a.T]).T]) for a in (np.where(mask, g, 0.0), mask.astype(float))]
        return np.where(mask, both[0] / np.maximum(both[1], 1e-12), 0.0)

    sums = defaultdict(lambda: np.zeros(4))
    for (crop, _), rows in by(panel, "crop", "season_id").items():
        if len(rows) < 50:
            continue
        r, c = (np.array([x[k] for x in rows]) for k in ("grid_row", "grid_col"))
        mask = np.zeros((32, 32), bool)
        mask[r, c] = True
        parts = []
        for name in ("target", "pred"):
            v = np.array([float(x[name]) for x in rows])
            g = np.zeros((32, 32))
            g[r, c] = v - v.mean()
            levels = [g, *[smooth(g, mask, s) for s in kernels.SIGMAS]]
            parts.append([a - b for a, b in zip(levels, levels[1:])] + [levels[-1]])
        for band, (y, p) in enumerate(zip(*parts)):
            sums[crop, band] += [(y[mask] ** 2).sum(), (p[mask] ** 2).sum(), (y * p)[mask].sum(), ((y - p)[mask] ** 2).sum()]
    got = run(spark, "a23_a61_scale_bands")
    assert len(got) == len(sums) > 0
    for r in got:
        yy, pp, yp, ee = sums[r.crop, r.band]
        total = sum(v[0] for (c, _), v in sums.items() if c == r.crop)
        assert [r.share, r.explained, r["corr"]] == pytest.approx([yy / total, 1 - ee / yy, yp / math.sqrt(yy * pp)], abs=2e-4)


def test_far_cells_need_no_grid_between_them(spark):
    rng = np.random.default_rng(9)
    rows = [(0, r, c, float(v), float(w)) for (r, c), (v, w) in zip([(a, b) for a in range(8) for b in range(8)], rng.normal(size=(64, 2)))]
    far = [(0, r + 2_000_000_000 * (r > 3), c - 1_000_000 * (c > 3), v, w) for _, r, c, v, w in rows]
    near = [(0, r + 65 * (r > 3), c + 65 * (c > 3) if c < 4 else c + 300, v, w) for _, r, c, v, w in rows]
    bands = lambda x: [tuple(r) for r in kernels.scale_bands(spark.createDataFrame(x, "season_id long, grid_row int, grid_col int, target double, pred double"), []).orderBy("band").collect()]
    assert np.allclose(bands(far), bands(near)) and not np.allclose(bands(far), bands(rows))
    assert kernels.close_gaps(np.array([5, -3, 10**9, 5])).tolist() == [8, 0, 73, 8]


def test_mutual_information_of_a_bivariate_normal(spark):
    """The estimate against the closed form -log(1 - r^2) / 2."""
    rng = np.random.default_rng(1)
    for r in (0.0, 0.6, 0.9):
        x = rng.normal(size=1500)
        y = r * x + math.sqrt(1 - r * r) * rng.normal(size=1500)
        df = spark.createDataFrame([("g", k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y))], "g string, i long, x double, y double")
        (row,) = kernels.mutual_information(df, ["g"], ["x"], "y", F.col("i")).collect()
        assert row.n == 1500 and row.mi == pytest.approx(-0.5 * math.log(1 - r * r), abs=0.08)


def test_ridge_oracle(spark):
    """Out-of-fold sums of squares of one group by the normal equations."""
    rng = np.random.default_rng(2)
    a, f = rng.normal(size=(300, 2)), np.arange(300) % 5
    y = a @ [1.0, -2.0] + rng.normal(size=300)
    df = spark.createDataFrame([("g", int(k), float(p), float(q), float(t)) for k, (p, q), t in zip(f, a, y)] + [("few", 0, 1.0, 1.0, 1.0)] * 9, "g string, fold int, p double, q double, y double")
    sse = 0.0
    for k in range(5):
        t = f != k
        z = (a - a[t].mean(0)) / a[t].std(0)
        beta = np.linalg.inv(z[t].T @ z[t] + np.eye(2)) @ z[t].T @ (y[t] - y[t].mean())
        sse += ((y[~t] - y[t].mean() - z[~t] @ beta) ** 2).sum()
    (row,) = kernels.ridge_oracle(df, ["g"], "fold", ["p", "q"], "y").collect()
    assert row.n == 300 and row.sse == pytest.approx(sse) and row.sst == pytest.approx(((y - y.mean()) ** 2).sum())
    assert all(r.fields > 0 and r.r2 < 1 for r in run(spark, "a46_a47_ridge_oracle"))


def test_shift_scores_are_out_of_fold(spark):
    """Features that carry nothing give about a half, which scores on the fitted rows would exceed; a shifted group is found."""
    rng = np.random.default_rng(3)
    rows = [(g, *map(float, rng.normal(size=6)), float(rng.normal())) for g in "abc" for _ in range(40)]
    names = [f"x{k}" for k in range(6)]
    schema = "g string, " + ", ".join(f"{c} double" for c in names) + ", y double"
    for r in shift.shift_scores(spark.createDataFrame(rows, schema), "g", {"all": names, "two": names[:2]}, "y").collect():
        assert r.n == 120 and r.auroc_all < 0.62 and r.auroc_two is not None
    far = [(g, x[0] + 3 * (g == "a"), *x[1:-1], x[-1] + 2 * (g == "a")) for g, *x in rows] + [("a", None, *[0.0] * 5, 1.0), (None, *[0.0] * 6, 1.0)]
    got = {r.g: r for r in shift.shift_scores(spark.createDataFrame(far, schema), "g", {"all": names, "blind": names[1:]}, "y").collect()}
    y = {g: np.array([r[-1] for r in far[:120] if (r[0] == "a") == g]) for g in (True, False)}
    assert set(got) == set("abc") and got["a"].n == 120
    assert got["a"].auroc_all > 0.95 and got["a"].auroc_blind < 0.7 and got["a"].target_shift == pytest.approx((y[True].mean() - y[False].mean()) / y[False].std())


@pytest.mark.parametrize("together", [200, 2])
def test_shift_models_fitted_together_are_those_fitted_alone(spark, monkeypatch, together):
    """Scores of every group and fold by plain Newton steps of one model at a time; a group of one row misses from a fold."""
    monkeypatch.setattr(shift, "TOGETHER", together)
    rng = np.random.default_rng(8)
    rows = [("abc"[k % 3], k, float(u + (k % 3)), float(5 * v), float(u)) for k, (u, v) in enumerate(rng.normal(size=(90, 2)))] + [("d", 90, 9.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, i long, u double, v double, y double")
    fold = {r.i: r.f for r in df.select("i", F.pmod(F.xxhash64("i"), F.lit(3)).alias("f")).collect()}
    got = {r.g: r for r in shift.shift_scores(df, "g", {"all": ["u", "v"]}, "y", 3, F.col("i")).collect()}
    x, f, g = np.array([r[2:4] for r in rows]), np.array([fold[r[1]] for r in rows]), np.array([r[0] for r in rows])
    for name in "abcd":
        s = np.zeros(len(rows))
        for k in range(3):
            t = f != k
            z = np.column_stack([np.ones(len(rows)), (x - x[t].mean(0)) / x[t].std(0, ddof=1)])
            y, b = (g[t] == name).astype(float), np.zeros(3)
            ridge = np.diag([0, 0.01, 0.01])
            for _ in range(200):  # small steps along the gradient, scaled by the bound of the curvature
                p = 1 / (1 + np.exp(-z[t] @ b))
                b += np.linalg.solve(z[t].T @ z[t] / t.sum() / 4 + ridge, z[t].T @ (y - p) / t.sum() - ridge @ b)
            s[~t] = 1 / (1 + np.exp(-z[~t] @ b))
        a, o = s[g == name], s[g != name]
        want = ((a[:, None] > o[None]).sum() + 0.5 * (a[:, None] == o[None]).sum()) / a.size / o.size
        assert got[name].n == 91 and (name == "d" or got[name].auroc_all == pytest.approx(want, abs=2e-3))


def test_content_hash_is_of_rows_in_any_order(spark):
    from gridloom.sources.tables import content_hash

    d = views.table(spark, SF, "documents").select("lang", "doc_id", "text")
    hashes = {r.lang: r.hash for r in run(spark, "s26_content_hash")}
    assert {r.lang: r.hash for r in content_hash(d.repartition(5, "text"), ["lang"], ["doc_id", "text"]).collect()} == hashes
    want = defaultdict(lambda: [0, 0, 0, 0])
    for r in d.collect():
        row = "".join("-;" if v is None else f"{len(str(v))}:{v}" for v in (r["doc_id"], r["text"]))
        h = hashlib.sha256(row.encode()).hexdigest()
        for k in range(4):
            want[r.lang][k] += int(h[8 * k : 8 * k + 8], 16)
    assert hashes == {k: hashlib.sha256(":".join(map(str, v)).encode()).hexdigest() for k, v in want.items()}


def test_groups_stay_whole_and_near_their_shares(spark):
    rows = run(spark, "g02_g03_greedy_assignment")
    assert len({(r.country, r.farm_id) for r in rows}) == len(rows) and {r["partition"] for r in rows} <= {"train", "val", "test"}
    farms = {r["farm_id"] for r in views.seasons(spark, SF).select("farm_id").collect()}
    folds = run(spark, "g07_stratified_group_folds")
    key = next(c for c in folds[0].asDict() if c != "fold")
    assert len(folds) == len({r[key] for r in folds}) and {str(r[key]) for r in folds} <= set(map(str, farms)) and len({r.fold for r in folds}) == 3


def test_information_per_season_takes_every_cell(spark, panel):
    """Counts of neighbours by plain loops over one season."""
    got = by([r.asDict() for r in run(spark, "a25_information_per_season")], "season_id", "k")
    cells = by(panel, "season_id")
    assert {s for s, _ in got} == {s for s, in cells} and all(r[0]["n"] == len(cells[s,]) for (s, _), r in got.items())
    rng = np.random.default_rng(5)
    rows = [(1, k, float(a), float(b), float(a + b / 2)) for k, (a, b) in enumerate(rng.normal(size=(120, 2)))]
    (mine,) = kernels.mutual_information(spark.createDataFrame(rows, "g long, i long, a double, b double, y double"), ["g"], ["a", "b"], "y", F.col("i"), [4]).collect()
    z = np.array([r[2:] for r in rows])
    z = (z - z.mean(0)) / z.std(0)
    total = 0.0
    for i in range(120):
        dx, dy = np.abs(z[:, :2] - z[i, :2]).max(1), np.abs(z[:, 2] - z[i, 2])
        eps = sorted(np.maximum(dx, dy))[4]
        total += sum(kernels.digamma(max(1, int((v < eps).sum()))) for v in (dx, dy))
    assert mine.n == 120 and mine.mi == pytest.approx(kernels.digamma(4) + kernels.digamma(120) - total / 120, abs=1e-6)


def test_components_of_centred_columns(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(90, 1)) @ [[1.0, 2.0, -1.0]] + rng.normal(size=(90, 3)) / 10
    rows = [(k % 3, *(float(v) + 50 * (k % 3) for v in base[k])) for k in range(90)]
    c = kernels.centred(spark.createDataFrame(rows, "g int, a double, b double, c double"), ["g"], ["a", "b", "c"])
    got = kernels.principal(c, ["a", "b", "c"], 1).collect()
    z = np.array([[r.a, r.b, r.c] for r in got])
    g = np.array([r.g for r in got])
    assert len(got) == 90 and all(abs(z[g == k].mean()) < 1e-9 for k in range(3))
    axis = np.linalg.svd(z - z.mean(0))[2][0]
    assert np.allclose(np.abs([r.pc0 for r in got]), np.abs(z @ axis), atol=1e-6)


def test_boosted_oracle_is_out_of_fold(spark):
    """A product is found by trees, noise by none; group means take no part."""
    rng = np.random.default_rng(7)
    rows = []
    for k in range(900):
        a, b, e = map(float, rng.normal(size=3))
        rows.append(("xy"[k % 2], k // 2 % 3, a, b, 5.0 * (a > 0) * (b > 0) + 100 * (k % 2), e))
    df = spark.createDataFrame(rows, "g string, f int, a double, b double, y double, e double")
    told = kernels.boosted_oracle(df, ["g"], "f", ["a", "b"], "y", 3).collect()
    assert {r.g for r in told} == {"x", "y"} and all(r.n == 450 and r.sse < 0.1 * r.sst for r in told)
    assert all(r.sse > 0.9 * r.sst for r in kernels.boosted_oracle(df, ["g"], "f", ["a", "b"], "e", 3).collect())
    assert kernels.boosted_oracle(df, ["g"], "f", ["a", "b"], "y", 3, least=451).count() == 0


def test_coordinates_only_takes_every_fold_cell(spark, panel):
    sizes = {k: len(v) for k, v in by(panel, "season_id").items()}
    want = defaultdict(int)
    for (season,), rows in by(panel, "season_id").items():
        want[rows[0]["crop"]] += sizes[season,] if sizes[season,] >= 200 else 0
    for name in ("a46_coordinates_only", "a46_boosted_trees"):
        assert {r.crop: r.cells for r in run(spark, name)} == {k: v for k, v in want.items() if v}
