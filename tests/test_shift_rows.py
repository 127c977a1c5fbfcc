"""Equal rows go through the passes of the shift scores once."""

import numpy as np

from gridloom.operators import shift


def test_equal_rows_are_one(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(int(g), float(round(v + g / 2, 1)), float(v > 0)) for g, v in zip(rng.integers(0, 3, 300), rng.normal(size=300))]
    newton, seen = shift._newton, []
    monkeypatch.setattr(shift, "_newton", lambda some, *a: seen.append(some.count()) or newton(some, *a))
    score = lambda x: {r.g: r for r in shift.shift_scores(spark.createDataFrame(x, "g int, u double, y double"), "g", {"all": ["u"]}, "y").collect()}
    one, many = score(rows), score(rows * 4)
    assert seen == [len(set(rows))] * 2
    for g, r in one.items():
        assert many[g].n == 4 * r.n and abs(many[g].target_shift - r.target_shift) < 1e-9
        assert abs(many[g].auroc_all - r.auroc_all) < 0.01  # deviations of samples: features are scaled by n - 1 rows
