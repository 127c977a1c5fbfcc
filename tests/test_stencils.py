"""Stencils over halo tiles against plain loops: holes, several tiles, negative positions, null values; how much is copied."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import joins, reshape, stencils, windows


@pytest.fixture(scope="module")
def grid(spark):
    """Two seasons over several tiles, around zero, with holes; a full block for the squares."""
    draw = random.Random(3)
    rows = [("a", r, c, draw.choice([None, float(r * c % 7)]), float(draw.randrange(9))) for r in range(-70, 75, 1) for c in range(60, 70) if draw.random() < 0.8]
    rows += [("b", r, c, 1.0, float(r)) for r in range(55, 75) for c in range(-9, 12)]
    return rows, spark.createDataFrame(rows, "season_id string, grid_row int, grid_col long, target double, pred double").cache()


def test_windows(grid):
    rows, cells = grid
    value = {r[:3]: r[3] for r in rows}
    got = reshape.packed_windows(cells, "target", 2).collect()
    assert sorted((g[0], g[1], g[2]) for g in got) == sorted(value)
    for g in got:
        want = [value.get((g[0], g[1] + dr, g[2] + dc)) for dr in range(-2, 3) for dc in range(-2, 3)]
        assert g["values"] == want and g["valid"] == [v is not None for v in want]
    long = joins.neighbours(cells.select(F.col("season_id").alias("s"), F.col("grid_row").alias("r"), F.col("grid_col").alias("c"), "target"), "target", 1, "s", "r", "c")
    assert long.columns == ["s", "r", "c", "k", "target"] and long.count() == 9 * len(rows)


def test_pairs_and_relation(grid):
    rows, cells = grid
    at = {r[:3]: r for r in rows}
    want, loss, weight = [], 0.0, 0.0
    for (s, r, c), a in at.items():
        for dr, dc in stencils.offsets(3, True):
            if b := at.get((s, r + dr, c + dc)):
                d = max(abs(dr), abs(dc))
                want.append((s, d, a[3], b[3]))
                if a[3] is not None and b[3] is not None:
                    e, w = abs(a[4] - a[3] - b[4] + b[3]), 0.5 if d == 1 else 1.0
                    loss, weight = loss + w * (0.5 * e * e if e <= 1 else e - 0.5), weight + w
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in joins.within_radius_pairs(cells, ["target"], 3).collect())
    (row,) = joins.relation_metric(cells, 3).collect()
    assert row.pairs == len(want) and row.relation == pytest.approx(loss / weight)
    assert joins.relation_metric(cells.limit(0)).first().asDict() == {"pairs": 0, "relation": None}


def test_edge_distance(grid):
    rows, cells = grid
    have = {r[:3] for r in rows}
    for cap in (2, 50):
        for r in windows.edge_distance(cells, cap).collect():
            d = 0
            while d < cap and all((r[0], r[1] + x, r[2] + y) in have for x in range(-d - 1, d + 2) for y in range(-d - 1, d + 2)):
                d += 1
            assert r["edge"] == d
    assert windows.edge_distance(cells).count() == len(rows)


@pytest.mark.parametrize("radius", [1, 2, 5, 50])
def test_few_cells_are_copied(spark, radius):
    cells = spark.range(500 * 500).select(F.lit("a").alias("season_id"), F.floor(F.col("id") / 500).alias("grid_row"), (F.col("id") % 500).alias("grid_col"))
    assert stencils.dealt(cells, radius).count() < (1.2 if radius < 5 else 1.75) * 250_000
