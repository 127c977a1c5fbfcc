"""Operators on the cells around a cell: seasons are cut into square tiles, only cells near a border are copied, one dense kernel a tile.

A tile has `side` cells a side, at least 64 and at least eight radii, so that a season of whole tiles is copied (1 + 2 / 8)^2 = 1.56 times
at most, and 1.13 times at radius 2; a large season has many tiles, a task holds one at a time. Cells are
unique by season, row and column; rows and columns are integers of any sign, cells with a null among them are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Season, row, column.
KEY = ("season_id", "grid_row", "grid_col")


def side_of(radius: int) -> int:
    return max(64, 8 * radius)


def dealt(cells: DataFrame, radius: int, key: tuple[str, str, str] = KEY) -> DataFrame:
    """The cells with tile (__tr, __tc), once for their own tile and once for each other tile within the radius."""
    side = side_of(radius)

    def touched(c: str):
        at = F.col(c).cast("long")
        return F.explode(F.array_distinct(F.array(*[F.floor((at + d) / side).cast("long") for d in (-radius, 0, radius)])))

    return cells.dropna(subset=list(key)).withColumn("__tr", touched(key[1])).withColumn("__tc", touched(key[2]))


class Tile:
    """A tile's rows as a dense grid of their numbers with a border of the radius, -1 where there is no cell."""

    def __init__(self, rows: pa.Table, radius: int, key: tuple[str, str, str]):
        side = side_of(radius)
        self.rows, self.radius = rows, radius
        first = [rows[c][0].as_py() * side - radius for c in ("__tr", "__tc")]
        self.r, self.c = (rows[k].combine_chunks().cast(pa.int64()).to_numpy() - f for k, f in zip(key[1:], first))
        self.grid = np.full((side + 2 * radius,) * 2, -1, np.int64)
        self.grid[self.r, self.c] = np.arange(len(self.r))
        inside = lambda x: (x >= radius) & (x < radius + side)
        self.own = np.flatnonzero(inside(self.r) & inside(self.c))

    def at(self, dr: int, dc: int) -> np.ndarray:
        """For each own cell the number of the row that far away, -1 where there is none."""
        return self.grid[self.r[self.own] + dr, self.c[self.own] + dc]

    def take(self, name: str, numbers: np.ndarray) -> pa.Array:
        """Values of those rows, null for -1."""
        return self.rows[name].combine_chunks().take(pa.array(numbers, mask=numbers < 0))


def by_tile(cells: DataFrame, radius: int, columns: list[str], schema: str, kernel: Callable[[Tile], dict[str, pa.Array]], key: tuple[str, str, str] = KEY) -> DataFrame:
    """The rows that the kernel makes of each tile; the key's columns have the types of `cells`."""
    kinds = dict(cells.dtypes)
    names = [part.strip().split()[0].strip("`") for part in schema.split(", ")]

    def run(rows: pa.Table) -> pa.Table:
        made = kernel(Tile(rows, radius, key))
        return pa.Table.from_arrays([made[n] for n in names], names)

    full = ", ".join(f"{n} {kinds[n]}" if n in key else part.strip() for n, part in zip(names, schema.split(", ")))
    return dealt(cells.select(*key, *columns), radius, key).groupBy(key[0], "__tr", "__tc").applyInArrow(run, full)


def offsets(radius: int, forward: bool = False) -> Iterator[tuple[int, int]]:
    """(rows, columns) away, by rows; forward: only the half plane that meets each pair of cells once."""
    for dr in range(-radius, radius + 1):
        for dc in range(-radius, radius + 1):
            if not forward or dr > 0 or (dr == 0 and dc > 0):
                yield dr, dc


def windows(cells: DataFrame, value: str, radius: int = 2, key: tuple[str, str, str] = KEY) -> DataFrame:
    """(key, values): the (2 radius + 1)^2 values around each cell, by rows, null where there is no cell."""

    def kernel(t: Tile) -> dict[str, pa.Array]:
        around = np.stack([t.at(dr, dc) for dr, dc in offsets(radius)], 1)
        starts = np.arange(len(around) + 1, dtype=np.int32) * around.shape[1]
        return {**{k: t.take(k, t.own) for k in key}, "values": pa.ListArray.from_arrays(pa.array(starts), t.take(value, around.ravel()))}

    return by_tile(cells, radius, [value], f"{', '.join(f'{k} x' for k in key)}, values array<{dict(cells.dtypes)[value]}>", kernel, key)


def pairs(cells: DataFrame, values: list[str], radius: int = 5, key: tuple[str, str, str] = KEY) -> DataFrame:
    """(season, distance, a_*, b_*) of the pairs of a season's cells within the Chebyshev radius, each once."""
    kinds = dict(cells.dtypes)

    def kernel(t: Tile) -> dict[str, pa.Array]:
        a, b, d = [], [], []
        for dr, dc in offsets(radius, True):
            there = t.at(dr, dc)
            met = there >= 0
            a.append(t.own[met])
            b.append(there[met])
            d.append(np.full(met.sum(), max(abs(dr), abs(dc)), np.int32))
        a, b = np.concatenate(a), np.concatenate(b)
        return {key[0]: t.take(key[0], a), "distance": pa.array(np.concatenate(d)), **{f"{s}_{v}": t.take(v, x) for v in values for s, x in (("a", a), ("b", b))}}

    return by_tile(cells, radius, values, f"{key[0]} x, distance int, " + ", ".join(f"{s}_{v} {kinds[v]}" for v in values for s in "ab"), kernel, key)


def relation_sums(cells: DataFrame, target: str, pred: str, radius: int = 5, delta: float = 1.0, key: tuple[str, str, str] = KEY) -> DataFrame:
    """(season, pairs, weight, loss): additive sums of a tile's pairs, whose first cell is its own; pairs with a null have no loss and no weight."""
    error = cells.select(*key, (F.col(pred).cast("double") - F.col(target).cast("double")).alias("__e"))

    def kernel(t: Tile) -> dict[str, pa.Array]:
        e = t.rows["__e"].combine_chunks().to_numpy(zero_copy_only=False)
        n = weight = loss = 0.0
        for dr, dc in offsets(radius, True):
            there = t.at(dr, dc)
            met = there >= 0
            gap = np.abs(e[t.own[met]] - e[there[met]])
            w = 0.5 if max(abs(dr), abs(dc)) == 1 else 1.0
            n += met.sum()
            known = gap[~np.isnan(gap)]
            weight += w * len(known)
            loss += w * np.where(known <= delta, 0.5 * known * known, delta * (known - 0.5 * delta)).sum()
        return {key[0]: t.take(key[0], np.zeros(1, np.int64)), "pairs": pa.array([int(n)]), "weight": pa.array([float(weight)]), "loss": pa.array([float(loss)])}

    return by_tile(error, radius, ["__e"], f"{key[0]} x, pairs long, weight double, loss double", kernel, key)


def lag_sums(cells: DataFrame, value: str, lags: int, key: tuple[str, str, str] = KEY) -> DataFrame:
    """(season, h, d, n, odd): sums of squared differences and numbers of a tile's pairs that lie h apart along a row or a column, null values left out.

    `odd` marks tiles with a value that isn't finite; these have a row of h = 0 too, as they may have no pair.
    """
    known = cells.select(*key, F.col(value).cast("double").alias("__v")).filter("__v is not null")

    def kernel(t: Tile) -> dict[str, pa.Array]:
        v = t.rows["__v"].combine_chunks().to_numpy(zero_copy_only=False)
        n, d = np.zeros(lags, np.int64), np.zeros(lags)
        for h in range(1, lags + 1):
            for there in (t.at(h, 0), t.at(0, h)):
                met = there >= 0
                n[h - 1] += met.sum()
                d[h - 1] += ((v[there[met]] - v[t.own[met]]) ** 2).sum()
        odd = not np.isfinite(v[t.own]).all()
        h = np.flatnonzero(np.append(odd, n))
        return {key[0]: t.take(key[0], np.zeros(len(h), np.int64)), "h": pa.array(h.astype(np.int32)), "d": pa.array(np.append(0, d)[h]), "n": pa.array(np.append(0, n)[h]), "odd": pa.array(np.full(len(h), odd))}

    return by_tile(known, lags, ["__v"], f"{key[0]} x, h int, d double, n long, odd boolean", kernel, key)


def box_means(cells: DataFrame, value: str, radius: int, key: tuple[str, str, str] = KEY) -> DataFrame:
    """(key, mean): the mean of the other cells' values within the Chebyshev radius, nulls skipped; null where there are none."""
    known = cells.select(*key, F.col(value).cast("double").alias("__v"))

    def kernel(t: Tile) -> dict[str, pa.Array]:
        column = t.rows["__v"].combine_chunks()
        there, v = np.asarray(column.is_valid()), column.fill_null(0.0).to_numpy()
        n, s = np.zeros(len(t.own), np.int64), np.zeros(len(t.own))
        for dr, dc in offsets(radius):
            if dr or dc:
                at = t.at(dr, dc)
                use = (at >= 0) & there[at]
                n += use
                s += np.where(use, v[at], 0.0)
        return {**{k: t.take(k, t.own) for k in key}, "mean": pa.array(s / np.maximum(n, 1), mask=n == 0)}

    return by_tile(known, radius, ["__v"], f"{', '.join(f'{k} x' for k in key)}, mean double", kernel, key)


def full_squares(cells: DataFrame, cap: int = 50, key: tuple[str, str, str] = KEY) -> DataFrame:
    """(key, edge): the largest d up to `cap` whose square of 2 d + 1 cells a side around the cell has no hole."""

    def kernel(t: Tile) -> dict[str, pa.Array]:
        full, edge = t.grid >= 0, np.zeros(t.grid.shape, np.int32)
        for _ in range(cap):
            across = full.copy()
            across[:, 1:] &= full[:, :-1]
            across[:, :-1] &= full[:, 1:]
            across[:, [0, -1]] = False
            full = across.copy()
            full[1:] &= across[:-1]
            full[:-1] &= across[1:]
            full[[0, -1]] = False
            if not full.any():
                break
            edge += full
        return {**{k: t.take(k, t.own) for k in key}, "edge": pa.array(edge[t.r[t.own], t.c[t.own]])}

    return by_tile(cells.select(*key).distinct(), cap, [], f"{', '.join(f'{k} x' for k in key)}, edge int", kernel, key)
