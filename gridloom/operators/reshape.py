"""Reshaping between long cells, wide rows, tiles, patches and dense grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stencils


def wide(df: DataFrame, key: list[str], slot: str, slots: list[int], channels: list[str]) -> DataFrame:
    """One row a cell: channel@slot columns, whether each slot is there, by conditional maxima (no pivot scan)."""
    at = lambda k, c: F.max(F.when(F.col(slot) == k, c))
    cols = [at(k, F.col(c)).alias(f"{c}@{k}") for k in slots for c in channels]
    return df.groupBy(*key).agg(*cols, *[F.coalesce(at(k, F.lit(True)), F.lit(False)).alias(f"dated@{k}") for k in slots])


def tiles(cells: DataFrame, size: int, by: list[str], row: str = "grid_row", col: str = "grid_col", target: str = "target", least: int = 1) -> DataFrame:
    """Non-overlapping tiles on the grid's origin with their extent and counts; those under `least` valid targets drop out."""
    g = cells.groupBy(*by, F.floor(F.col(row) / size).cast("int").alias("tile_row"), F.floor(F.col(col) / size).cast("int").alias("tile_col"))
    t = g.agg(F.min(row).alias("row0"), F.max(row).alias("row1"), F.min(col).alias("col0"), F.max(col).alias("col1"), F.count("*").alias("cells"), F.count(target).alias("valid"))
    return t.filter(F.col("valid") >= least)


def retiled(df: DataFrame, height: int, width: int, size: int, row: str = "grid_row", col: str = "grid_col") -> DataFrame:
    """Cells of a height x width block cut into size x size tiles; the edge that fills no tile is dropped."""
    x = df.filter((F.col(row) < height // size * size) & (F.col(col) < width // size * size))
    return x.withColumns({"tile": (F.floor(F.col(row) / size) * (width // size) + F.floor(F.col(col) / size)).cast("int"), "r": (F.col(row) % size).cast("int"), "c": (F.col(col) % size).cast("int")})


def stride_patches(cells: DataFrame, height: int, width: int, size: int, stride: int, row: str = "grid_row", col: str = "grid_col") -> DataFrame:
    """Each cell dealt to every patch (patch_row, patch_col) that covers it; patches start each stride and lie inside."""

    def starts(c: str, extent: int):
        last = (extent - size) // stride
        lo = F.greatest(F.lit(0), F.ceil((F.col(c) - size + 1) / stride)).cast("int")
        hi = F.least(F.lit(last), F.floor(F.col(c) / stride)).cast("int")
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.expr("cast(array() as array<int>)"))

    return cells.withColumn("patch_row", F.explode(starts(row, height))).withColumn("patch_col", F.explode(starts(col, width)))


def packed_windows(cells: DataFrame, value: str, radius: int = 2, key: tuple[str, str, str] = stencils.KEY) -> DataFrame:
    """A row a cell: values by position and which positions are valid."""
    return stencils.windows(cells, value, radius, key).withColumn("valid", F.transform("values", lambda x: x.isNotNull()))


def rotated_positions(side: int, turns: int) -> list[int]:
    """For each position of a side x side window, the position it takes its value from after quarter turns (counter-clockwise)."""
    at = [[r * side + c for c in range(side)] for r in range(side)]
    for _ in range(turns % 4):
        at = [[at[c][side - 1 - r] for c in range(side)] for r in range(side)]
    return [x for line in at for x in line]


def rotated(df: DataFrame, column: str, side: int, turns: int) -> DataFrame:
    return df.withColumn(column, F.array(*[F.get(column, F.lit(i)) for i in rotated_positions(side, turns)]))


def dense_grid(cells: DataFrame, by: list[str], value: str, height: int, width: int, row: str = "grid_row", col: str = "grid_col") -> DataFrame:
    """Every position of each group's grid, null where there is no cell; a cell outside fails, a repeated one too."""
    out = (F.col(row) < 0) | (F.col(row) >= height) | (F.col(col) < 0) | (F.col(col) >= width)
    c = cells.groupBy(*by, row, col).agg(F.max(value).alias(value), F.count("*").alias("__n"))
    c = c.withColumn(value, F.when(out, F.raise_error(F.lit("cell outside the grid")).cast("double")).when(F.col("__n") > 1, F.raise_error(F.lit("repeated cell")).cast("double")).otherwise(F.col(value))).drop("__n")
    kind = dict(cells.dtypes)
    steps = lambda n, t: F.explode(F.sequence(F.lit(0).cast(t), F.lit(n - 1).cast(t)))
    grid = cells.select(*by).distinct().withColumn(row, steps(height, kind[row])).withColumn(col, steps(width, kind[col]))
    return grid.join(c, [*by, row, col], "left")


def augmented(df: DataFrame, size: int, turns: int, flip: bool, aspect: str | None = None, row: str = "r", col: str = "c") -> DataFrame:
    """Coordinates of a tile after an optional left-right flip and quarter turns (counter-clockwise); aspect in degrees follows."""
    r, c = F.col(row), F.col(col)
    a = F.col(aspect) if aspect else None
    if flip:
        c = size - 1 - c
        a = F.pmod(-a, F.lit(360.0)) if aspect else None
    for _ in range(turns % 4):
        r, c = size - 1 - c, r
        a = F.pmod(a - 90.0, F.lit(360.0)) if aspect else None
    return df.withColumns({row: r, col: c, **({aspect: a} if aspect else {})})


def stream_availability(df: DataFrame, key: list[str], streams: dict[str, list[str]]) -> DataFrame:
    """Per key whether any value of each stream is there."""
    return df.groupBy(*key).agg(*[F.max(F.coalesce(*cols).isNotNull()).alias(f"has_{s}") for s, cols in streams.items()])
