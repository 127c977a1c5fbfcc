"""Sequence operators: dated slots, composites, ranks, runs and best-of selections."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import stencils


def first_dated(df: DataFrame, by: list[str], slot: str, day: str, out: str = "first_slot") -> DataFrame:
    return df.withColumn(out, F.min(F.when(F.col(day).isNotNull(), F.col(slot))).over(W.partitionBy(*by)))


def previous_dated(df: DataFrame, by: list[str], slot: list[str], day: str, out: str = "previous_day") -> DataFrame:
    return df.withColumn(out, F.last(day, ignorenulls=True).over(W.partitionBy(*by).orderBy(*slot).rowsBetween(W.unboundedPreceding, -1)))


def temporal_validity(df: DataFrame, by: list[str], channels: list[str], weather: list[str], slot: str = "slot", day: str = "obs_day", keep_first_weather: bool = False) -> DataFrame:
    """Values on undated slots are null, and so is weather at a unit's first dated slot, which has no known beginning."""
    d = first_dated(df, by, slot, day, "__first")
    dated = F.col(day).isNotNull()
    ok = {c: dated & ~F.isnan(F.col(c).cast("double")) for c in channels}
    ok |= {c: dated & ~F.isnan(F.col(c).cast("double")) & (F.lit(keep_first_weather) | (F.col(slot) > F.col("__first"))) for c in weather}
    return d.withColumns({c: F.when(k, F.col(c)) for c, k in ok.items()}).drop("__first")


def static_validity(df: DataFrame, channels: list[str], bounds: dict[str, float] = {"curvature": 1000.0}) -> DataFrame:  # noqa: B006
    """Finite values within bounds, else null."""
    ok = lambda c: ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) <= F.lit(bounds.get(c, 1.7e308)))
    return df.withColumns({c: F.when(ok(c), F.col(c)) for c in channels})


def before_cutoff(day: Column, mode: str, seeding: Column, harvest: Column, days: int = 0) -> Column:
    """Whether an observation is visible: before_harvest and after_seeding by a number of days, harvest, or all_slots."""
    if mode == "all_slots":
        return F.lit(True)
    limits = {"before_harvest": harvest - days, "harvest": harvest, "after_seeding": seeding + days}
    if mode not in limits:
        raise ValueError(f"unsupported cutoff mode {mode}")
    return day <= limits[mode]


def canonical(df: DataFrame, by: list[str], static: list[str], slot: str = "slot", day: str = "obs_day", atol: float = 1e-6, rtol: float = 1e-5) -> DataFrame:
    """One row a unit: each static channel's first finite value, and flags: 1 conflict, 2 missing, 4 no dated slot."""
    v = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    g = df.groupBy(*by).agg(
        *[F.min_by(v(c), F.when(v(c).isNotNull(), F.col(slot))).alias(c) for c in static],
        *[F.min(v(c)).alias(f"__lo_{c}") for c in static], *[F.max(v(c)).alias(f"__hi_{c}") for c in static], F.count(day).alias("__dated"),
    )
    conflict = missing = F.lit(False)
    for c in static:
        tol = F.lit(atol) + F.lit(rtol) * F.abs(F.col(c))
        conflict = conflict | F.coalesce(F.greatest(F.col(f"__hi_{c}") - F.col(c), F.col(c) - F.col(f"__lo_{c}")) > tol, F.lit(False))
        missing = missing | F.col(c).isNull()
    flags = conflict.cast("int") + missing.cast("int") * 2 + (F.col("__dated") == 0).cast("int") * 4
    return g.select(*by, *static, flags.alias("flags"))


def inverse_rank(df: DataFrame, by: list[str], order: list[str], out: str = "low_rank") -> DataFrame:
    """1 - position / (n - 1) within the group, ties by the further order columns; null for a single row."""
    n = F.count("*").over(W.partitionBy(*by))
    i = F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1
    return df.withColumn(out, F.when(n > 1, 1 - i / (n - 1)))


def clipped_z(df: DataFrame, by: list[str], value: str, out: str = "z", clip: float = 5.0, least: int = 3) -> DataFrame:
    w = W.partitionBy(*by)
    m, s, n = F.avg(value).over(w), F.stddev_pop(value).over(w), F.count(value).over(w)
    return df.withColumn(out, F.when((n >= least) & (s > 0), F.greatest(F.lit(-clip), F.least(F.lit(clip), (F.col(value) - m) / s))))


def terrain_position(df: DataFrame, by: list[str], dem: str, order: list[str]) -> DataFrame:
    """Within-field anomaly, relief (p95 - p5) and low rank of elevation; null under two finite values."""
    ok = df.filter(F.col(dem).isNotNull())
    relief = ok.groupBy(*by).agg((F.percentile(dem, F.lit(0.95)) - F.percentile(dem, F.lit(0.05))).alias("relief"), F.count("*").alias("__n")).filter("__n >= 2").drop("__n")
    ranked = inverse_rank(ok.withColumn("anomaly", F.col(dem) - F.avg(dem).over(W.partitionBy(*by))), by, [dem, *order])
    return ranked.join(relief, by)


def best_per(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group by the order."""
    return df.withColumn("__i", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter("__i = 1").drop("__i")


def best_acquisition(df: DataFrame, by: list[str], clear: str, cloud: str, day: str, key: str, values: list[str]) -> DataFrame:
    """Per group the clear row of least cloud, then the latest, then by id; without a clear one the least cloudy, values nulled."""
    best = best_per(df, by, [F.col(clear).desc(), F.col(cloud), F.col(day).desc(), F.col(key)])
    return best.withColumns({v: F.when(F.col(clear) == 1, F.col(v)) for v in values})


def nearest_to_centre(df: DataFrame, by: list[str], distance: Column, then: list[str], values: list[str]) -> DataFrame:
    """Composite: per group the row of the smallest distance, then of the smallest `then` columns. One aggregation, no sort."""
    g = df.withColumn("__d", distance).groupBy(*by).agg(F.min_by(F.struct(*values), F.struct("__d", *then)).alias("__v"), F.count("*").alias("n_candidates"))
    return g.select(*by, "__v.*", "n_candidates")


def spread_observations(df: DataFrame, by: list[str], fraction: str, coverage: str, k: int, tie: list[str]) -> DataFrame:
    """At most k rows: the best coverage of each of k equal bins of the fraction, filled up by the best of the rest."""
    b = F.least(F.lit(k - 1), F.greatest(F.lit(0), F.floor(F.col(fraction) * k))).cast("int")
    order = [F.col(coverage).desc(), *map(F.col, tie)]
    x = df.withColumn("__b", b).withColumn("__first", F.row_number().over(W.partitionBy(*by, "__b").orderBy(*order)) == 1)
    x = x.withColumn("__i", F.row_number().over(W.partitionBy(*by).orderBy(F.col("__first").desc(), *order)))
    return x.filter(F.col("__i") <= k).drop("__b", "__first", "__i")


def runs(df: DataFrame, order: list[str], key: str, by: list[str]) -> DataFrame:
    """Gaps and islands: (by, run, key, n, first, last) for runs of equal keys within `by`."""
    w = W.partitionBy(*by).orderBy(*order)
    change = F.coalesce(F.lag(key).over(w) != F.col(key), F.lit(True)).cast("int")
    x = df.withColumn("__new", change).withColumn("run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return x.groupBy(*by, "run", key).agg(F.count("*").alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def first_crossing(df: DataFrame, by: list[str], text: str, week: str, level: float = 50.0) -> DataFrame:
    """The earliest week whose text reads as a number (thousands commas removed) of at least the level."""
    v = F.regexp_replace(text, ",", "").try_cast("double")
    return df.groupBy(*by).agg(F.min(F.when(v >= level, F.col(week))).alias("week"))


def edge_distance(cells: DataFrame, cap: int = 50, season: str = "season_id", row: str = "grid_row", col: str = "grid_col") -> DataFrame:
    """Chebyshev distance of each cell to the nearest position without a cell, less one, at most `cap`; and its log scale."""
    out = stencils.full_squares(cells, cap, (season, row, col))
    return out.withColumn("edge_scaled", F.log1p("edge") / F.lit(math.log1p(cap)))


def last_valid(df: DataFrame, by: list[str], slot: str, valid: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.max(F.when(valid, F.col(slot))).alias("last_slot"))


def carried_forward(df: DataFrame, by: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    return df.withColumn(out, F.last(value, ignorenulls=True).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def interval_lengths(df: DataFrame, by: list[str], slot: list[str], day: str, out: str = "interval") -> DataFrame:
    """Days since the row before, where both are dated."""
    return df.withColumn(out, F.datediff(F.col(day), F.lag(day).over(W.partitionBy(*by).orderBy(*slot))))


def block_mean(df: DataFrame, value: str, k: int, by: list[str], row: str = "grid_row", col: str = "grid_col", out: str = "block_mean") -> DataFrame:
    """Mean of the aligned k x k block, written back to its cells."""
    return df.withColumn(out, F.avg(value).over(W.partitionBy(*by, F.floor(F.col(row) / k), F.floor(F.col(col) / k))))


def alternate(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Every second row of a group, the first included."""
    return df.withColumn("__i", F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1).filter("__i % 2 = 0").drop("__i")
