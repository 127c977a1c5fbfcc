"""Spatial, as-of and interval joins as equi-joins on explicit bins, so that no plan has a nested loop over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..util import stored
from . import stencils, tiles


def seasons_with_geometry(seasons: DataFrame, geometry: DataFrame, key: str = "season_id") -> DataFrame:
    """Left join; without geometry the season is its own physical field, unverified."""
    out = seasons.join(geometry, key, "left")
    return out.withColumns({"geometry_verified": F.col("physical_field_id").isNotNull(), "physical_field_id": F.coalesce(F.col("physical_field_id").cast("string"), F.col(key).cast("string"))})


def _iou(a: str, b: str) -> Column:
    c = lambda t, n: F.col(f"{t}.{n}")
    w = F.greatest(F.lit(0), F.least(c(a, "x0") + c(a, "w"), c(b, "x0") + c(b, "w")) - F.greatest(c(a, "x0"), c(b, "x0")))
    h = F.greatest(F.lit(0), F.least(c(a, "y0") + c(a, "h"), c(b, "y0") + c(b, "h")) - F.greatest(c(a, "y0"), c(b, "y0")))
    inter = w * h
    return inter / (c(a, "w") * c(a, "h") + c(b, "w") * c(b, "h") - inter)


def overlaps(boxes: DataFrame, group: list[str], least: float = 0.1, bin_size: int = 100, key: str = "id") -> DataFrame:
    """(a, b, iou), a < b: boxes (x0, y0, w, h) of a group with at least that intersection over union.

    A box is dealt to each grid bin it touches; two boxes meet only in the bin of their intersection's lower corner, so a
    pair comes out once and needs no distinct.
    """
    span = lambda lo, size: F.sequence(F.floor(F.col(lo) / bin_size).cast("int"), F.floor((F.col(lo) + F.col(size)) / bin_size).cast("int"))
    binned = boxes.withColumn("bx", F.explode(span("x0", "w"))).withColumn("by", F.explode(span("y0", "h")))
    s = F.struct("x0", "y0", "w", "h")
    left = binned.select(*group, "bx", "by", F.col(key).alias("a"), s.alias("p"))
    right = binned.select(*group, "bx", "by", F.col(key).alias("b"), s.alias("q"))
    corner = (F.floor(F.greatest("p.x0", "q.x0") / bin_size) == F.col("bx")) & (F.floor(F.greatest("p.y0", "q.y0") / bin_size) == F.col("by"))
    return left.join(right, [*group, "bx", "by"]).filter((F.col("a") < F.col("b")) & corner).withColumn("iou", _iou("p", "q")).filter(F.col("iou") >= least).select("a", "b", "iou")


def nearest(targets: DataFrame, sources: DataFrame, cell: float, most: float, key: str = "target_id", value: str = "source_id", by: list[str] = ()) -> DataFrame:
    """(targets.*, source, distance): the nearest source point within `most` (at most the bin size), -1 where none is.

    Points are (x, y). A target looks into its own bin and the eight around it; ties go to the smallest source. Points at one place are
    one point (the smallest source of a place is its answer), so that copies of places don't multiply.
    """
    if most > cell:
        raise ValueError("the bin size must be at least the search radius")
    b = lambda c: F.floor(F.col(c) / cell).cast("long")
    s = sources.select(*by, F.col(value).alias("__s"), F.col("x").alias("__x"), F.col("y").alias("__y")).groupBy(*by, "__x", "__y").agg(F.min("__s").alias("__s"))
    s = s.withColumns({"__bx": F.floor(F.col("__x") / cell).cast("long"), "__by": F.floor(F.col("__y") / cell).cast("long")})
    around = F.sequence(F.lit(-1), F.lit(1))
    t = targets.select(*by, "x", "y").distinct()
    t = t.withColumn("__dx", F.explode(around)).withColumn("__dy", F.explode(around)).withColumns({"__bx": b("x") + F.col("__dx"), "__by": b("y") + F.col("__dy")})
    d = F.sqrt(F.pow(F.col("x") - F.col("__x"), 2) + F.pow(F.col("y") - F.col("__y"), 2))
    near = t.join(s, [*by, "__bx", "__by"]).withColumn("__d", d).filter(F.col("__d") <= most)
    best = near.groupBy(*by, "x", "y").agg(F.min(F.struct("__d", "__s")).alias("__m"))
    return targets.join(best, [*by, "x", "y"], "left").select(*targets.columns, F.coalesce("__m.__s", F.lit(-1)).alias("source"), F.col("__m.__d").alias("distance"))


def nearest_at_any_distance(targets: DataFrame, sources: DataFrame, key: str = "target_id", value: str = "source_id", by: list[str] = (), size: int = tiles.SIZE) -> DataFrame:
    """(targets.*, source, distance): the nearest source point, however far; -1 where the target's group has none. Ties go to the smallest source.

    A target first looks into its tile of sources; only tiles closer than what it finds there are looked into besides.
    """
    by = list(by)
    if not by:
        return nearest_at_any_distance(targets.withColumn("__all", F.lit(0)), sources.withColumn("__all", F.lit(0)), key, value, ["__all"], size).drop("__all")
    at = lambda df, *more: df.select(*by, *more, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna()
    # points at one place are one point: its smallest source is its answer, and a tile holds no copies
    held = at(sources, value).groupBy(*by, "x", "y").agg(F.min(value).alias(value))
    places = stored(at(targets).distinct().withColumn("__place", F.monotonically_increasing_id()))
    found = places.join(tiles.nearest_point(places, held, by, ["x", "y"], "__place", value, size), "__place").select(*by, F.col("x").alias("__x"), F.col("y").alias("__y"), "source", "distance")
    same = [targets[c] == found[c] for c in by] + [targets["x"].cast("double") == found["__x"], targets["y"].cast("double") == found["__y"]]
    return targets.join(found, same, "left").select(*[targets[c] for c in targets.columns], F.coalesce("source", F.lit(-1)).alias("source"), "distance")


def apply_mapping(mapping: DataFrame, layers: DataFrame, value: str = "source_id", layer: str = "layer") -> DataFrame:
    """Every layer through one nearest mapping; -1 stays without data."""
    return mapping.filter("source <> -1").join(layers, mapping["source"] == layers[value]).drop(value)


def latest_earlier(df: DataFrame, by: list[str], order: list[str], carry: list[str]) -> DataFrame:
    """As-of self join: each row with `prev_*` of the latest strictly earlier row (by `order[0]`) of its group."""
    at = order[0]
    w = W.partitionBy(*by).orderBy(at).rangeBetween(W.unboundedPreceding, -1) if dict(df.dtypes)[at] in ("int", "bigint") else None
    if w is not None:
        last = F.max(F.struct(*order, *carry)).over(w)
        return df.withColumn("__p", last).select("*", *[F.col(f"__p.{c}").alias(f"prev_{c}") for c in [*order, *carry]]).drop("__p")
    secs = df.withColumn("__t", F.unix_micros(F.col(at).cast("timestamp")))
    return latest_earlier(secs, by, ["__t", *order], carry).drop("__t", "prev___t")


def matched(a: DataFrame, b: DataFrame, key: list[str], tolerance: float = 1e-4) -> DataFrame:
    """Cells that two prediction sets share, (key, target, pred_a, pred_b); targets that disagree fail."""
    x = a.select(*key, "target", F.col("pred").alias("pred_a")).join(b.select(*key, F.col("target").alias("__t"), F.col("pred").alias("pred_b")), key)
    apart = F.abs(F.col("target") - F.col("__t")) > tolerance
    return x.withColumn("target", F.when(apart, F.raise_error(F.lit("targets disagree")).cast("double")).otherwise(F.col("target"))).drop("__t")


def coverage(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """One row: cells of each, shared cells and both coverages."""
    m = a.select(*key, F.lit(1).alias("a")).unionByName(b.select(*key, F.lit(1).alias("b")), allowMissingColumns=True).groupBy(*key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    g = m.agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"))
    return g.select("*", (F.col("shared") / F.col("n_a")).alias("coverage_a"), (F.col("shared") / F.col("n_b")).alias("coverage_b"))


def neighbours(cells: DataFrame, value: str, radius: int = 2, season: str = "season_id", row: str = "grid_row", col: str = "grid_col") -> DataFrame:
    """(season, row, col, k, value): the (2 radius + 1)^2 positions around each cell, null where there is no cell."""
    return stencils.windows(cells, value, radius, (season, row, col)).select(season, row, col, F.posexplode("values").alias("k", value))


def neighbourhood_mean(cells: DataFrame, value: str, radius: int = 2, extra: list[str] = (), season: str = "season_id", row: str = "grid_row", col: str = "grid_col") -> DataFrame:
    """Mean of the other cells within the box, nulls skipped; null where there are none. Seasons are told by `extra` too."""
    unit = F.struct(season, *extra) if extra else F.col(season)
    mean = stencils.box_means(cells.dropna(subset=[season, *extra]).select(unit.alias("__u"), row, col, F.col(value).alias("__x")), "__x", radius, ("__u", row, col))
    own = [F.col(f"__u.{c}") for c in (season, *extra)] if extra else [F.col("__u").alias(season)]
    return mean.select(*own, row, col, F.col("mean").alias("neighbour_mean"))


def within_radius_pairs(cells: DataFrame, values: list[str], radius: int = 5, season: str = "season_id", row: str = "grid_row", col: str = "grid_col") -> DataFrame:
    """Pairs of a season within the Chebyshev radius, each once: values a_*, b_* and distance."""
    return stencils.pairs(cells, values, radius, (season, row, col))


def relation_metric(cells: DataFrame, radius: int = 5, delta: float = 1.0, target: str = "target", pred: str = "pred") -> DataFrame:
    """Weighted mean Huber value of the error of pair differences; touching pairs weigh a half. One row a tile is shuffled, no pair."""
    p = stencils.relation_sums(cells, target, pred, radius, delta)
    return p.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.try_divide(F.sum("loss"), F.sum("weight")).alias("relation"))


def inclusive_interval_sums(series: DataFrame, daily: DataFrame, by: list[str], day: str, value: str) -> DataFrame:
    """Per dated row, the sum of daily values from the previous dated day to its own, both included, if every day is there.

    Running sums and counts over a continuous calendar answer any interval by two lookups: no range join.
    """
    w = W.partitionBy(*by).orderBy(day)
    run = daily.groupBy(*by, day).agg(F.sum(value).alias("__v"))
    run = run.select(*by, day, F.sum("__v").over(w).alias("__s"), F.count("__v").over(w).alias("__n"), F.col("__v").alias("__own"))
    s = series.withColumn("__prev", F.last(day, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)))
    at = s.join(run, [*by, day], "left")
    before = run.select(*by, F.col(day).alias("__prev"), F.col("__s").alias("__s0"), F.col("__n").alias("__n0"), F.col("__own").alias("__own0"))
    at = at.join(before, [*by, "__prev"], "left")
    days = F.datediff(F.col(day), F.col("__prev")) + 1
    full = F.col("__n") - F.col("__n0") + F.col("__own0").isNotNull().cast("int") == days
    return at.select(*by, day, F.col("__prev").alias("previous"), F.when(full, F.col("__s") - F.col("__s0") + F.col("__own0")).alias("interval_sum"))


def window_from_intervals(series: DataFrame, by: list[str], day: str, values: list[str], first: Column, last: Column, least: float = 0.5) -> DataFrame:
    """Totals of interval values prorated onto [first, last) of each unit and rescaled to it.

    A row dated t covers [previous dated day, t + 1) of t - previous + 1 days; its value is spread evenly. Null where the
    covered part is under `least`. `day` is a day number; `first` and `last` are the same in all rows of a unit.
    """
    w = W.partitionBy(*by).orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    s = series.withColumns({"__f": first.cast("double"), "__l": last.cast("double"), "__p": F.last(day, ignorenulls=True).over(w)})
    usable = F.col(day).isNotNull() & F.col("__p").isNotNull()
    for v in values:
        usable = usable & F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double"))
    ov = F.when(usable, F.greatest(F.lit(0.0), F.least(F.col(day) + 1.0, F.col("__l")) - F.greatest(F.col("__p").cast("double"), F.col("__f")))).otherwise(F.lit(0.0))
    s = s.withColumns({"__ov": ov, "__days": F.col(day) - F.col("__p") + 1})
    g = s.groupBy(*by).agg(F.first("__f").alias("__f"), F.first("__l").alias("__l"), F.sum("__ov").alias("__c"), *[F.sum(F.when(F.col("__ov") > 0, F.col(v) / F.col("__days") * F.col("__ov"))).alias(v) for v in values])
    span = F.greatest(F.col("__l") - F.col("__f"), F.lit(1e-9))
    enough = (F.col("__c") / span >= least) & (F.col("__l") > F.col("__f"))
    return g.select(*by, (F.col("__c") / span).alias("coverage"), *[F.when(enough, F.col(v) * span / F.col("__c")).alias(v) for v in values])


def with_fallback(df: DataFrame, calendar: DataFrame, key: list[str], columns: list[str], fallback: dict[str, Column], accept: Column) -> DataFrame:
    """Calendar values where a row is known and acceptable, else the fallback; `calendar_source` says which."""
    x = df.join(calendar.select(*key, *[F.col(c).alias(f"__{c}") for c in columns]), key, "left")
    ok = F.coalesce(accept, F.lit(False))
    return x.withColumns({c: F.when(ok, F.col(f"__{c}")).otherwise(fallback[c]) for c in columns}).withColumn("calendar_source", F.when(ok, F.lit("calendar")).otherwise(F.lit("fallback"))).drop(*[f"__{c}" for c in columns])


def correspondence(raster: DataFrame, cells: DataFrame, value: str, tolerance: float, row: str = "grid_row", col: str = "grid_col", by: list[str] = ()) -> DataFrame:
    """How well cells sit on a raster: shares in it, of equal values, and of equal values with rows and columns swapped (the control)."""
    r = raster.select(*by, F.col(row).alias("__r"), F.col(col).alias("__c"), F.col(value).alias("__v"))
    straight = cells.join(r, [*[cells[b] == r[b] for b in by], cells[row] == r["__r"], cells[col] == r["__c"]], "left") if by else cells.join(r, [cells[row] == r["__r"], cells[col] == r["__c"]], "left")
    swapped = cells.join(r, [*[cells[b] == r[b] for b in by], cells[row] == r["__c"], cells[col] == r["__r"]], "left")
    hit = F.coalesce(F.abs(F.col(value) - F.col("__v")) <= tolerance, F.lit(False)).cast("double")
    a = straight.agg(F.count("*").alias("cells"), F.avg(F.col("__r").isNotNull().cast("double")).alias("inside"), F.avg(hit).alias("equal"))
    b = swapped.agg(F.avg(hit).alias("equal_swapped"))
    c = r.join(cells.select(*[F.col(x).alias(f"__k{x}") for x in by], F.col(row).alias("__kr"), F.col(col).alias("__kc")), [*[F.col(x) == F.col(f"__k{x}") for x in by], F.col("__r") == F.col("__kr"), F.col("__c") == F.col("__kc")], "left_anti").agg(F.count("*").alias("uncovered"))
    return a.crossJoin(b).crossJoin(c)  # one row each


def donor_swap(df: DataFrame, stratum: list[str], season: str, order: list[str], value: str, seed: int = 0) -> DataFrame:
    """Each season takes the values of another season of its stratum, by position modulo the donor's length.

    Donors are the next season in a seeded hash order (a derangement wherever a stratum has two seasons).
    """
    sizes = df.groupBy(*stratum, season).agg(F.count("*").alias("__n"))
    w = W.partitionBy(*stratum).orderBy(F.xxhash64(F.col(season).cast("string"), F.lit(seed)), season)
    ring = sizes.withColumns({"__next": F.coalesce(F.lead(season).over(w), F.first(season).over(w)), "__size": F.coalesce(F.lead("__n").over(w), F.first("__n").over(w))})
    pos = F.row_number().over(W.partitionBy(*stratum, season).orderBy(*order)) - 1
    rows = df.withColumn("__i", pos)
    asks = rows.join(ring.select(*stratum, season, "__next", "__size"), [*stratum, season]).withColumn("__j", F.col("__i") % F.col("__size"))
    gives = rows.select(*stratum, F.col(season).alias("__next"), F.col("__i").alias("__j"), F.col(value).alias("donated"))
    return asks.join(gives, [*stratum, "__next", "__j"]).select(*df.columns, F.col("__next").alias("donor"), "donated")


def annotation_audit(estimates: DataFrame, gold: DataFrame, key: list[str]) -> DataFrame:
    """By kind: matched, unmatched gold, unknown estimates, mean absolute error and Brier score of the known."""
    x = gold.select(*key, "kind", F.col("value").alias("gold")).join(estimates.select(*key, F.col("value").alias("said"), F.lit(1).alias("__hit")), key, "left")
    e = F.col("said") - F.col("gold")
    return x.groupBy("kind").agg(F.count("__hit").alias("matched"), F.count_if(F.col("__hit").isNull()).alias("unmatched"), F.count_if(F.col("__hit").isNotNull() & F.col("said").isNull()).alias("unknown"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("brier"))


def binned_frames(frames: DataFrame, bins: DataFrame, by: list[str], value: str) -> DataFrame:
    """Every bin of every unit, with the frame's value or an empty, flagged frame; a unit without any frame fails."""
    units = frames.select(*by).distinct().crossJoin(F.broadcast(bins.select("bin")))  # bins are a calendar
    x = units.join(frames.groupBy(*by, "bin").agg(F.avg(value).alias(value)), [*by, "bin"], "left")
    n = F.count(value).over(W.partitionBy(*by))
    return x.withColumns({"is_empty": F.col(value).isNull(), "n_empty": F.when(n == 0, F.raise_error(F.lit("all frames are empty")).cast("bigint")).otherwise(F.count("*").over(W.partitionBy(*by)) - n)})


def stacked_modalities(samples: DataFrame, key: list[str], modality: str, value: str, names: list[str]) -> DataFrame:
    """One row a sample: each modality's value, zero where absent, and whether it was there."""
    p = samples.groupBy(*key).pivot(modality, names).agg(F.avg(value))
    return p.select(*key, *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names], *[F.col(n).isNotNull().alias(f"has_{n}") for n in names])


def agreeing(rows: DataFrame, reference: DataFrame, key: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """Left join with the reference's value and whether the two agree (null where it is unknown)."""
    return rows.join(reference.select(*key, F.col(value).alias(f"{value}_ref")), key, "left").withColumn("agrees", F.abs(F.col(value) - F.col(f"{value}_ref")) < tolerance)


def paired_arms(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """Differences of two arms by key; a key that only one arm has fails."""
    x = a.select(*key, F.col(value).alias("a")).join(b.select(*key, F.col(value).alias("b")), key, "full_outer")
    gone = F.col("a").isNull() | F.col("b").isNull()
    return x.withColumn("difference", F.when(gone, F.raise_error(F.lit("arms have different keys")).cast("double")).otherwise(F.col("a") - F.col("b")))


def prior_cells(cells: DataFrame, seasons: DataFrame, field: str, year: str = "year", most: float = 5.0, least: int = 200, season: str = "season_id", key: str = "cell_id") -> DataFrame:
    """(season, key, prev_season, prev_cell, distance): each cell (x, y) with the nearest cell of the latest earlier season of its field.

    Cells without one within `most` are left out, and so are seasons that keep fewer than `least` cells.
    """
    pairs = latest_earlier(seasons.select(season, field, year), [field], [year, season], []).filter(F.col(f"prev_{season}").isNotNull())
    targets = cells.select(season, key, "x", "y").join(pairs.select(season, F.col(f"prev_{season}").alias("prev_season")), season)
    sources = cells.select(F.col(season).alias("prev_season"), F.col(key).alias("source_id"), "x", "y")
    # a season may be the earlier one of several, so a target is told by its own season and cell
    mapped = nearest(targets.withColumn("target_id", F.struct(season, key)), sources, most, most, by=["prev_season"]).filter(F.col("distance").isNotNull())
    kept = mapped.withColumn("__n", F.count("*").over(W.partitionBy(season))).filter(F.col("__n") >= least)
    return kept.select(season, key, "prev_season", F.col("source").alias("prev_cell"), "distance")
