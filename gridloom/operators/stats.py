"""Mergeable statistics, normalisers, variograms, quantile tables and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import finite
from ..util import cut
from . import stencils
from .ordered import in_order


def sufficient_stats(df: DataFrame, by: list[str], channels: list[str]) -> DataFrame:
    """Long rows (by, channel, n, s, ss, mn, mx) of the finite values: sums that merge over any set of groups."""
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), finite(F.col(c)).alias("v")) for c in channels])).alias("x")).select(*by, "x.channel", "x.v")
    return long.groupBy(*by, "channel").agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss"), F.min("v").alias("mn"), F.max("v").alias("mx"))


def normaliser(stats: DataFrame, by: list[str] = ()) -> DataFrame:
    """Mean and population deviation per channel from statistics; variance is at least 0 and a zero deviation is 1."""
    t = stats.groupBy(*by, "channel").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    mean = F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(F.lit(0.0))
    std = F.sqrt(F.greatest(F.lit(0.0), F.when(F.col("n") > 0, F.col("ss") / F.col("n")).otherwise(F.lit(0.0)) - mean * mean))
    return t.select(*by, "channel", "n", mean.alias("mean"), F.when(std > 0, std).otherwise(F.lit(1.0)).alias("std"))


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long rows (channel, mean, std): nulls skipped, an empty column has mean 0, zero deviation is 1."""
    one = df.agg(*[x for c in columns for x in (F.coalesce(F.avg(finite(F.col(c))), F.lit(0.0)).alias(f"{c}__m"), F.coalesce(F.stddev_pop(finite(F.col(c))), F.lit(0.0)).alias(f"{c}__s"))])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"{c}__m").alias("mean"), F.when(F.col(f"{c}__s") > 0, F.col(f"{c}__s")).otherwise(1.0).alias("std")) for c in columns])).alias("x"))
    return rows.select("x.*")


def repaired(stats: DataFrame) -> DataFrame:
    """Supplied statistics with any null, non-finite or non-positive deviation as 1."""
    return stats.withColumn("std", F.when(finite(F.col("std")) > 0, F.col("std")).otherwise(F.lit(1.0)))


def standardise(df: DataFrame, stats: DataFrame, columns: list[str], fill: float | None = 0.0, reverse: bool = False) -> DataFrame:
    """Columns scaled by a (channel, mean, std) table, which has a row per channel; missing values get `fill`."""
    wide = stats.groupBy().agg(*[F.max(F.when(F.col("channel") == c, F.struct("mean", "std"))).alias(f"__{c}") for c in columns])
    out = df.crossJoin(F.broadcast(wide))  # one row
    for c in columns:
        m, s = F.col(f"__{c}.mean"), F.col(f"__{c}.std")
        z = finite(F.col(c)) * s + m if reverse else (finite(F.col(c)) - m) / s
        out = out.withColumn(c, z if fill is None else F.coalesce(z, F.lit(fill)))
    return out.select(*df.columns)


def semivariogram(cells: DataFrame, value: str = "target", season: str = "season_id", row: str = "grid_row", col: str = "grid_col", lags: int = 30) -> DataFrame:
    """(season, h, gamma_sum, n_pairs) along rows and columns, hole-safe: sums of square tiles with halos, added up a season.

    Differences need no centring; but a value that isn't finite has no mean, and leaves its season's sums NaN.
    """
    sums = stencils.lag_sums(cells, value, lags, (season, row, col)).groupBy(season, "h").agg(F.sum("d").alias("d"), F.sum("n").alias("n_pairs"), F.max("odd").alias("odd"))
    odd = F.max("odd").over(W.partitionBy(season))  # a row a lag
    return sums.withColumn("odd", odd).filter("n_pairs > 0").select(season, "h", F.when(F.col("odd"), F.lit(float("nan"))).otherwise(F.col("d") / 2).alias("gamma_sum"), "n_pairs")


def nugget(variogram: DataFrame, variance: DataFrame, by: list[str]) -> DataFrame:
    """Noise ceiling: the intercept (at least 0) of a line through the first three lags, and 1 - nugget / variance."""
    g = variogram.filter("h <= 3").groupBy(*by, "h").agg((F.sum("gamma_sum") / F.sum("n_pairs")).alias("gamma"))
    fit = g.groupBy(*by).agg(F.greatest(F.lit(0.0), F.regr_intercept("gamma", F.col("h").cast("double"))).alias("nugget"))
    return fit.join(variance, by).select(*by, "nugget", "variance", (1 - F.col("nugget") / F.col("variance")).alias("ceiling"))


def weighted_quantiles(df: DataFrame, value: str, stratum: list[str], season: str = "season_id", points: int = 101, least: int = 20) -> DataFrame:
    """(stratum, q, value): quantiles in which every season weighs one, by linear interpolation of the mid-cumulated weights.

    Strata under `least` seasons are left out. The running weight comes from range partitions of the distinct values, so that no task holds a
    stratum or a season.
    """
    v = df.select(*stratum, season, finite(F.col(value)).alias("v"))
    m = v.groupBy(*stratum, season).agg(F.count("*").alias("m"), F.count("v").alias("__k"))
    enough = m.filter("__k > 0").groupBy(*stratum).agg(F.count("*").alias("__s")).filter(F.col("__s") >= least).drop("__s")
    counts = v.filter("v is not null").groupBy(*stratum, season, "v").agg(F.count("*").alias("c"))
    d = counts.join(m.join(enough, stratum, "left_semi"), [*stratum, season]).groupBy(*stratum, "v").agg(F.sum(F.col("c") / F.col("m")).alias("w"), F.sum("c").alias("c"))
    half = F.col("w") / F.col("c") / 2
    d = in_order(d, stratum, ["v"], {"run": F.col("w"), "at": F.lit(1)}, {"next_v": F.col("v"), "next_half": half})
    # the first and last occurrence of a tied value stand at different places; values between two places are interpolated
    total = F.col("run_total")
    d = d.withColumns({"lo": (F.col("run") - F.col("w") + half) / total, "hi": (F.col("run") - half) / total, "next_lo": (F.col("run") + F.col("next_half")) / total, "first": F.col("at") == 1})
    # only the points around a value's span, so that values don't meet all points
    begin = F.when(F.col("first"), F.lit(0)).otherwise(F.greatest(F.lit(0), F.floor(F.col("lo") * (points - 1)).cast("int")))
    end = F.when(F.col("next_lo").isNull(), F.lit(points - 1)).otherwise(F.least(F.lit(points - 1), F.ceil(F.col("next_lo") * (points - 1)).cast("int")))
    q = F.explode(F.transform(F.sequence(F.least(begin, end), end), lambda k: F.struct(k.alias("k"), (k / (points - 1)).alias("q"))))
    hit = d.select("*", q.alias("x")).select("*", "x.k", "x.q")
    # each q belongs to the value whose span [lo, next lo) holds it, or to the ends; a value's lo and the next lo of the one before are sums in
    # different orders, so a q on the border may seem to lie in neither or in both: the first value whose next lo lies beyond takes it
    inside = (F.col("q") >= F.col("lo") - 1e-9) & (F.col("next_lo").isNull() | (F.col("q") < F.col("next_lo"))) | F.col("first") & (F.col("q") < F.col("lo"))
    x = F.when((F.col("q") <= F.col("hi")) | F.col("next_v").isNull(), F.col("v")).otherwise(F.col("v") + (F.col("q") - F.col("hi")) / (F.col("next_lo") - F.col("hi")) * (F.col("next_v") - F.col("v")))
    found = hit.filter(inside).groupBy(*stratum, "k").agg(F.min_by(F.struct(x.alias("value")), "v").alias("x"))
    return found.select(*stratum, "k", "x.value")


def mid_rank(df: DataFrame, grids: DataFrame, value: str, stratum: list[str], out: str, inverse: bool = False) -> DataFrame:
    """Percentile of each value in its stratum's sorted grid, ties at the middle of their span; null where none is known."""
    g = grids.groupBy(*stratum).agg(F.array_sort(F.collect_list("value")).alias("__g"))  # a grid of fixed length a stratum
    below = F.size(F.filter("__g", lambda x: x < F.col(value)))
    upto = F.size(F.filter("__g", lambda x: x <= F.col(value)))
    r = F.when(F.col(value).isNotNull() & F.col("__g").isNotNull(), (below + upto) / (2 * F.size("__g")))
    return df.join(g, stratum, "left").withColumn(out, 1 - r if inverse else r).drop("__g")


def slot_dates(obs: DataFrame, unit: list[str], day: str, valid: Column, present: DataFrame) -> DataFrame:
    """Per unit and slot: median day, spread of days and coverage relative to the unit's cells."""
    g = obs.filter(valid & F.col(day).isNotNull()).groupBy(*unit, "slot").agg(F.median(day).alias("median_day"), (F.max(day) - F.min(day)).alias("spread"), F.count("*").alias("n"))
    return g.join(present, unit).select(*unit, "slot", "median_day", "spread", (F.col("n") / F.col("cells")).alias("coverage"))


def qualifying(dates: DataFrame, least_coverage: float = 0.25, most_spread: float = 1.0) -> DataFrame:
    return dates.filter((F.col("coverage") >= least_coverage) & (F.col("spread") <= most_spread) & F.col("median_day").isNotNull())


def date_coherence(dates: DataFrame, most_spread: float = 1.0) -> DataFrame:
    return dates.agg(F.count("*").alias("slots"), F.avg((F.col("spread") > most_spread).cast("double")).alias("incoherent"))


def table_audit(df: DataFrame, key: list[str], target: str = "target") -> DataFrame:
    """One row: rows, distinct keys, repeated keys, missing, -1 and non-positive targets, and five percentiles."""
    y = F.col(target)
    values = df.groupBy(finite(y).alias("__y")).agg(F.count("*").alias("__c"), F.count_if(y == -1).alias("__m"), F.count_if(y <= 0).alias("__p"))
    values = cut(values)
    repeats = df.groupBy(*key).agg(F.count("*").alias("__n")).agg(F.count("*").alias("keys"), F.count_if(F.col("__n") > 1).alias("repeated_keys"))
    facts = values.agg(F.sum("__c").alias("rows"), F.sum(F.when(F.col("__y").isNull(), F.col("__c"))).alias("missing"), F.sum("__m").alias("minus_one"), F.sum("__p").alias("not_positive"))
    facts = facts.select(*[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in facts.columns])
    found = quantiles_of_counts(values.filter("__y is not null"), "__y", "__c", (0.0, 0.01, 0.5, 0.99, 1.0))
    return facts.crossJoin(repeats).crossJoin(found).select("rows", "keys", "repeated_keys", "missing", "minus_one", "not_positive", *[f"p{k}" for k in range(5)])  # one row each


def quantiles_of_counts(values: DataFrame, value: str, count: str, shares: tuple[float, ...]) -> DataFrame:
    """One row p0, p1, ..: exact interpolated quantiles of distinct values with their counts, by running counts over range partitions; null without values."""
    x = in_order(values.select(F.col(value).alias("v"), F.col(count).alias("c")), [], ["v"], {"__to": F.col("c")})
    inside = lambda at: F.max(F.when((at >= F.col("__to") - F.col("c")) & (at < F.col("__to")), F.col("v")))
    out = []
    for k, share in enumerate(shares):
        at = (F.col("__to_total") - 1) * F.lit(float(share))
        out += [inside(F.floor(at)).alias(f"a{k}"), inside(F.ceil(at)).alias(f"b{k}"), F.max(at - F.floor(at)).alias(f"w{k}")]
    mixed = [F.when(F.col(f"w{k}") == 0, F.col(f"a{k}")).otherwise(F.col(f"a{k}") * (1 - F.col(f"w{k}")) + F.col(f"b{k}") * F.col(f"w{k}")).alias(f"p{k}") for k in range(len(shares))]
    return x.agg(*out).select(*mixed)


def interval_audit(obs: DataFrame, unit: list[str], day: str, value: str) -> DataFrame:
    """By length of the interval since the unit's previous dated row: rows, flat ones, and quartiles of the value per day."""
    w = W.partitionBy(*unit).orderBy(day, value)
    d = obs.withColumns({"__dt": F.datediff(F.col(day), F.lag(day).over(w)), "__before": F.lag(value).over(w)}).filter("__dt is not null")
    q = F.percentile(F.col(value) / F.greatest(F.col("__dt"), F.lit(1)), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = d.groupBy(F.col("__dt").alias("dt")).agg(F.count("*").alias("n"), F.avg((F.col(value) == F.col("__before")).cast("double")).alias("flat"), q.alias("q"))
    return g.select("dt", "n", "flat", *[F.get("q", F.lit(k)).alias(f"q{k + 1}") for k in range(3)])


def effective_rank(df: DataFrame, vector: str) -> DataFrame:
    """exp of the entropy of the covariance spectrum and the share of the first component, over all vectors."""
    import numpy as np

    dims = df.select(F.max(F.size(vector))).first()[0] or 0
    v = df.select(F.transform(vector, lambda x: x.cast("double")).alias("v"))
    # sums of products of a fixed number of dimensions, merged map-side
    sums = v.agg(F.count("*").alias("n"), *[F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(dims)])
    cross = v.select(F.posexplode("v").alias("i", "x"), "v").select("i", F.transform("v", lambda y: y * F.col("x")).alias("r"))
    rows = cross.groupBy("i").agg(*[F.sum(F.get("r", F.lit(j))).alias(f"c{j}") for j in range(dims)]).orderBy("i").collect() if dims else []  # dims x dims
    n, *s = sums.first()
    c = np.array([list(r)[1:] for r in rows], float).reshape(len(rows), dims)
    m = np.array(s, float) / max(n, 1)
    e = np.clip(np.linalg.eigvalsh(c / max(n, 1) - np.outer(m, m)), 0, None) if dims else np.zeros(0)
    p = e / e.sum() if e.sum() > 0 else e
    rank = float(np.exp(-(p[p > 0] * np.log(p[p > 0])).sum())) if p.sum() > 0 else 0.0
    return df.sparkSession.createDataFrame([(int(n), rank, float(p.max()) if len(p) else 0.0)], "n long, effective_rank double, top_share double")


def relation_alignment(a: Column, b: Column, rule: Column) -> Column:
    """Cosine of the normalised difference of two vectors with a rule's vector; null where either is zero."""
    diff = F.zip_with(a, b, lambda x, y: x.cast("double") - y)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    r = F.transform(rule, lambda x: x.cast("double"))
    return F.when((dot(diff, diff) > 0) & (dot(r, r) > 0), dot(diff, r) / F.sqrt(dot(diff, diff) * dot(r, r)))


def statistics_for(policy: str, train: DataFrame, supplied: DataFrame | None = None, test: DataFrame | None = None) -> DataFrame | None:
    """Which (channel, mean, std) table a policy uses: train, supplied (repaired), test, or none for no scaling."""
    if policy == "none":
        return None
    tables = {"train": train, "supplied": None if supplied is None else repaired(supplied), "test": test}
    if policy not in tables or tables[policy] is None:
        raise ValueError(f"no statistics for policy {policy}")
    return tables[policy]


def cache_audit(df: DataFrame, key: list[str], channels: list[str], day: str, limits: dict[str, float] = {}) -> DataFrame:  # noqa: B006
    """Counters of a canonical table in one pass: rows, units, undated rows, missing and over-limit values per channel."""
    counts = [x for c in channels for x in (F.count_if(finite(F.col(c)).isNull()).alias(f"missing_{c}"), F.count_if(F.coalesce(F.abs(finite(F.col(c))) > limits.get(c, 1.7e308), F.lit(False))).alias(f"over_{c}"))]
    units = df.select(*key).distinct().agg(F.count("*").alias("units"))
    return df.agg(F.count("*").alias("rows"), F.count_if(F.col(day).isNull()).alias("undated"), *counts).crossJoin(units)  # one row each


def dense_field_stats(obs: DataFrame, by: list[str], channels: list[str], saturated: float = 65504.0) -> DataFrame:
    """Statistics of a dense series after values over the half-float range are dropped; their count comes along."""
    over = {c: F.when(finite(F.col(c)) <= saturated, F.col(c)) for c in channels}
    n = obs.groupBy(*by).agg(F.sum(sum((F.coalesce(finite(F.col(c)) > saturated, F.lit(False)).cast("int") for c in channels), F.lit(0))).alias("saturated"))
    return sufficient_stats(obs.withColumns(over), by, channels).join(n, by)
