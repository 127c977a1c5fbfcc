"""Bootstraps on sufficient statistics: replicates weigh a few sums per fold or season and never touch the cells again."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..util import cut
from .ordered import in_order
from .sampling import mixed

#: Draws of a bootstrap that a task makes and counts.
DRAWS = 500_000


def multiplicities(units: DataFrame, unit: str, draws: int, by: list[str] = (), seed: int = 0) -> DataFrame:
    """(by, rep, unit, m): how often each unit is drawn in each replicate, with replacement, n of n.

    Draw d of replicate r takes the unit at place hash(r, d) modulo n of its stratum. Places come from range partitions and the draws
    are dealt over as many tasks as they need, `DRAWS` a task, so that no task makes those of a whole stratum.
    """
    placed = units.select(*by, unit).distinct()
    placed = cut(in_order(placed, list(by), [unit], {"__i": F.lit(1)}).select(*by, unit, (F.col("__i") - 1).alias("__i"), F.col("__i_total").alias("__n")))
    tasks = max(1, -(-placed.count() * draws // DRAWS))
    reps = units.sparkSession.range(draws).select(F.col("id").cast("int").alias("rep"))
    each = placed.select(*by, F.col("__i").alias("__d"), "__n").repartition(tasks).crossJoin(F.broadcast(reps))  # replicates x units: the draws themselves
    each = each.select(*by, "rep", (mixed(F.col("rep").cast("long") * 1_000_003 + F.col("__d"), seed) % F.col("__n")).alias("__i")).repartition(tasks, *by, "__i")
    drawn = each.groupBy(*by, "rep", "__i").agg(F.count("*").alias("m")).join(placed.drop("__n"), [*by, "__i"]).select(*by, "rep", unit, "m")
    return drawn.repartition(tasks, *by, unit)  # as its readers join it


def interval(values: DataFrame, by: list[str], value: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    q = F.percentile(value, F.array(F.lit(low), F.lit(high)))
    g = values.groupBy(*by).agg(F.avg(value).alias("mean"), q.alias("__q"), F.count("*").alias("replicates"))
    lo, hi = F.get("__q", F.lit(0)), F.get("__q", F.lit(1))
    return g.select(*by, "mean", lo.alias("low"), hi.alias("high"), "replicates", ((lo > 0) | (hi < 0)).alias("excludes_zero"))


def weighted_r2(stats: DataFrame, weights: DataFrame, on: list[str], by: list[str]) -> DataFrame:
    """Pooled and within-season R2 of each replicate from season statistics (n, sy, syy, sse, wsse, wsst)."""
    x = stats.join(weights, on)
    t = lambda c: F.sum(F.col("m") * F.col(c))
    g = x.groupBy(*by).agg(*[t(c).alias(c) for c in ("n", "sy", "syy", "sse", "wsse", "wsst")])
    sst = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    return g.select(*by, F.when(sst > 0, 1 - F.col("sse") / sst).alias("r2"), F.when(F.col("wsst") > 0, 1 - F.col("wsse") / F.col("wsst")).alias("r2_within"))


def paired_bootstrap(a: DataFrame, b: DataFrame, unit: str, draws: int = 2000, by: list[str] = (), seed: int = 0) -> DataFrame:
    """Difference of pooled and within-season R2 of two models' statistics, over the same replicates of units."""
    weights = multiplicities(a, unit, draws, list(by), seed)
    on = [*by, unit]
    x = weighted_r2(a, weights, on, [*by, "rep"]).withColumnsRenamed({"r2": "ra", "r2_within": "wa"})
    y = weighted_r2(b, weights, on, [*by, "rep"]).withColumnsRenamed({"r2": "rb", "r2_within": "wb"})
    d = x.join(y, [*by, "rep"]).select(*by, "rep", F.explode(F.array(F.struct(F.lit("pooled").alias("kind"), (F.col("ra") - F.col("rb")).alias("d")), F.struct(F.lit("within").alias("kind"), (F.col("wa") - F.col("wb")).alias("d")))).alias("z"))
    return interval(d.select(*by, "z.kind", "z.d"), [*by, "kind"], "d")


def mean_over_strata(a: DataFrame, b: DataFrame, unit: str, by: list[str], draws: int = 2000, seed: int = 0) -> DataFrame:
    """Interval of the mean over strata of the difference of pooled R2, strata resampled apart in each replicate."""
    weights = multiplicities(a, unit, draws, by, seed)
    x = weighted_r2(a, weights, [*by, unit], [*by, "rep"]).withColumnRenamed("r2", "ra")
    y = weighted_r2(b, weights, [*by, unit], [*by, "rep"]).withColumnRenamed("r2", "rb")
    d = x.join(y, [*by, "rep"]).groupBy("rep").agg(F.avg(F.col("ra") - F.col("rb")).alias("d"))
    return interval(d, [], "d")


def seed_averaged(stats: DataFrame, unit: str, seed_column: str, arm: str, draws: int = 2000, seed: int = 0) -> DataFrame:
    """By arm: interval of the R2 averaged over seeds within each replicate."""
    weights = multiplicities(stats, unit, draws, [], seed)
    r = weighted_r2(stats, weights, [unit], [arm, seed_column, "rep"]).groupBy(arm, "rep").agg(F.avg("r2").alias("r2"))
    return interval(r, [arm], "r2")


def difference_bootstrap(pairs: DataFrame, unit: str, value: str, draws: int = 2000, seed: int = 0) -> DataFrame:
    """Interval of the mean of paired differences over resampled units."""
    s = pairs.groupBy(unit).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    x = s.join(multiplicities(s, unit, draws, [], seed), unit).groupBy("rep").agg((F.sum(F.col("m") * F.col("s")) / F.sum(F.col("m") * F.col("n"))).alias("d"))
    return interval(x, [], "d")


def leave_one_out_blend(df: DataFrame, by: list[str], out: str, target: str, features: list[str], clip: tuple[float, float] | None = None) -> DataFrame:
    """(by, out, beta array): least squares of the target on 1 to 3 features (no intercept) over all other `out` groups.

    Sums of products by group, less the own group's, give the normal equations; they are solved per row.
    """
    k = len(features)
    names = [(f"x{i}{j}", F.sum(F.col(a) * F.col(b))) for i, a in enumerate(features) for j, b in enumerate(features) if j >= i] + [(f"y{i}", F.sum(F.col(a) * F.col(target))) for i, a in enumerate(features)]
    g = df.groupBy(*by, out).agg(*[e.alias(n) for n, e in names])
    w = W.partitionBy(*by)
    rest = g.select(*by, out, *[(F.sum(n).over(w) - F.col(n)).alias(n) for n, _ in names])

    @F.pandas_udf("array<double>")
    def solve(frame: pd.DataFrame) -> pd.Series:
        betas = []
        for r in frame.to_dict("records"):
            a = np.array([[r[f"x{min(i, j)}{max(i, j)}"] for j in range(k)] for i in range(k)], float)
            b = np.array([r[f"y{i}"] for i in range(k)], float)
            beta = np.linalg.lstsq(a, b, rcond=None)[0]
            betas.append((np.clip(beta, *clip) if clip else beta).tolist())
        return pd.Series(betas)

    return rest.select(*by, out, solve(F.struct(*[n for n, _ in names])).alias("beta"))


def blended(df: DataFrame, betas: DataFrame, on: list[str], features: list[str], out: str = "blend") -> DataFrame:
    x: Column = F.lit(0.0)
    for i, f in enumerate(features):
        x = x + F.get("beta", F.lit(i)) * F.col(f)
    return df.join(betas, on).withColumn(out, x).drop("beta")


def prior_blends(cells: DataFrame, pair: str, season: str, year: str, subsets: Column) -> DataFrame:
    """(pair, subset, method, seasons, within_r2) of blends of a season's predictions with an earlier season of the same place.

    `cells` have target, pred, prior (the earlier target) and prior_pred; `subsets` is an array of names, the same in all rows of a season.
    All are centred in the season; s is the deviation of its predictions, z(.) a z-score. M0: predictions; M1: w s z(prior); M2: M0 and M1 with a weight
    each; M3: M0 + w s z(prior less its prediction); M4: all three weighted; M5: predictions times the earlier season's slope, in [0, 3]. Weights are those of
    least squares over the pair's other years; without any the predictions stay. Everything after two passes over the cells reads sums of a year.
    """
    y, m, p, q = (F.col(c).cast("double") for c in ("target", "pred", "prior", "prior_pred"))
    rows = cells.select(pair, season, year, subsets.alias("__subsets"), y.alias("y"), m.alias("m"), p.alias("p"), (p - q).alias("r"), q.alias("q")).dropna(subset=["y", "m", "p", "q"])
    stats = rows.groupBy(season).agg(*[F.avg(c).alias(f"__a{c}") for c in "ymprq"], *[F.stddev_pop(c).alias(f"__s{c}") for c in "mpr"], F.covar_samp("p", "q").alias("__c"), F.var_pop("q").alias("__v"))
    z = lambda c: F.when(F.col(f"__s{c}") > 0, (F.col(c) - F.col(f"__a{c}")) / F.col(f"__s{c}")).otherwise(0.0) * F.col("__sm")
    slope = F.least(F.lit(3.0), F.greatest(F.lit(0.0), F.coalesce("__c", F.lit(0.0)) / F.greatest("__v", F.lit(1e-12))))
    x = cut(rows.join(stats, season).select(pair, season, year, "__subsets", (F.col("y") - F.col("__ay")).alias("y"), (F.col("m") - F.col("__am")).alias("m"), z("p").alias("f1"), z("r").alias("f2"), slope.alias("slope")))
    x = x.withColumn("rest", F.col("y") - F.col("m"))
    several = x.groupBy(pair).agg(F.min(year).alias("__low"), F.max(year).alias("__high")).filter("__low < __high").select(pair)
    fits = {"M1": (["f1"], "y"), "M2": (["m", "f1"], "y"), "M3": (["f2"], "rest"), "M4": (["m", "f1", "f2"], "y")}
    known = x.join(several, pair, "left_semi")
    weights = None
    for name, (features, target) in fits.items():
        one = leave_one_out_blend(known, [pair], year, target, features).withColumnRenamed("beta", name)
        weights = one if weights is None else weights.join(one, [pair, year])
    x = x.join(weights, [pair, year], "left")
    said = {"M0": F.col("m"), "M5": F.col("slope") * F.col("m")}
    for name, (features, _) in fits.items():
        v = sum((F.get(name, F.lit(i)) * F.col(f) for i, f in enumerate(features)), F.col("m") if name == "M3" else F.lit(0.0))
        said[name] = F.when(F.col(name).isNull(), F.col("m")).otherwise(v)
    sums = x.groupBy(pair, season).agg(F.max("__subsets").alias("__subsets"), F.sum(F.col("y") * F.col("y")).alias("sst"), *[F.sum(F.pow(v - F.col("y"), 2)).alias(n) for n, v in sorted(said.items())])
    long = sums.select(pair, F.explode("__subsets").alias("subset"), "sst", F.explode(F.array(*[F.struct(F.lit(n).alias("method"), F.col(n).alias("sse")) for n in sorted(said)])).alias("e"))
    return long.groupBy(pair, "subset", "e.method").agg(F.count("*").alias("seasons"), (1 - F.try_divide(F.sum("e.sse"), F.sum("sst"))).alias("within_r2"))
