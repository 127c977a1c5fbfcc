"""Regression metrics as mergeable aggregates: one scan, partial sums, everything after that on few rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import finite
from .ordered import in_order


def pairs(df: DataFrame, target: str = "target", pred: str = "pred") -> DataFrame:
    """Rows with a finite target and prediction, as doubles y and p."""
    return df.withColumns({"y": finite(F.col(target)), "p": finite(F.col(pred))}).filter("y is not null and p is not null")


def metric_columns(y: str = "y", p: str = "p") -> list[Column]:
    """n, rmse, mae, bias, r2 = 1 - SSE / SST (null without variance) and squared Pearson r."""
    e = F.col(p) - F.col(y)
    sst = F.count("*") * F.var_pop(y)
    return [
        F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"),
        F.when(sst > 0, 1 - F.sum(e * e) / sst).alias("r2"), F.pow(F.corr(y, p), 2).alias("pearson2"),
    ]


def regression_metrics(df: DataFrame, by: list[str] = (), target: str = "target", pred: str = "pred") -> DataFrame:
    return pairs(df, target, pred).groupBy(*by).agg(*metric_columns())


def field_balanced(df: DataFrame, by: list[str] = (), season: str = "season_id", target: str = "target", pred: str = "pred") -> DataFrame:
    """Mean over seasons of the season's rmse and mae."""
    each = regression_metrics(df, [*by, season], target, pred)
    return each.groupBy(*by).agg(F.count("*").alias("n_seasons"), F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae"))


def field_level(df: DataFrame, by: list[str] = (), season: str = "season_id", target: str = "target", pred: str = "pred") -> DataFrame:
    """Metrics over the season means."""
    means = pairs(df, target, pred).groupBy(*by, season).agg(F.avg("y").alias("y"), F.avg("p").alias("p"))
    return means.groupBy(*by).agg(*metric_columns())


def grouping_metrics(df: DataFrame, first: str = "country", second: str = "crop", target: str = "target", pred: str = "pred") -> DataFrame:
    """Metrics overall, by each grouping and by both, in one pass (grouping sets)."""
    m = pairs(df, target, pred).cube(first, second).agg(F.grouping_id().alias("level"), *metric_columns())
    return m.select(F.coalesce(first, F.lit("all")).alias(first), F.coalesce(second, F.lit("all")).alias(second), "level", "n", "rmse", "mae", "bias", "r2", "pearson2")


def macro_mean(metrics: DataFrame, by: str = "country") -> DataFrame:
    """Unweighted mean of the per-group rows of `grouping_metrics`."""
    return metrics.filter("level = 1").agg(F.count("*").alias("n_groups"), F.avg("rmse").alias("rmse"), F.avg("r2").alias("r2"))


def fold_statistics(df: DataFrame, by: list[str], target: str = "target", pred: str = "pred") -> DataFrame:
    """Additive statistics: n, sum of y, of its square, of the squared error."""
    e = F.col("p") - F.col("y")
    return pairs(df, target, pred).groupBy(*by).agg(F.count("*").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"), F.sum(e * e).alias("sse"))


def r2_of(stats: DataFrame, by: list[str] = (), weight: str | None = None) -> DataFrame:
    """R2 of any multiset of folds, from their statistics alone."""
    w = F.col(weight) if weight else F.lit(1)
    total = lambda c: F.sum(w * F.col(c))
    sst = total("syy") - total("sy") * total("sy") / total("n")
    return stats.groupBy(*by).agg(total("n").alias("n"), F.when(sst > 0, 1 - total("sse") / sst).alias("r2"))


def fold_summary(df: DataFrame, fold: str, by: list[str] = (), target: str = "target", pred: str = "pred") -> DataFrame:
    """Mean and population deviation over folds next to the pooled value, which is not their mean."""
    folds = regression_metrics(df, [*by, fold], target, pred).groupBy(*by).agg(F.count("*").alias("folds"), F.avg("r2").alias("r2_mean"), F.stddev_pop("r2").alias("r2_std"), F.avg("rmse").alias("rmse_mean"), F.stddev_pop("rmse").alias("rmse_std"))
    pooled = regression_metrics(df, list(by), target, pred).select(*by, F.col("n"), F.col("r2").alias("r2_pooled"), F.col("rmse").alias("rmse_pooled"))
    return folds.join(pooled, list(by)) if by else folds.crossJoin(pooled)  # one row each


def refuse_repeats(df: DataFrame, key: list[str], what: str = "cell in two folds") -> DataFrame:
    """`df`, failing at run time if a key occurs twice."""
    n = F.count("*").over(W.partitionBy(*key))
    return df.withColumn("__n", n).withColumn("__ok", F.when(F.col("__n") > 1, F.raise_error(F.lit(what))).otherwise(F.lit(0))).filter(F.coalesce(F.col("__ok"), F.lit(0)) == 0).drop("__n", "__ok")


def diagnostics(df: DataFrame, fold: str, target: str = "target", pred: str = "pred") -> DataFrame:
    """Per fold: bias, its share of the MSE, R2 without it, R2 of the mean of the other folds, deviations against the pool."""
    d = pairs(df, target, pred)
    e = F.col("p") - F.col("y")
    per = d.groupBy(fold).agg(
        F.count("*").alias("n"), F.sum("y").alias("sy"), F.avg("y").alias("my"), F.var_pop("y").alias("vy"), F.avg(e).alias("bias"),
        F.avg(e * e).alias("mse"), F.stddev_pop("p").alias("sp"),
    )
    pool = d.agg(F.count("*").alias("tn"), F.sum("y").alias("ty"), F.stddev_pop("y").alias("ts"))
    x = per.crossJoin(F.broadcast(pool))  # one row
    ratio = F.try_divide
    rest = ratio(F.col("ty") - F.col("sy"), F.col("tn") - F.col("n"))
    return x.select(
        fold, "n", "bias", ratio(F.col("bias") * F.col("bias"), F.col("mse")).alias("bias_share"), (1 - ratio(F.col("mse"), F.col("vy"))).alias("r2"),
        (1 - ratio(F.col("mse") - F.col("bias") * F.col("bias"), F.col("vy"))).alias("r2_unbiased"), ratio(-(rest - F.col("my")) * (rest - F.col("my")), F.col("vy")).alias("r2_mean_of_rest"),
        ratio(F.sqrt("vy"), F.col("ts")).alias("std_share"), ratio(F.col("sp"), F.sqrt("vy")).alias("pred_std_ratio"),
    )


def within_field(df: DataFrame, by: list[str] = (), season: str = "season_id", least: int = 3, target: str = "target", pred: str = "pred") -> DataFrame:
    """Metrics after centring target and prediction on their season: ratio of sums, medians of seasons, share of variance."""
    s = field_sums(df, [*by, season], target, pred).filter(F.col("n") >= least)
    total = s.groupBy(*by).agg(F.sum("sy").alias("sy"), F.sum("syy").alias("syy"), F.sum("n").alias("n"), F.sum("wsst").alias("wsst"), F.sum("wsse").alias("wsse"), F.median(F.when(F.col("wsst") > 0, 1 - F.col("wsse") / F.col("wsst"))).alias("r2_median"), F.median(F.when((F.col("wsst") > 0) & (F.col("wspp") > 0), F.col("wspy") / F.sqrt(F.col("wsst") * F.col("wspp")))).alias("r_median"), F.median(F.when(F.col("wsst") > 0, F.sqrt(F.col("wspp") / F.col("wsst")))).alias("std_ratio_median"), F.count("*").alias("seasons"))
    return total.select(*by, "seasons", "n", F.when(F.col("wsst") > 0, 1 - F.col("wsse") / F.col("wsst")).alias("r2_within"), "r2_median", "r_median", "std_ratio_median", F.try_divide(F.col("wsst"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")).alias("within_share"))


def field_sums(df: DataFrame, by: list[str], target: str = "target", pred: str = "pred") -> DataFrame:
    """Additive statistics of a season, pooled and centred: n, sy, sp, syy, spp, spy, sse, wsst, wspp, wspy, wsse."""
    y, p = F.col("y"), F.col("p")
    s = pairs(df, target, pred).groupBy(*by).agg(F.count("*").alias("n"), F.sum(y).alias("sy"), F.sum(p).alias("sp"), F.sum(y * y).alias("syy"), F.sum(p * p).alias("spp"), F.sum(p * y).alias("spy"), F.sum((p - y) * (p - y)).alias("sse"))
    c = lambda a, b, ab: F.col(ab) - F.col(a) * F.col(b) / F.col("n")
    s = s.withColumns({"wsst": F.greatest(F.lit(0.0), c("sy", "sy", "syy")), "wspp": F.greatest(F.lit(0.0), c("sp", "sp", "spp")), "wspy": c("sp", "sy", "spy")})
    return s.withColumn("wsse", F.greatest(F.lit(0.0), F.col("wsst") + F.col("wspp") - 2 * F.col("wspy")))


def variance_match(df: DataFrame, season: str = "season_id", target: str = "target", pred: str = "pred") -> DataFrame:
    """Per season with 3 cells or more: squared difference of the sample deviations."""
    d = pairs(df, target, pred).groupBy(season).agg(F.count("*").alias("n"), F.stddev_samp("p").alias("sp"), F.stddev_samp("y").alias("sy")).filter("n >= 3")
    return d.select(season, "n", ((F.col("sp") - F.col("sy")) * (F.col("sp") - F.col("sy"))).alias("variance_gap"))


def zone_table(df: DataFrame, by: list[str], zones: int = 4, target: str = "target", pred: str = "pred") -> DataFrame:
    """`df` with true_zone and pred_zone by the target's quantiles within the group."""
    cuts = F.array(*[F.lit(k / zones) for k in range(1, zones)])
    d = pairs(df, target, pred)
    q = d.groupBy(*by).agg(F.percentile("y", cuts).alias("__q"))
    zone = lambda c: F.aggregate("__q", F.lit(0), lambda a, b: a + (F.col(c) >= b).cast("int"))
    return d.join(q, by).withColumns({"true_zone": zone("y"), "pred_zone": zone("p")}).drop("__q")


def zone_preservation(zoned: DataFrame, by: list[str]) -> DataFrame:
    return zoned.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col("true_zone") == F.col("pred_zone")).cast("double")).alias("preserved"))


def confusion(zoned: DataFrame) -> DataFrame:
    return zoned.groupBy("true_zone", "pred_zone").agg(F.count("*").alias("n"))


def confusion_scores(matrix: DataFrame) -> DataFrame:
    """Per class: precision over what was predicted so, recall over what is so, F1, IoU; with the overall accuracy."""
    t = matrix.groupBy(F.col("true_zone").alias("zone")).agg(F.sum("n").alias("is"), F.sum(F.when(F.col("true_zone") == F.col("pred_zone"), F.col("n")).otherwise(0)).alias("hit"))
    p = matrix.groupBy(F.col("pred_zone").alias("zone")).agg(F.sum("n").alias("said"))
    x = t.join(p, "zone", "full_outer").na.fill(0)
    all_ = W.partitionBy()  # a row a class
    ratio = lambda a, b: F.when(b > 0, a / b)
    return x.select("zone", ratio(F.col("hit"), F.col("said")).alias("precision"), ratio(F.col("hit"), F.col("is")).alias("recall"), ratio(2 * F.col("hit"), F.col("is") + F.col("said")).alias("f1"), ratio(F.col("hit"), F.col("is") + F.col("said") - F.col("hit")).alias("iou"), (F.sum("hit").over(all_) / F.sum("is").over(all_)).alias("accuracy"))


def robustness_summary(scores: DataFrame, subset: str = "subset", score: str = "rmse") -> DataFrame:
    """Scores of modality subsets (arrays) by how many were kept: mean, best and worst, and the subset of the smallest score."""
    x = scores.withColumn("kept", F.size(subset))
    return x.groupBy("kept").agg(F.count("*").alias("subsets"), F.avg(score).alias("mean"), F.min(score).alias("best"), F.max(score).alias("worst"), F.min_by(F.concat_ws("+", subset), F.struct(score, F.concat_ws("+", subset))).alias("best_subset"))


def auroc(df: DataFrame, score: str, label: str, by: list[str] = (), least: int = 20, times: str | None = None) -> DataFrame:
    """Mann-Whitney AUROC with average ranks; null under `least` rows or with one class. A row stands for as many as its column `times` says."""
    w = F.col(times) if times else F.lit(1)
    d = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    ties = d.groupBy(*by, score).agg(F.sum(w).alias("n"), F.sum(F.col(label).cast("int") * w).alias("pos"))
    ranked = in_order(ties, list(by), [score], {"__run": F.col("n")}).withColumn("mean_rank", F.col("__run") - F.col("n") + (F.col("n") + 1) / 2)
    g = ranked.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.sum(F.col("pos") * F.col("mean_rank")).alias("s"))
    neg = F.col("n") - F.col("pos")
    return g.select(*by, "n", "pos", F.when((F.col("n") >= least) & (F.col("pos") > 0) & (neg > 0), (F.col("s") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * neg)).alias("auroc"))


def calibrated_threshold(df: DataFrame, score: str, label: str, steps: int = 100) -> DataFrame:
    """The threshold k / steps of the best accuracy (the lowest of equals).

    Scores are counted by the step they reach, so the data are scanned once and never multiplied by the thresholds.
    """
    step = F.least(F.lit(steps), F.greatest(F.lit(-1), F.floor(F.col(score) * steps + 1e-9))).cast("int")
    h = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(step.alias("k")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("int")).alias("pos"))
    grid = df.sparkSession.range(-1, steps + 1).select(F.col("id").cast("int").alias("k")).join(h, "k", "left").na.fill(0)
    below, up = W.orderBy("k").rowsBetween(W.unboundedPreceding, -1), W.orderBy("k").rowsBetween(0, W.unboundedFollowing)  # steps + 2 rows
    right = F.coalesce(F.sum(F.col("n") - F.col("pos")).over(below), F.lit(0)) + F.sum("pos").over(up)
    acc = grid.withColumn("right", right).withColumn("total", F.sum("n").over(W.partitionBy())).filter("k >= 0")
    return acc.agg(F.max_by(F.col("k") / steps, F.struct("right", -F.col("k"))).alias("threshold"), F.max(F.col("right") / F.col("total")).alias("accuracy"))


def season_weighted(df: DataFrame, value: str, weight: str, season: str = "season_id") -> DataFrame:
    """Weighted mean of each season, then the mean over seasons with weight."""
    s = df.groupBy(season).agg(F.sum(F.col(value) * F.col(weight)).alias("v"), F.sum(weight).alias("w")).filter("w > 0")
    return s.agg(F.count("*").alias("seasons"), F.avg(F.col("v") / F.col("w")).alias("mean"))


def circular_mean(df: DataFrame, degrees: str, by: list[str]) -> DataFrame:
    a = F.radians(degrees)
    return df.groupBy(*by).agg(F.pmod(F.degrees(F.atan2(F.avg(F.sin(a)), F.avg(F.cos(a)))), F.lit(360.0)).alias("mean_angle"))


def logged_metrics(df: DataFrame, target: str, pred: str) -> DataFrame:
    """Metrics of log values after exp: rmse, squared Pearson and Pearson r."""
    d = pairs(df.withColumns({"__y": F.exp(target), "__p": F.exp(pred)}), "__y", "__p")
    return d.agg(F.count("*").alias("n"), F.sqrt(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y")))).alias("rmse"), F.pow(F.corr("y", "p"), 2).alias("r2"), F.corr("y", "p").alias("pcc"))


def legacy_metrics(df: DataFrame, by: list[str], target: str = "target", pred: str = "pred") -> DataFrame:
    """rmse, R2 as squared Pearson r, and r itself."""
    return pairs(df, target, pred).groupBy(*by).agg(F.sqrt(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y")))).alias("rmse"), F.pow(F.corr("y", "p"), 2).alias("r2"), F.corr("y", "p").alias("pcc"))


def seed_summary(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean and sample deviation over seeds, 0 for a single one."""
    return df.groupBy(*by).agg(F.count(value).alias("seeds"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))


def scorecard(scores: DataFrame, benchmark: DataFrame, margin: float = 0.03) -> DataFrame:
    """(config, protocol, pair, r2) against (protocol, pair, r2): means overall, least protocol gap, and the verdict.

    A configuration passes when its mean gain reaches the margin and no protocol's mean is below the benchmark's.
    """
    d = scores.join(benchmark.withColumnRenamed("r2", "base"), ["protocol", "pair"]).withColumn("gain", F.col("r2") - F.col("base"))
    p = d.groupBy("config", "protocol").agg(F.avg("gain").alias("gain"), F.count("*").alias("n"), F.sum("gain").alias("s"))
    return p.groupBy("config").agg((F.sum("s") / F.sum("n")).alias("gain"), F.min("gain").alias("worst_protocol"), ((F.sum("s") / F.sum("n") >= margin) & F.every(F.col("gain") >= 0)).alias("passed"))
