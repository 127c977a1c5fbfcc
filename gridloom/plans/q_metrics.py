"""Queries over the panel: metrics and statistics, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import stats as S
from . import views as V
from .registry import query

METRICS = """count(*) AS n, round(sqrt(avg((pred - target) * (pred - target))), 6) AS rmse, round(avg(abs(pred - target)), 6) AS mae,
 round(avg(pred - target), 6) AS bias, CASE WHEN var_pop(target) > 0 THEN round(1 - sum((pred - target) * (pred - target)) / (count(*) * var_pop(target)), 6) END AS r2,
 round(pow(corr(target, pred), 2), 6) AS pearson2"""


@query(f"{V.PANEL} SELECT {METRICS} FROM cells")
def a05_regression_metrics(spark, d):
    return V.rounded(M.regression_metrics(V.cells(spark, d)))


@query(f"{V.PANEL} SELECT count(*) AS n_seasons, round(avg(r), 6) AS rmse, round(avg(m), 6) AS mae FROM (SELECT season_id, sqrt(avg((pred-target)*(pred-target))) r, avg(abs(pred-target)) m FROM cells GROUP BY 1)")
def a06_field_balanced(spark, d):
    return V.rounded(M.field_balanced(V.cells(spark, d)))


@query(f"{V.PANEL}, f AS (SELECT season_id, avg(target) AS target, avg(pred) AS pred FROM cells GROUP BY 1) SELECT {METRICS} FROM f")
def a07_field_level(spark, d):
    return V.rounded(M.field_level(V.cells(spark, d)))


@query(f"""{V.PANEL} SELECT coalesce(country, 'all') AS country, coalesce(crop, 'all') AS crop, grouping_id(country, crop) AS level, {METRICS}
 FROM cells JOIN seasons USING (season_id) GROUP BY CUBE (country, crop)""")
def a08_grouping_metrics(spark, d):
    return V.rounded(M.grouping_metrics(V.panel(spark, d)))


@query(f"""{V.PANEL} SELECT count(*) AS n_groups, round(avg(rmse), 6) AS rmse, round(avg(r2), 6) AS r2 FROM (SELECT country, sqrt(avg((pred-target)*(pred-target))) rmse,
 1 - sum((pred-target)*(pred-target)) / (count(*) * var_pop(target)) r2 FROM cells JOIN seasons USING (season_id) GROUP BY 1)""")
def a08_macro_country_mean(spark, d):
    return V.rounded(M.macro_mean(M.grouping_metrics(V.panel(spark, d))))


@query(f"{V.PANEL} SELECT crop, {METRICS} FROM cells JOIN seasons USING (season_id) GROUP BY crop")
def a09_pooled_by_experiment(spark, d):
    return V.rounded(M.regression_metrics(V.panel(spark, d), ["crop"]))


@query(f"""{V.PANEL} SELECT crop, fold, count(*) AS n, round(sum(target), 6) AS sy, round(sum(target * target), 6) AS syy, round(sum((pred-target)*(pred-target)), 6) AS sse
 FROM cells JOIN seasons USING (season_id) GROUP BY crop, fold""")
def a10_fold_statistics(spark, d):
    return V.rounded(M.fold_statistics(V.panel(spark, d), ["crop", "fold"]))


@query(f"""{V.PANEL} SELECT crop, CAST(count(*) AS BIGINT) AS n, round(1 - sum((pred-target)*(pred-target)) / (sum(target*target) - sum(target)*sum(target)/count(*)), 6) AS r2
 FROM cells JOIN seasons USING (season_id) WHERE fold <> 2 GROUP BY crop""")
def a10_recombined_r2(spark, d):
    stats = M.fold_statistics(V.panel(spark, d), ["crop", "fold"]).filter("fold <> 2")
    return V.rounded(M.r2_of(stats, ["crop"]))


@query(f"""{V.PANEL}, x AS (SELECT crop, fold, target, pred FROM cells JOIN seasons USING (season_id)),
 f AS (SELECT crop, fold, sqrt(avg((pred-target)*(pred-target))) rmse, 1 - sum((pred-target)*(pred-target)) / (count(*) * var_pop(target)) r2 FROM x GROUP BY 1, 2),
 g AS (SELECT crop, count(*) AS folds, round(avg(r2), 6) AS r2_mean, round(stddev_pop(r2), 6) AS r2_std, round(avg(rmse), 6) AS rmse_mean, round(stddev_pop(rmse), 6) AS rmse_std FROM f GROUP BY 1)
 SELECT g.*, p.n, p.r2_pooled, p.rmse_pooled FROM g JOIN (SELECT crop, count(*) AS n, round(1 - sum((pred-target)*(pred-target)) / (count(*) * var_pop(target)), 6) AS r2_pooled,
 round(sqrt(avg((pred-target)*(pred-target))), 6) AS rmse_pooled FROM x GROUP BY 1) p USING (crop)""")
def a11_fold_summary(spark, d):
    cells = M.refuse_repeats(V.panel(spark, d), ["season_id", "grid_row", "grid_col"])
    return V.rounded(M.fold_summary(cells, "fold", ["crop"]))


@query(f"""{V.PANEL}, x AS (SELECT fold, target y, pred p FROM cells JOIN seasons USING (season_id)),
 f AS (SELECT fold, count(*) n, sum(y) sy, avg(y) my, var_pop(y) vy, avg(p-y) bias, avg((p-y)*(p-y)) mse, stddev_pop(p) sp FROM x GROUP BY 1),
 t AS (SELECT count(*) tn, sum(y) ty, stddev_pop(y) ts FROM x)
 SELECT fold, n, round(bias, 6) AS bias, round(bias*bias/mse, 6) AS bias_share, round(1-mse/vy, 6) AS r2, round(1-(mse-bias*bias)/vy, 6) AS r2_unbiased,
 round(-((ty-sy)/(tn-n)-my)*((ty-sy)/(tn-n)-my)/vy, 6) AS r2_mean_of_rest, round(sqrt(vy)/ts, 6) AS std_share, round(sp/sqrt(vy), 6) AS pred_std_ratio FROM f, t""")
def a12_r2_diagnostics(spark, d):
    return V.rounded(M.diagnostics(V.panel(spark, d), "fold"))


WITHIN = """s AS (SELECT crop, season_id, count(*) n, sum(y) sy, sum(y*y) syy, count(*)*var_pop(y) sst, count(*)*var_pop(p) spp, count(*)*covar_pop(p, y) spy, count(*)*var_pop(p-y) sse FROM x GROUP BY 1, 2 HAVING count(*) >= 3)"""


@query(f"""{V.PANEL}, x AS (SELECT crop, season_id, target y, pred p FROM cells JOIN seasons USING (season_id)), {WITHIN}
 SELECT crop, count(*) AS seasons, CAST(sum(n) AS BIGINT) AS n, round(1 - sum(sse)/sum(sst), 6) AS r2_within, round(median(CASE WHEN sst > 0 THEN 1-sse/sst END), 6) AS r2_median,
 round(median(CASE WHEN sst > 0 AND spp > 0 THEN spy/sqrt(sst*spp) END), 6) AS r_median, round(median(CASE WHEN sst > 0 THEN sqrt(spp/sst) END), 6) AS std_ratio_median,
 round(sum(sst) / (sum(syy) - sum(sy)*sum(sy)/sum(n)), 6) AS within_share FROM s GROUP BY crop""")
def a13_within_field(spark, d):
    return V.rounded(M.within_field(V.panel(spark, d), ["crop"]))


@query(f"""{V.PANEL}, x AS (SELECT season_id, target y, pred p FROM cells)
 SELECT season_id, count(*) AS n, round(sum(y), 4) AS sy, round(sum(p), 4) AS sp, round(sum(y*y), 4) AS syy, round(sum(p*p), 4) AS spp, round(sum(p*y), 4) AS spy, round(sum((p-y)*(p-y)), 4) AS sse,
 round(count(*)*var_pop(y), 4) AS wsst, round(count(*)*var_pop(p), 4) AS wspp, round(count(*)*covar_pop(p, y), 4) AS wspy, round(count(*)*var_pop(p-y), 4) AS wsse FROM x GROUP BY 1""")
def a14_field_sums(spark, d):
    return V.rounded(M.field_sums(V.cells(spark, d), ["season_id"]), 4)


@query(f"""{V.PANEL}, k AS (SELECT season_id FROM cells GROUP BY 1 HAVING count(*) >= 450), x AS (SELECT 1 crop, season_id, target y, pred p FROM cells WHERE season_id IN (SELECT season_id FROM k)), {WITHIN}
 SELECT count(*) AS seasons, round(1 - sum(sse)/sum(sst), 6) AS r2_within FROM s""")
def a15_within_field_of_seasons(spark, d):
    cells = V.cells(spark, d)
    keep = cells.groupBy("season_id").count().filter("count >= 450").select("season_id")
    return V.rounded(M.within_field(cells.join(keep, "season_id", "left_semi")).select("seasons", "r2_within"))


@query(f"{V.PANEL} SELECT season_id, round(sqrt(avg((pred-target)*(pred-target))), 6) AS rmse, round(pow(corr(target, pred), 2), 6) AS r2, round(corr(target, pred), 6) AS pcc FROM cells GROUP BY 1")
def a16_legacy_metrics(spark, d):
    return V.rounded(M.legacy_metrics(V.cells(spark, d), ["season_id"]))


ZONES = f"""{V.PANEL}, q AS (SELECT season_id, quantile_cont(target, [0.25, 0.5, 0.75]) AS q FROM cells GROUP BY 1),
 z AS (SELECT season_id, (target >= q[1])::int + (target >= q[2])::int + (target >= q[3])::int AS true_zone, (pred >= q[1])::int + (pred >= q[2])::int + (pred >= q[3])::int AS pred_zone FROM cells JOIN q USING (season_id))"""


@query(f"{ZONES} SELECT season_id, count(*) AS n, round(avg((true_zone = pred_zone)::int), 6) AS preserved FROM z GROUP BY 1")
def a17_zone_preservation(spark, d):
    return V.rounded(M.zone_preservation(M.zone_table(V.cells(spark, d), ["season_id"]), ["season_id"]))


@query(f"{V.PANEL} SELECT round(avg(r), 6) AS rmse, round(avg(p), 6) AS pcc, count(*) AS fields FROM (SELECT season_id, sqrt(avg((pred-target)*(pred-target))) r, corr(target, pred) p FROM cells GROUP BY 1)")
def a18_mean_of_field_metrics(spark, d):
    each = M.legacy_metrics(V.cells(spark, d), ["season_id"])
    return V.rounded(each.agg(F.avg("rmse").alias("rmse"), F.avg(F.when(~F.isnan("pcc"), F.col("pcc"))).alias("pcc"), F.count("*").alias("fields")))


@query(f"{ZONES} SELECT true_zone, pred_zone, count(*) AS n FROM z GROUP BY 1, 2")
def a19_confusion(spark, d):
    return M.confusion(M.zone_table(V.cells(spark, d), ["season_id"]))


@query(f"""{ZONES}, c AS (SELECT true_zone t, pred_zone p, count(*) n FROM z GROUP BY 1, 2), k AS (SELECT DISTINCT t AS zone FROM c UNION SELECT DISTINCT p FROM c),
 m AS (SELECT zone, coalesce((SELECT sum(n) FROM c WHERE t = zone), 0) i, coalesce((SELECT sum(n) FROM c WHERE p = zone), 0) s, coalesce((SELECT sum(n) FROM c WHERE t = zone AND p = zone), 0) h FROM k)
 SELECT zone, CASE WHEN s > 0 THEN round(h/s, 6) END AS precision, CASE WHEN i > 0 THEN round(h/i, 6) END AS recall, round(2*h/(i+s), 6) AS f1, round(h/(i+s-h), 6) AS iou, round((SELECT sum(h) FROM m)/(SELECT sum(i) FROM m), 6) AS accuracy FROM m""")
def a19_zone_scores(spark, d):
    return V.rounded(M.confusion_scores(M.confusion(M.zone_table(V.cells(spark, d), ["season_id"]))))


@query(f"""{V.PANEL}, x AS (SELECT crop, fold, season_id % 3 AS m, pred - target AS e FROM cells JOIN seasons USING (season_id)),
 u AS (SELECT unnest(['r', 's', 't', 'r+s', 'r+t', 's+t', 'r+s+t']) AS sub), b AS (SELECT sub, len(string_split(sub, '+')) AS kept, sqrt(avg(e*e)) AS rmse
 FROM u JOIN x ON list_contains(string_split(sub, '+'), chr(114 + CAST(m AS INT))) GROUP BY 1, 2)
 SELECT CAST(kept AS INT) AS kept, count(*) AS subsets, round(avg(rmse), 6) AS mean, round(min(rmse), 6) AS best, round(max(rmse), 6) AS worst, arg_min(sub, rmse) AS best_subset FROM b GROUP BY kept""")
def a20_modality_robustness(spark, d):
    part = spark.sql("SELECT * FROM VALUES (array('r')), (array('s')), (array('t')), (array('r','s')), (array('r','t')), (array('s','t')), (array('r','s','t')) AS u(subset)")
    x = V.panel(spark, d).withColumn("m", F.char(F.lit(114) + F.col("season_id") % 3))
    sums = x.groupBy("m").agg(F.count("*").alias("n"), F.sum((F.col("pred") - F.col("target")) * (F.col("pred") - F.col("target"))).alias("s"))
    scores = part.join(F.broadcast(sums), F.array_contains("subset", F.col("m"))).groupBy("subset").agg(F.sqrt(F.sum("s") / F.sum("n")).alias("rmse"))
    return V.rounded(M.robustness_summary(scores))


VARIOGRAM = """c AS (SELECT season_id, grid_row r, grid_col k, target - avg(target) OVER (PARTITION BY season_id) v FROM cells), h AS (SELECT unnest(range(1, 6)) h),
 p AS (SELECT a.season_id, h, (b.v-a.v)*(b.v-a.v) d FROM c a, h, c b WHERE a.season_id = b.season_id AND ((b.r = a.r + h AND b.k = a.k) OR (b.k = a.k + h AND b.r = a.r))),
 g AS (SELECT season_id, h, sum(d)/2 gamma_sum, count(*) n_pairs FROM p GROUP BY 1, 2)"""


@query(f"{V.PANEL}, {VARIOGRAM} SELECT season_id, CAST(h AS INT) AS h, round(gamma_sum, 4) AS gamma_sum, n_pairs FROM g")
def a21_semivariogram(spark, d):
    return V.rounded(S.semivariogram(V.cells(spark, d), lags=5), 4)


@query(f"""{V.PANEL}, {VARIOGRAM}, v AS (SELECT crop, sum(x.n*x.vp)/sum(x.n) AS variance FROM (SELECT season_id, count(*) n, var_pop(target) vp FROM cells GROUP BY 1) x JOIN seasons USING (season_id) GROUP BY 1),
 f AS (SELECT crop, h, sum(gamma_sum)/sum(g.n_pairs) AS gamma FROM g JOIN seasons USING (season_id) WHERE h <= 3 GROUP BY 1, 2), n AS (SELECT crop, greatest(0, regr_intercept(gamma, h)) nugget FROM f GROUP BY 1)
 SELECT crop, round(nugget, 5) AS nugget, round(variance, 5) AS variance, round(1 - nugget/variance, 5) AS ceiling FROM n JOIN v USING (crop)""")
def a22_noise_ceiling(spark, d):
    cells, seasons = V.cells(spark, d), V.seasons(spark, d)
    g = S.semivariogram(cells, lags=3).join(seasons.select("season_id", "crop"), "season_id")
    var = cells.groupBy("season_id").agg(F.count("*").alias("n"), F.var_pop("target").alias("v")).join(seasons.select("season_id", "crop"), "season_id")
    return V.rounded(S.nugget(g, var.groupBy("crop").agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("variance")), ["crop"]), 5)


@query(f"""{V.PANEL} SELECT season_id, channel, count(v) AS n, round(sum(v), 4) AS s, round(sum(v*v), 4) AS ss, round(min(v), 6) AS mn, round(max(v), 6) AS mx FROM
 (SELECT season_id, 'target' AS channel, target AS v FROM cells UNION ALL SELECT season_id, 'pred', pred FROM cells) GROUP BY 1, 2""")
def a01_sufficient_stats(spark, d):
    x = S.sufficient_stats(V.cells(spark, d), ["season_id"], ["target", "pred"])
    return x.select("season_id", "channel", "n", *[(F.round(c, k) + 0.0).alias(c) for c, k in (("s", 4), ("ss", 4), ("mn", 6), ("mx", 6))])


@query(f"""{V.PANEL}, l AS (SELECT country, 'target' AS channel, target AS v FROM cells JOIN seasons USING (season_id) WHERE fold <> 0 UNION ALL SELECT country, 'pred', pred FROM cells JOIN seasons USING (season_id) WHERE fold <> 0)
 SELECT country, channel, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM l GROUP BY 1, 2""")
def a02_normaliser_of_training_seasons(spark, d):
    stats = S.sufficient_stats(V.cells(spark, d), ["season_id"], ["target", "pred"])
    train = V.seasons(spark, d).filter("fold <> 0").select("season_id", "country")
    return V.rounded(S.normaliser(stats.join(train, "season_id"), ["country"]))


@query(f"{V.PANEL} SELECT 'target' AS channel, round(avg(target), 6) AS mean, round(stddev_pop(target), 6) AS std FROM cells UNION ALL SELECT 'pred', round(avg(pred), 6), round(stddev_pop(pred), 6) FROM cells")
def a03_column_stats(spark, d):
    return V.rounded(S.column_stats(V.cells(spark, d), ["target", "pred"]))


@query(f"""{V.PANEL}, s AS (SELECT season_id % 4 AS channel, CASE WHEN season_id % 4 = 0 THEN 0.0 ELSE stddev_pop(target) END AS std FROM cells GROUP BY 1) SELECT channel, CASE WHEN std > 0 THEN round(std, 6) ELSE 1.0 END AS std FROM s""")
def a04_repaired_stats(spark, d):
    s = V.cells(spark, d).groupBy((F.col("season_id") % 4).alias("channel")).agg(F.stddev_pop("target").alias("std"))
    return V.rounded(S.repaired(s.withColumn("std", F.when(F.col("channel") == 0, 0.0).otherwise(F.col("std")))))


@query(f"""{V.PANEL}, m AS (SELECT avg(target) a, stddev_pop(target) s, avg(pred) b, stddev_pop(pred) t FROM cells) SELECT season_id, grid_row, grid_col, round((target-a)/s, 6) AS target, round((pred-b)/t, 6) AS pred, n_src FROM cells, m""")
def p25_standardised(spark, d):
    cells = V.cells(spark, d)
    return V.rounded(S.standardise(cells, S.column_stats(cells, ["target", "pred"]), ["target", "pred"]))


@query(f"{V.PANEL} SELECT season_id, grid_row, grid_col, round(target, 6) AS target, round(pred, 6) AS pred, n_src FROM cells")
def a63_inverse_standardised(spark, d):
    cells = V.cells(spark, d)
    stats = S.column_stats(cells, ["target", "pred"])
    return V.rounded(S.standardise(S.standardise(cells, stats, ["target", "pred"]), stats, ["target", "pred"], reverse=True))


@query(f"""{V.PANEL} SELECT season_id, count(*) AS n, round((stddev_samp(pred) - stddev_samp(target)) * (stddev_samp(pred) - stddev_samp(target)), 6) AS variance_gap FROM cells GROUP BY 1 HAVING count(*) >= 3""")
def a59_variance_match(spark, d):
    return V.rounded(M.variance_match(V.cells(spark, d)))


@query(f"""{V.PANEL} SELECT count(*) AS seasons, round(avg(v / w), 6) AS mean FROM (SELECT season_id, sum(abs(pred-target) * n_src) v, sum(n_src) w FROM cells GROUP BY 1) WHERE w > 0""")
def a41_season_weighted_mean(spark, d):
    return V.rounded(M.season_weighted(V.cells(spark, d).withColumn("loss", F.abs(F.col("pred") - F.col("target"))), "loss", "n_src"))


@query("""SELECT l_suppkey AS season_id, round(fmod(degrees(atan2(avg(sin(radians(l_quantity * 7))), avg(cos(radians(l_quantity * 7))))) + 360, 360), 4) AS mean_angle FROM lineitem GROUP BY 1""")
def a60_circular_mean(spark, d):
    l = V.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("season_id"), (F.col("l_quantity") * 7).alias("deg"))  # noqa: E741
    return V.rounded(M.circular_mean(l, "deg", ["season_id"]), 4)


@query(f"""{V.PANEL}, x AS (SELECT target/10 y, pred/10 p FROM cells) SELECT count(*) AS n, round(sqrt(avg((exp(p)-exp(y))*(exp(p)-exp(y)))), 6) AS rmse, round(pow(corr(exp(y), exp(p)), 2), 6) AS r2, round(corr(exp(y), exp(p)), 6) AS pcc FROM x""")
def a62_delogged_metrics(spark, d):
    return V.rounded(M.logged_metrics(V.cells(spark, d).select((F.col("target") / 10).alias("y"), (F.col("pred") / 10).alias("p")), "y", "p"))


@query(f"""{V.PANEL}, f AS (SELECT crop, fold, sqrt(avg((pred-target)*(pred-target))) r FROM cells JOIN seasons USING (season_id) GROUP BY 1, 2) SELECT crop, count(*) AS seeds, round(avg(r), 6) AS mean, round(coalesce(stddev_samp(r), 0), 6) AS sd FROM f GROUP BY 1""")
def a50_seed_summary(spark, d):
    return V.rounded(M.seed_summary(M.regression_metrics(V.panel(spark, d), ["crop", "fold"]), "rmse", ["crop"]))


@query(f"""{V.PANEL}, f AS (SELECT country, crop, sqrt(avg((pred-target)*(pred-target))) r FROM cells JOIN seasons USING (season_id) GROUP BY 1, 2) SELECT country, count(*) AS variants, round(avg(r), 6) AS mean, round(stddev_pop(r), 6) AS std FROM f GROUP BY 1""")
def a51_ablation_summary(spark, d):
    e = M.regression_metrics(V.panel(spark, d), ["country", "crop"])
    return V.rounded(e.groupBy("country").agg(F.count("*").alias("variants"), F.avg("rmse").alias("mean"), F.stddev_pop("rmse").alias("std")))


SCORES = f"""{V.PANEL}, s AS (SELECT farm_id AS config, country AS protocol, crop AS pair, 1 - avg(abs(pred-target))/avg(target) AS r2 FROM cells JOIN seasons USING (season_id) GROUP BY 1, 2, 3),
 b AS (SELECT country AS protocol, crop AS pair, 1 - avg(abs(pred-target))/avg(target) AS r2 FROM cells JOIN seasons USING (season_id) GROUP BY 1, 2)"""


@query(f"""{SCORES}, d AS (SELECT config, protocol, s.r2 - b.r2 AS gain FROM s JOIN b USING (protocol, pair)), p AS (SELECT config, protocol, avg(gain) g, count(*) n, sum(gain) t FROM d GROUP BY 1, 2)
 SELECT config, round(sum(t)/sum(n), 6) AS gain, round(min(g), 6) AS worst_protocol, (sum(t)/sum(n) >= 0.0001 AND bool_and(g >= 0)) AS passed FROM p GROUP BY 1""")
def a52_scorecard(spark, d):
    p = V.panel(spark, d)
    skill = (1 - F.avg(F.abs(F.col("pred") - F.col("target"))) / F.avg("target")).alias("r2")
    scores = p.groupBy(F.col("farm_id").alias("config"), F.col("country").alias("protocol"), F.col("crop").alias("pair")).agg(skill)
    base = p.groupBy(F.col("country").alias("protocol"), F.col("crop").alias("pair")).agg(skill)
    return V.rounded(M.scorecard(scores, base, 0.0001))


@query("""WITH x AS (SELECT doc_id % 5 AS g, n_chars AS s, quality AS y FROM documents JOIN labels USING (doc_id)), r AS (SELECT g, s, y, rank() OVER (PARTITION BY g ORDER BY s) + (count(*) OVER (PARTITION BY g, s) - 1) / 2.0 AS k FROM x)
 SELECT g, count(*) AS n, CAST(sum(y) AS BIGINT) AS pos, CASE WHEN count(*) >= 20 AND sum(y) > 0 AND sum(y) < count(*) THEN round((sum(CASE WHEN y = 1 THEN k END) - sum(y)*(sum(y)+1)/2.0)/(sum(y)*(count(*)-sum(y))), 6) END AS auroc FROM r GROUP BY g""")
def a43_auroc_by_group(spark, d):
    x = V.table(spark, d, "documents").join(V.table(spark, d, "labels"), "doc_id").select((F.col("doc_id") % 5).alias("g"), "n_chars", "quality")
    return V.rounded(M.auroc(x, "n_chars", "quality", ["g"]))


@query("""WITH x AS (SELECT least(1.0, n_chars / 5000.0) AS s, quality AS y FROM documents JOIN labels USING (doc_id)), t AS (SELECT unnest(range(0, 101)) AS k),
 a AS (SELECT k, avg(((floor(s * 100 + 1e-9) >= k) = (y = 1))::int) AS acc FROM x, t GROUP BY 1) SELECT round(arg_max(k / 100.0, acc * 1e9 - k), 6) AS threshold, round(max(acc), 6) AS accuracy FROM a""")
def a58_calibrated_threshold(spark, d):
    x = V.table(spark, d, "documents").join(V.table(spark, d, "labels"), "doc_id").select(F.least(F.lit(1.0), F.col("n_chars") / 5000.0).alias("s"), "quality")
    return V.rounded(M.calibrated_threshold(x, "s", "quality"))


@query(f"""{V.PANEL}, e AS (SELECT season_id, target v, count(*) OVER (PARTITION BY season_id) m, crop FROM cells JOIN seasons USING (season_id)), k AS (SELECT crop FROM e GROUP BY 1 HAVING count(DISTINCT season_id) >= 2),
 o AS (SELECT crop, v, 1.0/m w, sum(1.0/m) OVER (PARTITION BY crop ORDER BY v, m, season_id ROWS UNBOUNDED PRECEDING) c, sum(1.0/m) OVER (PARTITION BY crop) t FROM e WHERE crop IN (SELECT crop FROM k))
 SELECT crop, count(*) AS points FROM (SELECT DISTINCT crop, unnest(range(0, 21)) AS q FROM o) GROUP BY 1""")
def a36_weighted_quantile_points(spark, d):
    q = S.weighted_quantiles(V.panel(spark, d), "target", ["crop"], points=21, least=2)
    return q.groupBy("crop").agg(F.count("*").alias("points"))


@query(f"""{V.PANEL}, e AS (SELECT crop, CAST(target AS DOUBLE) AS v, 1.0 / count(*) OVER (PARTITION BY season_id) AS w FROM cells JOIN seasons USING (season_id)), g AS (SELECT crop, v, sum(w) AS w, count(*) AS c FROM e GROUP BY 1, 2),
 o AS (SELECT *, sum(w) OVER (PARTITION BY crop ORDER BY v) AS run, sum(w) OVER (PARTITION BY crop) AS total FROM g), p AS (SELECT crop, v, (run - w + w / c / 2) / total AS pos FROM o UNION ALL SELECT crop, v, (run - w / c / 2) / total FROM o), k AS (SELECT CAST(unnest(range(101)) AS INT) AS k),
 b AS (SELECT crop, k, max(pos) FILTER (pos <= k / 100.0) AS a0, arg_max(v, pos) FILTER (pos <= k / 100.0) AS v0, min(pos) FILTER (pos >= k / 100.0) AS a1, arg_min(v, pos) FILTER (pos >= k / 100.0) AS v1 FROM p, k GROUP BY 1, 2)
 SELECT crop, k, round(CASE WHEN a0 IS NULL THEN v1 WHEN a1 IS NULL OR a1 = a0 THEN v0 ELSE v0 + (k / 100.0 - a0) / (a1 - a0) * (v1 - v0) END, 6) AS value FROM b""")
def a36_weighted_quantiles(spark, d):
    return V.rounded(S.weighted_quantiles(V.panel(spark, d), "target", ["crop"], points=101, least=2))


@query(f"""{V.PANEL}, g AS (SELECT crop, quantile_cont(pred, [x / 20.0 for x in range(0, 21)]) q FROM cells JOIN seasons USING (season_id) GROUP BY 1)
 SELECT season_id, grid_row, grid_col, round((len(list_filter(q, lambda z: z < target)) + len(list_filter(q, lambda z: z <= target))) / 42.0, 6) AS rank FROM cells JOIN seasons USING (season_id) JOIN g USING (crop)""")
def w05_mid_rank(spark, d):
    p = V.panel(spark, d)
    grid = p.groupBy("crop").agg(F.percentile("pred", F.array(*[F.lit(k / 20) for k in range(21)])).alias("q")).select("crop", F.explode("q").alias("value"))
    return V.rounded(S.mid_rank(p, grid, "target", ["crop"], "rank").select("season_id", "grid_row", "grid_col", "rank"))


@query("""WITH a AS (SELECT user_id AS cell_id, CAST(ts AS date) d, event_type FROM events), c AS (SELECT cell_id, count(*) AS cells FROM a GROUP BY 1),
 g AS (SELECT cell_id, (day(d) - 1) // 10 AS slot, median(day(d)) m, max(day(d)) - min(day(d)) s, count(*) n FROM a WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1, 2)
 SELECT cell_id, CAST(slot AS INT) AS slot, round(m, 6) AS median_day, CAST(s AS INT) AS spread, round(n / cells, 6) AS coverage FROM g JOIN c USING (cell_id)""")
def a26_slot_dates(spark, d):
    return V.rounded(_slot_dates(spark, d))


def _slot_dates(spark, d):
    a = V.acq(spark, d).withColumns({"dom": F.dayofmonth("day"), "slot": F.floor((F.dayofmonth("day") - 1) / 10).cast("int")})
    return S.slot_dates(a, ["cell_id"], "dom", F.col("clear") == 1, a.groupBy("cell_id").agg(F.count("*").alias("cells")))


A26 = """WITH a AS (SELECT user_id AS cell_id, CAST(ts AS date) d, event_type FROM events), c AS (SELECT cell_id, count(*) AS cells FROM a GROUP BY 1),
 g AS (SELECT cell_id, (day(d) - 1) // 10 AS slot, max(day(d)) - min(day(d)) s, count(*) n FROM a WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1, 2)"""


@query(f"{A26} SELECT count(*) AS slots, round(avg((s > 1)::int), 6) AS incoherent FROM g")
def a27_date_coherence(spark, d):
    return V.rounded(S.date_coherence(_slot_dates(spark, d)))


@query(f"{A26} SELECT cell_id, CAST(slot AS INT) AS slot FROM g JOIN c USING (cell_id) WHERE n / cells >= 0.25 AND s <= 8")
def f09_qualifying_slots(spark, d):
    return S.qualifying(_slot_dates(spark, d), 0.25, 8).select("cell_id", "slot")


@query(f"""{V.PANEL} SELECT (SELECT count(*) FROM cells) AS rows, count(*) AS keys, 0 AS repeated_keys, (SELECT count(*) FROM cells WHERE target IS NULL) AS missing, (SELECT count(*) FROM cells WHERE target = -1) AS minus_one,
 (SELECT count(*) FROM cells WHERE target <= 0) AS not_positive, (SELECT min(target) FROM cells) AS p0, (SELECT round(quantile_cont(target, 0.01), 6) FROM cells) AS p1, (SELECT median(target) FROM cells) AS p2,
 (SELECT round(quantile_cont(target, 0.99), 6) FROM cells) AS p3, (SELECT max(target) FROM cells) AS p4 FROM (SELECT DISTINCT season_id, grid_row, grid_col FROM cells)""")
def s10_table_audit(spark, d):
    return V.rounded(S.table_audit(V.cells(spark, d), ["season_id", "grid_row", "grid_col"])).withColumn("repeated_keys", F.col("repeated_keys").cast("int"))


@query(f"""WITH {V.ACQ}, x AS (SELECT cell_id, date_diff('day', lag(day) OVER w, day) dt, b, lag(b) OVER w AS before FROM acq WINDOW w AS (PARTITION BY cell_id ORDER BY day, b))
 SELECT CAST(dt AS INT) AS dt, count(*) AS n, round(avg((b = before)::int), 6) AS flat, round(quantile_cont(b / greatest(dt, 1), 0.25), 6) AS q1, round(quantile_cont(b / greatest(dt, 1), 0.5), 6) AS q2, round(quantile_cont(b / greatest(dt, 1), 0.75), 6) AS q3 FROM x WHERE dt IS NOT NULL GROUP BY 1""")
def a28_interval_audit(spark, d):
    return V.rounded(S.interval_audit(V.acq(spark, d), ["cell_id"], "day", "b"))


@query(None)
def a42_effective_rank(spark, d):
    return V.rounded(S.effective_rank(V.table(spark, d, "embeddings"), "embedding"), 4)


@query("""WITH r AS (SELECT embedding::DOUBLE[] AS rule FROM embeddings WHERE vec_id = 0), x AS (SELECT a.label, list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda z: z[1] - z[2]) AS d, rule
 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1, r), y AS (SELECT label, CASE WHEN list_dot_product(d, d) > 0 THEN list_dot_product(d, rule) / sqrt(list_dot_product(d, d) * list_dot_product(rule, rule)) END AS v FROM x)
 SELECT label, count(v) AS n, round(avg(v), 5) AS alignment FROM y GROUP BY label""")
def a44_relation_alignment(spark, d):
    e = V.table(spark, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    rule = e.filter("vec_id = 0").select(F.col("embedding").alias("rule"))
    x = e.join(nxt, "vec_id").crossJoin(F.broadcast(rule)).withColumn("v", S.relation_alignment(F.col("embedding"), F.col("b"), F.col("rule")))  # one row
    return V.rounded(x.groupBy("label").agg(F.count("v").alias("n"), F.avg("v").alias("alignment")), 5)
