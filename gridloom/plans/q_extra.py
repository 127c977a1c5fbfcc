"""Queries: conversions, policies, audits, masks, donors and tile selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as C
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import stats as S
from ..operators import windows as X
from ..sources import tables as SRC
from . import views as V
from .q_metrics import METRICS
from .registry import query

KEY = ["season_id", "grid_row", "grid_col"]


@query("SELECT event_id, round(value + 273.15, 6) AS temp, round(day(ts) / 1000.0, 6) AS prec FROM events WHERE event_type <> 'error'")
def p13_weather_units(spark, d):
    e = V.table(spark, d, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("temp"), F.dayofmonth("ts").cast("double").alias("prec"))
    return V.rounded(C.weather_units(e, ["temp"], ["prec"]))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN round((l_quantity - 25) / 10, 6) ELSE round(l_quantity, 6) END AS a, CASE WHEN l_returnflag = 'R' THEN round((l_discount - 0.05) / 1, 6) ELSE round(l_discount, 6) END AS b FROM lineitem")
def p24_registry_standardised(spark, d):
    l = V.table(spark, d, "lineitem").withColumn("v", F.array("l_quantity", "l_discount"))  # noqa: E741
    x = C.standardised_by_registry(l, {"R": ([25.0, 0.05], [10.0, 0.0])}, "l_returnflag", "v")
    return V.rounded(x.select("l_orderkey", "l_linenumber", "l_partkey", F.get("v", F.lit(0)).alias("a"), F.get("v", F.lit(1)).alias("b")))


@query(f"""{V.PANEL}, m AS (SELECT avg(target) a, stddev_pop(target) s FROM cells JOIN seasons USING (season_id) WHERE fold = 0) SELECT season_id, count(*) AS n, round(avg((target - a) / s), 6) AS target FROM cells, m GROUP BY 1""")
def p26_test_feature_policy(spark, d):
    c, s = V.cells(spark, d), V.seasons(spark, d)
    part = lambda f: S.column_stats(c.join(s.filter(f).select("season_id"), "season_id", "left_semi"), ["target"])
    stats = S.statistics_for("test", part("fold <> 0"), test=part("fold = 0"))
    return V.rounded(S.standardise(c, stats, ["target"]).groupBy("season_id").agg(F.count("*").alias("n"), F.avg("target").alias("target")))


@query("SELECT user_id, count(CASE WHEN event_type <> 'error' AND value > 100 THEN 1 END) AS valid FROM events GROUP BY 1")
def p30_rgb_masks(spark, d):
    v = F.when(F.col("value") > 100, F.col("value")).otherwise(F.lit(float("nan")))
    ok = C.rgb_valid([v, v + 1, v + 2], F.when(F.col("event_type") != "error", F.col("ts")), F.lit(True))
    return V.table(spark, d, "events").groupBy("user_id").agg(F.count_if(ok).alias("valid"))


@query(f"WITH {V.CELLS} SELECT (season_id << 40) | (grid_row << 20) | grid_col AS key, n_src FROM cells")
def p31_packed_keys(spark, d):
    return V.cells(spark, d).select(C.packed_key(F.col("season_id"), F.col("grid_row"), F.col("grid_col")).alias("key"), "n_src")


@query(f"{V.PANEL} SELECT country, {METRICS} FROM cells JOIN seasons USING (season_id) WHERE (grid_row * 5 + grid_col) % 4 <> 0 GROUP BY country")
def f16_masked_metrics(spark, d):
    return V.rounded(M.regression_metrics(V.panel(spark, d).filter("(grid_row * 5 + grid_col) % 4 <> 0"), ["country"]))


@query(f"{V.PANEL} SELECT crop, count(*) AS n FROM (SELECT DISTINCT season_id, grid_row // 16 AS r, grid_col // 16 AS c FROM cells) t JOIN seasons USING (season_id) WHERE fold <> 0 AND crop IN ('crop1', 'crop2') AND season_id % 9 <> 0 GROUP BY 1")
def f11_tiles_of_partition(spark, d):
    s = V.seasons(spark, d)
    t = V.cells(spark, d).select("season_id", F.floor(F.col("grid_row") / 16).alias("r"), F.floor(F.col("grid_col") / 16).alias("c")).distinct().join(s.select("season_id", "crop"), "season_id")
    a = s.select("season_id", F.when(F.col("fold") == 0, "test").otherwise("train").alias("partition"))
    return SRC.tiles_for(t, a, "train", ["crop1", "crop2"], s.filter("season_id % 9 = 0")).groupBy("crop").agg(F.count("*").alias("n"))


@query(f"""WITH {V.ACQ}, x AS (SELECT cell_id, day(day) AS t, b FROM acq WHERE clear = 1) SELECT cell_id, count(CASE WHEN t <= 20 THEN 1 END) AS visible, round(max(CASE WHEN t <= 20 THEN b END), 6) AS peak FROM x GROUP BY 1""")
def f04_estimator_cutoff(spark, d):
    a = V.acq(spark, d).filter("clear = 1").withColumn("t", F.dayofmonth("day"))
    seen = X.before_cutoff(F.col("t"), "before_harvest", F.lit(1), F.lit(28), 8)
    return V.rounded(a.groupBy("cell_id").agg(F.count_if(seen).alias("visible"), F.max(F.when(seen, F.col("b"))).alias("peak")))


@query("SELECT count(*) AS rows, count(CASE WHEN event_type = 'error' THEN 1 END) AS undated, count(CASE WHEN value IS NULL THEN 1 END) AS missing_value, count(CASE WHEN value > 300 THEN 1 END) AS over_value, count(DISTINCT user_id) AS units FROM events")
def s14_cache_audit(spark, d):
    e = V.table(spark, d, "events").withColumn("obs_day", F.when(F.col("event_type") != "error", F.to_date("ts")))
    return S.cache_audit(e, ["user_id"], ["value"], "obs_day", {"value": 300.0})


@query("SELECT user_id, 'value' AS channel, count(CASE WHEN value <= 300 THEN value END) AS n, round(sum(CASE WHEN value <= 300 THEN value END), 4) AS s, CAST(count(CASE WHEN value > 300 THEN 1 END) AS BIGINT) AS saturated FROM events GROUP BY 1")
def s15_f06_dense_stats(spark, d):
    x = S.dense_field_stats(V.table(spark, d, "events"), ["user_id"], ["value"], 300.0)
    return x.select("user_id", "channel", "n", (F.round("s", 4) + 0.0).alias("s"), "saturated")


@query(f"""{V.PANEL}, z AS (SELECT crop, season_id, count(*) AS n FROM cells JOIN seasons USING (season_id) GROUP BY 1, 2) SELECT crop, CAST(sum(n) AS BIGINT) AS rows, count(*) AS seasons, 0 AS own FROM z GROUP BY 1 HAVING count(*) > 1""")
def j19_donor_swap(spark, d):
    x = J.donor_swap(V.panel(spark, d), ["crop"], "season_id", ["grid_row", "grid_col"], "target")
    g = x.groupBy("crop").agg(F.count("donated").alias("rows"), F.count_distinct("season_id").alias("seasons"), F.count_if(F.col("donor") == F.col("season_id")).cast("int").alias("own"))
    return g.filter("seasons > 1")
