"""Queries: joins, windows and validity rules, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as C
from ..operators import joins as J
from ..operators import windows as X
from . import views as V
from .registry import query

KEY = ["season_id", "grid_row", "grid_col"]


@query(f"""WITH {V.CELLS}, g AS (SELECT s_suppkey AS season_id, concat('field', s_nationkey) AS f FROM supplier WHERE s_suppkey % 3 <> 0), s AS (SELECT DISTINCT season_id FROM cells)
 SELECT season_id, coalesce(f, CAST(season_id AS VARCHAR)) AS physical_field_id, f IS NOT NULL AS geometry_verified FROM s LEFT JOIN g USING (season_id)""")
def j01_seasons_with_geometry(spark, d):
    g = V.table(spark, d, "supplier").filter("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("season_id"), F.concat(F.lit("field"), "s_nationkey").alias("physical_field_id"))
    return J.seasons_with_geometry(V.cells(spark, d).select("season_id").distinct(), g)


@query(f"""WITH {V.BOXES}, p AS (SELECT a.id a, b.id b, greatest(0, least(a.x0+a.w, b.x0+b.w) - greatest(a.x0, b.x0)) * greatest(0, least(a.y0+a.h, b.y0+b.h) - greatest(a.y0, b.y0)) i, a.w*a.h + b.w*b.h s
 FROM boxes a JOIN boxes b ON a.grp = b.grp AND a.id < b.id) SELECT a, b, round(i / (s - i), 6) AS iou FROM p WHERE i / (s - i) >= 0.1""")
def j02_footprint_overlaps(spark, d):
    return V.rounded(J.overlaps(V.boxes(spark, d), ["grp"]))


POINTS = """t AS (SELECT c_custkey AS target_id, c_nationkey AS grp, ((c_custkey * 7919) % 1000)::DOUBLE AS x, ((c_custkey * 104729) % 1000)::DOUBLE AS y FROM customer),
 s AS (SELECT o_orderkey AS source_id, CAST(o_orderkey % 25 AS INT) AS grp, ((o_orderkey * 6151) % 1000)::DOUBLE AS x, ((o_orderkey * 3079) % 1000)::DOUBLE AS y FROM orders)"""


def _points(spark, d):
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    t = V.table(spark, d, "customer").select(k.alias("target_id"), F.col("c_nationkey").alias("grp"), (k * 7919 % 1000).cast("double").alias("x"), (k * 104729 % 1000).cast("double").alias("y"))
    s = V.table(spark, d, "orders").select(o.alias("source_id"), (o % 25).cast("int").alias("grp"), (o * 6151 % 1000).cast("double").alias("x"), (o * 3079 % 1000).cast("double").alias("y"))
    return t, s


NEAREST = f"""WITH {POINTS}, p AS (SELECT target_id, source_id, sqrt((t.x-s.x)*(t.x-s.x)+(t.y-s.y)*(t.y-s.y)) d FROM t JOIN s USING (grp)),
 m AS (SELECT target_id, min(row(d, source_id)) b FROM p WHERE d <= 20 GROUP BY 1)"""


@query(f"""{NEAREST} SELECT t.target_id, coalesce(struct_extract(b, 2), -1) AS source, round(struct_extract(b, 1), 6) AS distance FROM t LEFT JOIN m USING (target_id)""")
def j03_nearest_cell(spark, d):
    t, s = _points(spark, d)
    return V.rounded(J.nearest(t, s, 20.0, 20.0, by=["grp"]).select("target_id", "source", "distance"))


@query(f"""{NEAREST} SELECT CAST(l AS INT) AS layer, count(*) AS n, round(sum(o_totalprice * l), 2) AS total FROM m JOIN orders ON o_orderkey = struct_extract(b, 2), (SELECT unnest([1, 2]) AS l) GROUP BY 1""")
def j03_layers_through_one_mapping(spark, d):
    t, s = _points(spark, d)
    layers = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("source_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("layer"), "o_totalprice")
    x = J.apply_mapping(J.nearest(t, s, 20.0, 20.0, by=["grp"]), layers)
    return V.rounded(x.groupBy("layer").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice") * F.col("layer")).alias("total")), 2)


@query("""WITH o AS (SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice, max(row(epoch_us(o_orderdate), o_orderkey)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) p FROM orders)
 SELECT o_custkey, o_orderkey, struct_extract(p, 2) AS prev_orderkey FROM o""")
def j04_latest_earlier_season(spark, d):
    o = V.table(spark, d, "orders").withColumn("us", F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    return J.latest_earlier(o.select("o_custkey", "us", "o_orderkey"), ["o_custkey"], ["us", "o_orderkey"], []).select("o_custkey", "o_orderkey", F.col("prev_o_orderkey").alias("prev_orderkey"))


MATCHED = f"WITH {V.CELLS}, a AS (SELECT * FROM cells WHERE (grid_row + grid_col) % 5 <> 0), b AS (SELECT season_id, grid_row, grid_col, target, target * 0.9 + 1 AS pred FROM cells WHERE (grid_row * 3 + grid_col) % 7 <> 0)"


def _two(spark, d):
    c = V.cells(spark, d)
    return c.filter("(grid_row + grid_col) % 5 <> 0"), c.filter("(grid_row * 3 + grid_col) % 7 <> 0").withColumn("pred", F.col("target") * 0.9 + 1)


@query(f"{MATCHED} SELECT season_id, grid_row, grid_col, round(a.target, 6) AS target, round(a.pred, 6) AS pred_a, round(b.pred, 6) AS pred_b FROM a JOIN b USING (season_id, grid_row, grid_col)")
def j05_matched_cells(spark, d):
    return V.rounded(J.matched(*_two(spark, d), KEY))


@query(f"""{MATCHED} SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, count(*) AS shared, round(count(*) / (SELECT count(*) FROM a), 6) AS coverage_a, round(count(*) / (SELECT count(*) FROM b), 6) AS coverage_b FROM a JOIN b USING (season_id, grid_row, grid_col)""")
def j05_coverage(spark, d):
    return V.rounded(J.coverage(*_two(spark, d), KEY))


@query(f"""{MATCHED} SELECT count(*) AS n, round(sqrt(avg((a.pred-a.target)*(a.pred-a.target))), 6) AS rmse_a, round(sqrt(avg((b.pred-a.target)*(b.pred-a.target))), 6) AS rmse_b FROM a JOIN b USING (season_id, grid_row, grid_col)""")
def a54_matched_scores(spark, d):
    m = J.matched(*_two(spark, d), KEY)
    rmse = lambda p: F.sqrt(F.avg((F.col(p) - F.col("target")) * (F.col(p) - F.col("target"))))
    return V.rounded(m.agg(F.count("*").alias("n"), rmse("pred_a").alias("rmse_a"), rmse("pred_b").alias("rmse_b")))


@query(f"""WITH {V.CELLS}, o AS (SELECT r, c FROM (SELECT unnest(range(-2, 3)) r), (SELECT unnest(range(-2, 3)) c)) SELECT a.season_id, a.grid_row, a.grid_col, CAST((r + 2) * 5 + c + 2 AS INT) AS k, b.target
 FROM cells a CROSS JOIN o LEFT JOIN cells b ON a.season_id = b.season_id AND b.grid_row = a.grid_row + r AND b.grid_col = a.grid_col + c WHERE a.season_id < 1000000""")
def j06_neighbour_gather(spark, d):
    return J.neighbours(V.cells(spark, d), "target")


@query(f"""WITH {V.CELLS}, n AS (SELECT a.season_id, a.grid_row, a.grid_col, avg(b.target) m FROM cells a LEFT JOIN cells b ON a.season_id = b.season_id AND abs(b.grid_row - a.grid_row) <= 2 AND abs(b.grid_col - a.grid_col) <= 2
 AND (b.grid_row <> a.grid_row OR b.grid_col <> a.grid_col) GROUP BY 1, 2, 3) SELECT season_id, grid_row, grid_col, round(m, 6) AS neighbour_mean FROM n""")
def a32_neighbourhood_mean(spark, d):
    return V.rounded(J.neighbourhood_mean(V.cells(spark, d), "target"))


@query(f"{V.PANEL} SELECT CASE WHEN fold = 0 THEN 'test' WHEN fold = 1 THEN 'val' ELSE 'train' END AS partition, count(*) AS n FROM cells JOIN seasons USING (season_id) GROUP BY 1")
def j07_partition_membership(spark, d):
    a = V.seasons(spark, d).select("season_id", F.when(F.col("fold") == 0, "test").when(F.col("fold") == 1, "val").otherwise("train").alias("partition"))
    return V.cells(spark, d).join(a, "season_id").groupBy("partition").agg(F.count("*").alias("n"))


@query(f"""WITH {V.ACQ}, x AS (SELECT cell_id, CAST((month(day) - 1) * 3 + least(2, (day(day) - 1) // 10) + 36 AS INT) AS slot, b, day FROM acq) SELECT cell_id, slot, round(sum(b), 4) AS slot_sum, count(b) AS days FROM x
 WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' GROUP BY 1, 2""")
def j08_daily_to_slot(spark, d):
    a = V.acq(spark, d).filter("day between date'2024-01-05' and date'2024-01-25'")
    x = a.groupBy("cell_id", C.ten_day_slot(F.col("day"), F.lit(2024)).alias("slot")).agg(F.sum("b").alias("slot_sum"), F.count("b").alias("days"))
    return V.rounded(x, 4)


@query(f"""WITH {V.ACQ}, e AS (SELECT cell_id, day, sum(b) v FROM acq GROUP BY 1, 2), s AS (SELECT cell_id, day, lag(day) OVER (PARTITION BY cell_id ORDER BY day) p FROM (SELECT DISTINCT cell_id, day FROM acq WHERE clear = 1)),
 j AS (SELECT s.cell_id, s.day, s.p, sum(e.v) t, count(e.v) n FROM s LEFT JOIN e ON e.cell_id = s.cell_id AND e.day BETWEEN s.p AND s.day GROUP BY 1, 2, 3)
 SELECT cell_id, day, p AS previous, CASE WHEN n = date_diff('day', p, day) + 1 THEN round(t, 4) END AS interval_sum FROM j""")
def j09_inclusive_interval_sums(spark, d):
    a = V.acq(spark, d)
    return V.rounded(J.inclusive_interval_sums(a.filter("clear = 1").select("cell_id", "day").distinct(), a, ["cell_id"], "day", "b"), 4)


@query(f"""WITH {V.ACQ}, s AS (SELECT cell_id, row_number() OVER w - 1 AS slot, CASE WHEN clear = 1 THEN day(day) END AS t, b FROM acq WINDOW w AS (PARTITION BY cell_id ORDER BY day, event_id)),
 p AS (SELECT *, last_value(t IGNORE NULLS) OVER (PARTITION BY cell_id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) p FROM s),
 o AS (SELECT cell_id, b, t - p + 1 AS n, CASE WHEN t IS NOT NULL AND p IS NOT NULL THEN greatest(0.0, least(t + 1.0, 25.0) - greatest(p, 5.0)) ELSE 0 END AS ov FROM p),
 g AS (SELECT cell_id, sum(ov) c, sum(CASE WHEN ov > 0 THEN b / n * ov END) v FROM o GROUP BY 1) SELECT cell_id, round(c / 20, 6) AS coverage, CASE WHEN c / 20 >= 0.5 THEN round(v * 20 / c, 4) END AS b FROM g""")
def j10_weather_window(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("cell_id").orderBy("day", "event_id")
    s = V.acq(spark, d).select("cell_id", (F.row_number().over(w) - 1).alias("slot"), F.when(F.col("clear") == 1, F.dayofmonth("day")).alias("t"), "b")
    x = J.window_from_intervals(s, ["cell_id"], "t", ["b"], F.lit(5.0), F.lit(25.0))
    return x.select("cell_id", (F.round("coverage", 6) + 0.0).alias("coverage"), (F.round("b", 4) + 0.0).alias("b"))


@query("""WITH p AS (SELECT c_custkey AS point, (c_custkey % 97) / 13.0 AS lon, (c_custkey % 89) / 11.0 AS lat FROM customer), k AS (SELECT *, round_even(lon * 10, 0) / 10 AS gx, round_even(lat * 10, 0) / 10 AS gy FROM p)
 SELECT round(gx, 4) AS gx, round(gy, 4) AS gy, count(*) AS points FROM k GROUP BY 1, 2""")
def j11_weather_cell_of_points(spark, d):
    k = F.col("c_custkey")
    p = V.table(spark, d, "customer").select(C.weather_cell(k % 97 / 13.0).alias("gx"), C.weather_cell(k % 89 / 11.0).alias("gy"))
    return V.rounded(p.groupBy("gx", "gy").agg(F.count("*").alias("points")), 4)


@query("""WITH c AS (SELECT n_nationkey AS state, (n_nationkey * 5) % 40 AS seeding, (n_nationkey * 7) % 40 AS harvest FROM nation WHERE n_nationkey % 2 = 0), x AS (SELECT s_suppkey, seeding, harvest, coalesce(seeding < harvest, false) AS ok FROM supplier LEFT JOIN c ON state = s_nationkey)
 SELECT s_suppkey, CASE WHEN ok THEN seeding ELSE 10 END AS seeding, CASE WHEN ok THEN harvest ELSE 30 END AS harvest, CASE WHEN ok THEN 'calendar' ELSE 'fallback' END AS calendar_source FROM x""")
def j12_calendar_with_fallback(spark, d):
    n = F.col("n_nationkey")
    cal = V.table(spark, d, "nation").filter("n_nationkey % 2 = 0").select(n.alias("s_nationkey"), (n * 5 % 40).alias("seeding"), (n * 7 % 40).alias("harvest"))
    s = V.table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    x = J.with_fallback(s, cal, ["s_nationkey"], ["seeding", "harvest"], {"seeding": F.lit(10), "harvest": F.lit(30)}, F.col("__seeding") < F.col("__harvest"))
    return x.select("s_suppkey", "seeding", "harvest", "calendar_source")


@query(f"""WITH {V.CELLS}, f AS (SELECT season_id, avg(target) m, stddev_pop(target) s, count(*) n FROM cells GROUP BY 1) SELECT c.season_id, grid_row, grid_col, round(m, 6) AS field_mean, round(s, 6) AS field_std FROM cells c LEFT JOIN f ON f.season_id = c.season_id AND n >= 430""")
def j13_field_context(spark, d):
    c = V.cells(spark, d)
    f = c.groupBy("season_id").agg(F.avg("target").alias("field_mean"), F.stddev_pop("target").alias("field_std"), F.count("*").alias("n")).filter("n >= 430").drop("n")
    return V.rounded(c.join(f, "season_id", "left").select(*KEY, "field_mean", "field_std"))


@query(f"""WITH {V.CELLS}, c AS (SELECT * FROM cells WHERE (grid_row + grid_col) % 3 = 0), r AS (SELECT season_id s, grid_row r, grid_col k, CASE WHEN grid_row % 4 = 0 THEN target + 1 ELSE target END v FROM cells WHERE grid_col <> 5)
 SELECT count(*) AS cells, round(avg((r IS NOT NULL)::int), 6) AS inside, round(avg(coalesce(abs(target - v) <= 0.01, false)::int), 6) AS equal,
 (SELECT round(avg(coalesce(abs(target - v) <= 0.01, false)::int), 6) FROM c LEFT JOIN r ON season_id = s AND grid_row = k AND grid_col = r) AS equal_swapped,
 (SELECT count(*) FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE season_id = s AND grid_row = r AND grid_col = k)) AS uncovered FROM c LEFT JOIN r ON season_id = s AND grid_row = r AND grid_col = k""")
def j14_raster_correspondence(spark, d):
    c = V.cells(spark, d)
    raster = c.filter("grid_col <> 5").withColumn("target", F.when(F.col("grid_row") % 4 == 0, F.col("target") + 1).otherwise(F.col("target")))
    return V.rounded(J.correspondence(raster, c.filter("(grid_row + grid_col) % 3 = 0"), "target", 0.01, by=["season_id"]))


@query("""SELECT l.doc_id % 7 AS grp, count(*) AS n, count(CASE WHEN quality = toxic THEN 1 END) AS agreeing FROM labels l GROUP BY 1""")
def j16_agreement_flag(spark, d):
    labels = V.table(spark, d, "labels")
    x = J.agreeing(labels.select("doc_id", F.col("quality").alias("v")), labels.select("doc_id", F.col("toxic").alias("v")), ["doc_id"], "v")
    return x.groupBy((F.col("doc_id") % 7).alias("grp")).agg(F.count("*").alias("n"), F.count_if("agrees").alias("agreeing"))


@query("""WITH g AS (SELECT doc_id, 'quality' AS kind, quality::DOUBLE AS gold FROM labels), e AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE (n_chars % 100) / 100.0 END AS said FROM documents WHERE doc_id % 13 <> 0)
 SELECT kind, count(e.doc_id) AS matched, count(CASE WHEN e.doc_id IS NULL THEN 1 END) AS unmatched, count(CASE WHEN e.doc_id IS NOT NULL AND said IS NULL THEN 1 END) AS unknown, round(avg(abs(said - gold)), 6) AS mae, round(avg((said - gold)*(said - gold)), 6) AS brier FROM g LEFT JOIN e USING (doc_id) GROUP BY 1""")
def j20_annotation_audit(spark, d):
    gold = V.table(spark, d, "labels").select("doc_id", F.lit("quality").alias("kind"), F.col("quality").cast("double").alias("value"))
    said = V.table(spark, d, "documents").filter("doc_id % 13 <> 0").select("doc_id", F.when(F.col("doc_id") % 11 != 0, F.col("n_chars") % 100 / 100.0).alias("value"))
    return V.rounded(J.annotation_audit(said, gold, ["doc_id"]))


@query(f"""WITH {V.CELLS}, b AS (SELECT season_id, grid_row // 8 AS br, grid_col // 8 AS bc, count(*) n FROM cells GROUP BY 1, 2, 3) SELECT br * 4 + bc AS block, CAST(count(*) AS BIGINT) AS seasons, CAST(sum(n) AS BIGINT) AS cells FROM b GROUP BY 1""")
def j21_cells_to_blocks(spark, d):
    c = V.cells(spark, d).withColumn("block", F.floor(F.col("grid_row") / 8) * 4 + F.floor(F.col("grid_col") / 8))
    return c.groupBy("block").agg(F.count_distinct("season_id").alias("seasons"), F.count("*").alias("cells"))


@query(f"""WITH {V.CELLS}, p AS (SELECT abs((a.pred - b.pred) - (a.target - b.target)) e, greatest(abs(a.grid_row - b.grid_row), abs(a.grid_col - b.grid_col)) d FROM cells a JOIN cells b ON a.season_id = b.season_id
 AND abs(a.grid_row - b.grid_row) <= 2 AND abs(a.grid_col - b.grid_col) <= 2 AND (a.grid_row, a.grid_col) < (b.grid_row, b.grid_col)), h AS (SELECT CASE WHEN e <= 1 THEN 0.5*e*e ELSE e - 0.5 END v, CASE WHEN d = 1 THEN 0.5 ELSE 1.0 END w FROM p)
 SELECT count(*) AS pairs, round(sum(v*w)/sum(w), 6) AS relation FROM h""")
def j22_relation_metric(spark, d):
    return V.rounded(J.relation_metric(V.cells(spark, d), 2))


@query("""SELECT user_id AS cell_id, coalesce(round(avg(CASE WHEN event_type = 'view' THEN value END), 4), 0) AS view, coalesce(round(avg(CASE WHEN event_type = 'click' THEN value END), 4), 0) AS click, coalesce(round(avg(CASE WHEN event_type = 'error' THEN value END), 4), 0) AS error,
 count(CASE WHEN event_type = 'view' THEN value END) > 0 AS has_view, count(CASE WHEN event_type = 'click' THEN value END) > 0 AS has_click, count(CASE WHEN event_type = 'error' THEN value END) > 0 AS has_error FROM events GROUP BY 1""")
def j23_stacked_modalities(spark, d):
    return V.rounded(J.stacked_modalities(V.acq(spark, d), ["cell_id"], "scene", "b", ["view", "click", "error"]), 4)


@query(f"""WITH {V.ACQ}, f AS (SELECT cell_id, day(day) // 3 AS bin, avg(b) b FROM acq WHERE clear = 1 GROUP BY 1, 2), u AS (SELECT DISTINCT cell_id FROM f), k AS (SELECT unnest(range(0, 11)) AS bin)
 SELECT cell_id, CAST(bin AS INT) AS bin, round(b, 6) AS b, b IS NULL AS is_empty, count(*) OVER (PARTITION BY cell_id) - count(b) OVER (PARTITION BY cell_id) AS n_empty FROM u CROSS JOIN k LEFT JOIN f USING (cell_id, bin)""")
def j24_binned_frames(spark, d):
    f = V.acq(spark, d).filter("clear = 1").withColumn("bin", F.floor(F.dayofmonth("day") / 3).cast("int"))
    return V.rounded(J.binned_frames(f, spark.range(11).select(F.col("id").cast("int").alias("bin")), ["cell_id"], "b"), 6)


@query(f"""WITH {V.CELLS} SELECT season_id, round(avg(target), 8) AS a, round(avg(pred), 8) AS b, round(avg(target) - avg(pred), 8) AS difference FROM cells GROUP BY 1""")
def j25_paired_arms(spark, d):
    c = V.cells(spark, d)
    return V.rounded(J.paired_arms(c.groupBy("season_id").agg(F.avg("target").alias("v")), c.groupBy("season_id").agg(F.avg("pred").alias("v")), ["season_id"], "v"), 8)


# --- windows -------------------------------------------------------------------------------------


@query(f"""WITH {V.ACQ}, s AS (SELECT cell_id, event_id, CASE WHEN clear = 1 THEN day END AS d, row_number() OVER (PARTITION BY cell_id ORDER BY day, event_id) AS slot FROM acq)
 SELECT event_id, CAST(slot AS INT) AS slot, CAST(min(CASE WHEN d IS NOT NULL THEN slot END) OVER (PARTITION BY cell_id) AS INT) AS first_slot, last_value(d IGNORE NULLS) OVER (PARTITION BY cell_id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_day FROM s""")
def w01_w02_dated_slots(spark, d):
    s = _series(spark, d)
    return X.previous_dated(X.first_dated(s, ["cell_id"], "slot", "obs_day"), ["cell_id"], ["slot"], "obs_day").select("event_id", "slot", "first_slot", "previous_day")


def _series(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("cell_id").orderBy("day", "event_id")
    return V.acq(spark, d).select("cell_id", "event_id", "scene", "b", F.row_number().over(w).alias("slot"), F.when(F.col("clear") == 1, F.col("day")).alias("obs_day"))


@query(f"""WITH {V.ACQ}, s AS (SELECT cell_id, event_id, b, CASE WHEN clear = 1 THEN day END AS d, row_number() OVER (PARTITION BY cell_id ORDER BY day, event_id) AS slot FROM acq),
 f AS (SELECT *, min(CASE WHEN d IS NOT NULL THEN slot END) OVER (PARTITION BY cell_id) AS first FROM s) SELECT event_id, CASE WHEN d IS NOT NULL THEN b END AS optical, CASE WHEN d IS NOT NULL AND slot > first THEN b END AS weather FROM f""")
def f01_temporal_validity(spark, d):
    s = _series(spark, d).withColumns({"optical": F.col("b"), "weather": F.col("b")})
    return X.temporal_validity(s, ["cell_id"], ["optical"], ["weather"]).select("event_id", "optical", "weather")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN abs(l_quantity - 25) <= 20 THEN l_quantity - 25 END AS curvature FROM lineitem""")
def f02_static_validity(spark, d):
    l = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") - 25).alias("curvature"))  # noqa: E741
    return X.static_validity(l, ["curvature"], {"curvature": 20.0})


@query(f"""WITH {V.ACQ}, x AS (SELECT day(day) AS t, 5 + cell_id % 5 AS s, 20 + cell_id % 8 AS h FROM acq) SELECT m AS mode, count(CASE WHEN CASE m WHEN 'all_slots' THEN true WHEN 'harvest' THEN t <= h WHEN 'before_harvest' THEN t <= h - 4 ELSE t <= s + 4 END THEN 1 END) AS visible
 FROM x, (SELECT unnest(['all_slots', 'harvest', 'before_harvest', 'after_seeding']) AS m) GROUP BY 1""")
def f03_prediction_cutoff(spark, d):
    a = V.acq(spark, d).select(F.dayofmonth("day").alias("t"), (5 + F.col("cell_id") % 5).alias("s"), (20 + F.col("cell_id") % 8).alias("h"))
    seen = [F.count_if(X.before_cutoff(F.col("t"), m, F.col("s"), F.col("h"), 4)).alias(m) for m in ("all_slots", "harvest", "before_harvest", "after_seeding")]
    return a.agg(*seen).unpivot([], ["all_slots", "harvest", "before_harvest", "after_seeding"], "mode", "visible")


@query(f"WITH {V.ACQ} SELECT cell_id, count(*) AS acquisitions, count(CASE WHEN clear = 1 AND b > 0 THEN 1 END) AS clear_cells, count(CASE WHEN b > 400 THEN 1 END) AS saturated FROM acq GROUP BY 1")
def f05_f06_a29_composite_counts(spark, d):
    clear = (F.col("clear") == 1) & F.forall(F.array("b"), lambda x: x > 0)
    return V.acq(spark, d).groupBy("cell_id").agg(F.count("*").alias("acquisitions"), F.count_if(clear).alias("clear_cells"), F.count_if(F.col("b") > 400).alias("saturated"))


@query(f"""WITH s AS (SELECT unnest(range(0, 72)) AS slot), x AS (SELECT CAST(slot AS INT) AS slot, make_date(2023 + CAST(slot // 36 AS INT), CAST((slot % 36) // 3 + 1 AS INT), CAST((slot % 3) * 10 + 1 AS INT)) AS first_day, slot % 3 AS t FROM s),
 b AS (SELECT slot, first_day, CASE WHEN t = 2 THEN last_day(first_day) ELSE first_day + 9 END AS last_day FROM x), k AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)
 SELECT slot, greatest(first_day, DATE '2024-01-05') AS lo, least(last_day, DATE '2024-01-25') AS hi, coalesce(CAST(sum(n) AS BIGINT), 0) AS n FROM b LEFT JOIN k ON day BETWEEN first_day AND last_day WHERE first_day <= DATE '2024-01-25' AND last_day >= DATE '2024-01-05' GROUP BY 1, 2, 3""")
def p18_f07_slot_bounds(spark, d):
    s = C.slot_bounds(spark, 2024).withColumns({"lo": F.greatest("first_day", F.lit("2024-01-05").cast("date")), "hi": F.least("last_day", F.lit("2024-01-25").cast("date"))}).filter("lo <= hi")
    n = V.acq(spark, d).groupBy(C.ten_day_slot(F.col("day"), F.lit(2024)).alias("slot")).agg(F.count("*").alias("n"))
    return s.join(n, "slot", "left").select("slot", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {V.CELLS} SELECT season_id, grid_row, grid_col, round(1 - (row_number() OVER (PARTITION BY season_id ORDER BY target, grid_row, grid_col) - 1) / (count(*) OVER (PARTITION BY season_id) - 1), 6) AS low_rank FROM cells")
def w03_inverse_rank(spark, d):
    return V.rounded(X.inverse_rank(V.cells(spark, d), ["season_id"], ["target", "grid_row", "grid_col"]).select(*KEY, "low_rank"))


@query(f"""WITH {V.CELLS}, x AS (SELECT *, avg(target) OVER w m, stddev_pop(target) OVER w s, count(*) OVER w n FROM cells WINDOW w AS (PARTITION BY season_id)) SELECT season_id, grid_row, grid_col, CASE WHEN n >= 3 AND s > 0 THEN round(greatest(-1.5, least(1.5, (target-m)/s)), 6) END AS z FROM x""")
def w04_clipped_z(spark, d):
    return V.rounded(X.clipped_z(V.cells(spark, d), ["season_id"], "target", clip=1.5).select(*KEY, "z"))


@query(f"""WITH {V.CELLS}, r AS (SELECT season_id, quantile_cont(target, 0.95) - quantile_cont(target, 0.05) AS relief FROM cells GROUP BY 1) SELECT season_id, grid_row, grid_col, round(target - avg(target) OVER (PARTITION BY season_id), 6) AS anomaly, round(relief, 6) AS relief,
 round(1 - (row_number() OVER (PARTITION BY season_id ORDER BY target, grid_row, grid_col) - 1) / (count(*) OVER (PARTITION BY season_id) - 1), 6) AS low_rank FROM cells JOIN r USING (season_id)""")
def a34_terrain_position(spark, d):
    return V.rounded(X.terrain_position(V.cells(spark, d), ["season_id"], "target", ["grid_row", "grid_col"]).select(*KEY, "anomaly", "relief", "low_rank"))


@query(f"""WITH {V.ACQ}, x AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY clear DESC, scene, day DESC, event_id) i FROM acq) SELECT cell_id, event_id, CASE WHEN clear = 1 THEN b END AS b FROM x WHERE i = 1""")
def w06_best_acquisition(spark, d):
    return X.best_acquisition(V.acq(spark, d), ["cell_id"], "clear", "scene", "day", "event_id", ["b"]).select("cell_id", "event_id", "b")


@query(f"""WITH {V.ACQ}, x AS (SELECT cell_id, (day(day) - 1) // 10 AS slot, b, event_id, day, row_number() OVER (PARTITION BY cell_id, (day(day) - 1) // 10 ORDER BY abs(day(day) - ((day(day) - 1) // 10 * 10 + 5.5)), day, event_id) i, count(*) OVER (PARTITION BY cell_id, (day(day) - 1) // 10) n FROM acq WHERE clear = 1)
 SELECT cell_id, CAST(slot AS INT) AS slot, event_id, b, n AS n_candidates FROM x WHERE i = 1""")
def w07_nearest_to_centre(spark, d):
    a = V.acq(spark, d).filter("clear = 1").withColumn("slot", F.floor((F.dayofmonth("day") - 1) / 10).cast("int"))
    return X.nearest_to_centre(a, ["cell_id", "slot"], F.abs(F.dayofmonth("day") - (F.col("slot") * 10 + 5.5)), ["day", "event_id"], ["event_id", "b"])


@query(f"""WITH {V.ACQ}, x AS (SELECT cell_id, event_id, b, least(3, greatest(0, floor(day(day) / 32.0 * 4))) AS k FROM acq), f AS (SELECT *, row_number() OVER (PARTITION BY cell_id, k ORDER BY b DESC, event_id) = 1 AS first FROM x),
 o AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY first DESC, b DESC, event_id) i FROM f) SELECT cell_id, event_id FROM o WHERE i <= 4""")
def w08_spread_observations(spark, d):
    a = V.acq(spark, d).withColumn("fraction", F.dayofmonth("day") / 32.0)
    return X.spread_observations(a, ["cell_id"], "fraction", "b", 4, ["event_id"]).select("cell_id", "event_id")


@query(f"""WITH {V.ACQ}, x AS (SELECT cell_id, event_id, scene, CASE WHEN lag(scene) OVER (PARTITION BY cell_id ORDER BY event_id) = scene THEN 0 ELSE 1 END c FROM acq), r AS (SELECT *, sum(c) OVER (PARTITION BY cell_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) run FROM x)
 SELECT cell_id, CAST(run AS BIGINT) AS run, scene, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM r GROUP BY cell_id, run, scene""")
def w09_runs(spark, d):
    return X.runs(V.acq(spark, d), ["event_id"], "scene", ["cell_id"])


@query("""WITH x AS (SELECT user_id AS cell_id, day(ts) AS week, CASE WHEN event_type = 'error' THEN NULL ELSE floor(value * 10) END AS t FROM events) SELECT cell_id, CAST(min(CASE WHEN t >= 1500 THEN week END) AS INT) AS week FROM x GROUP BY 1""")
def w10_first_crossing(spark, d):
    e = V.table(spark, d, "events").select(F.col("user_id").alias("cell_id"), F.dayofmonth("ts").alias("week"), F.when(F.col("event_type") == "error", "n/a").otherwise(F.format_number(F.floor(F.col("value") * 10).cast("int"), 0)).alias("t"))
    return X.first_crossing(e, ["cell_id"], "t", "week", 1500.0)


@query(f"""WITH {V.CELLS}, k AS (SELECT unnest(range(1, 6)) AS d), f AS (SELECT a.season_id, a.grid_row, a.grid_col, d FROM cells a, k, cells b WHERE a.season_id = b.season_id AND abs(a.grid_row - b.grid_row) <= d AND abs(a.grid_col - b.grid_col) <= d
 GROUP BY 1, 2, 3, 4 HAVING count(*) = (2 * d + 1) * (2 * d + 1)) SELECT season_id, grid_row, grid_col, CAST(coalesce(max(d), 0) AS INT) AS edge FROM cells LEFT JOIN f USING (season_id, grid_row, grid_col) GROUP BY 1, 2, 3""")
def w11_edge_distance(spark, d):
    return X.edge_distance(V.cells(spark, d)).select(*KEY, "edge")


@query(f"""WITH {V.ACQ} SELECT event_id, CAST(date_diff('day', lag(day) OVER (PARTITION BY cell_id ORDER BY day, event_id), day) AS INT) AS interval FROM acq""")
def w12_interval_lengths(spark, d):
    return X.interval_lengths(V.acq(spark, d), ["cell_id"], ["day", "event_id"], "day").select("event_id", "interval")


@query(f"""WITH {V.ACQ} SELECT cell_id, max(CASE WHEN clear = 1 THEN event_id END) AS last_slot FROM acq GROUP BY 1""")
def w13_last_valid_slot(spark, d):
    return X.last_valid(V.acq(spark, d), ["cell_id"], "event_id", F.col("clear") == 1)


@query(f"""WITH {V.CELLS}, t AS (SELECT season_id, grid_row // 8 AS tr, grid_col // 8 AS tc, count(*) n FROM cells GROUP BY 1, 2, 3), o AS (SELECT *, row_number() OVER (PARTITION BY season_id ORDER BY n DESC, tr, tc) i FROM t) SELECT season_id, tr, tc, n FROM o WHERE i = 1""")
def w14_best_tile(spark, d):
    t = V.cells(spark, d).groupBy("season_id", F.floor(F.col("grid_row") / 8).alias("tr"), F.floor(F.col("grid_col") / 8).alias("tc")).agg(F.count("*").alias("n"))
    return X.best_per(t, ["season_id"], [F.col("n").desc(), F.col("tr"), F.col("tc")])


@query("""SELECT conv_id, turn, last_value(CASE WHEN role <> 'assistant' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS heading FROM conversations""")
def w15_carried_forward(spark, d):
    c = V.table(spark, d, "conversations")
    return X.carried_forward(c, ["conv_id"], ["turn"], F.when(F.col("role") != "assistant", F.col("text")), "heading").select("conv_id", "turn", "heading")


@query(f"WITH {V.CELLS} SELECT season_id, grid_row, grid_col, round(avg(target) OVER (PARTITION BY season_id, grid_row // 4, grid_col // 4), 6) AS block_mean FROM cells")
def a30_block_mean(spark, d):
    return V.rounded(X.block_mean(V.cells(spark, d), "target", 4, ["season_id"]).select(*KEY, "block_mean"))


@query(f"WITH {V.CELLS} SELECT season_id, grid_row AS slot, CASE WHEN count(*) >= 12 THEN round(avg(target), 6) END AS mean, CASE WHEN count(*) >= 12 THEN round(stddev_pop(target), 6) END AS std, count(*) AS n FROM cells GROUP BY 1, 2")
def a31_field_slot_stats(spark, d):
    g = V.cells(spark, d).groupBy("season_id", F.col("grid_row").alias("slot")).agg(F.avg("target").alias("mean"), F.stddev_pop("target").alias("std"), F.count("*").alias("n"))
    return V.rounded(g.withColumns({c: F.when(F.col("n") >= 12, F.col(c)) for c in ("mean", "std")}))


@query(f"""WITH {V.ACQ}, x AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY day, event_id) - 1 AS i FROM acq WHERE day(day) BETWEEN 1 AND 28) SELECT cell_id, event_id FROM x WHERE i % 2 = 0""")
def f10_first_days_every_second(spark, d):
    return X.alternate(V.acq(spark, d).filter(F.dayofmonth("day").between(1, 28)), ["cell_id"], ["day", "event_id"]).select("cell_id", "event_id")
