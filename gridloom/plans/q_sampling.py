"""Queries: scalars, sampling, splits, reshaping, bootstraps and kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as C
from ..operators import kernels as K
from ..operators import metrics as M
from ..operators import resampling as B
from ..operators import reshape as R
from ..operators import sampling as T
from ..operators import splits as G
from . import views as V
from .registry import query

KEY = ["season_id", "grid_row", "grid_col"]
H = T.mixed_sql


# --- scalars -------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_partkey, round((q - r) / nullif(q + r + 1e-8, 0), 6) + 0.0 AS ndvi, round(2.5 * (q - r) / nullif(q + 6 * r - 7.5 * b + 1, 0), 6) + 0.0 AS evi, CASE WHEN q > 0 AND r > 0 THEN round((q - r) / (q + r), 6) + 0.0 END AS ratio
 FROM (SELECT l_orderkey, l_partkey, l_quantity AS q, l_discount * 100 AS r, l_tax * 10 AS b FROM lineitem)""")
def p01_p04_spectral_indices(spark, d):
    l = V.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.col("l_quantity").alias("nir"), (F.col("l_discount") * 100).alias("red"), (F.col("l_tax") * 10).alias("blue"))  # noqa: E741
    x = C.with_indices(l).withColumn("ratio", C.guarded_ratio(F.col("nir"), F.col("red")))
    return V.rounded(x.select("l_orderkey", "l_partkey", "ndvi", "evi", "ratio"))


@query("""SELECT l_orderkey, l_partkey, round((CASE WHEN l_linenumber >= 4 AND l_returnflag <> 'R' THEN greatest(0, e - 1000) ELSE e END) / 10000.0, 6) AS refl FROM (SELECT *, CAST(floor(l_extendedprice) AS BIGINT) AS e FROM lineitem)""")
def p05_harmonised_reflectance(spark, d):
    l = V.table(spark, d, "lineitem")  # noqa: E741
    x = C.reflectance(C.harmonised(F.floor("l_extendedprice"), F.col("l_linenumber"), F.col("l_returnflag") == "R"))
    return V.rounded(l.select("l_orderkey", "l_partkey", x.alias("refl")))


@query("""WITH q AS (SELECT user_id, quantile_cont(ln(1 + greatest(value, 0)), 0.99) AS p FROM events GROUP BY 1) SELECT event_id, round(greatest(0, least(1, ln(1 + greatest(value, 0)) / CASE WHEN p > 0 THEN p ELSE 1 END)), 6) AS sar FROM events JOIN q USING (user_id)""")
def p06_sar_normalised(spark, d):
    return V.rounded(C.sar_normalised(V.table(spark, d, "events"), "value", ["user_id"]).select("event_id", "sar"))


@query("""WITH x AS (SELECT event_id, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS t FROM events) SELECT event_id, round((t - 19700) / 365.0, 6) AS since, round(sin(2 * pi() * (t % 365.2425) / 365.2425), 6) AS sin_day, round(cos(2 * pi() * (t % 365.2425) / 365.2425), 6) AS cos_day FROM x""")
def p07_time_features(spark, d):
    t = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date"))
    s, c = C.season_angle(t)
    return V.rounded(V.table(spark, d, "events").select("event_id", C.since_seeding(t, F.lit(19700)).alias("since"), s.alias("sin_day"), c.alias("cos_day")))


@query("""SELECT c_custkey, round(sin(radians(a)), 6) + 0.0 AS s, round(cos(radians(a)), 6) + 0.0 AS c, round(cos(radians(a - CASE k WHEN 0 THEN 180 WHEN 1 THEN 180 WHEN 2 THEN 180 ELSE 0 END)), 6) + 0.0 AS pole FROM (SELECT c_custkey, (c_custkey * 37) % 360 AS a, c_custkey % 4 AS k FROM customer)""")
def p08_p09_aspect(spark, d):
    k = F.col("c_custkey")
    x = V.table(spark, d, "customer").select(k, (k * 37 % 360).cast("double").alias("a"), F.get(F.array(*map(F.lit, C.POLE_AZIMUTH)), (k % 4).cast("int")).alias("country"))
    s, c = C.aspect_parts(F.col("a"))
    return V.rounded(x.select("c_custkey", s.alias("s"), c.alias("c"), C.pole_facing(F.col("a"), F.col("country")).alias("pole")))


@query("""WITH x AS (SELECT l_orderkey, l_partkey, (l_quantity * 5 + l_extendedprice * 10 + l_discount * 15) / 30 AS clay, l_quantity AS silt, l_tax AS sand FROM lineitem) SELECT l_orderkey, l_partkey, round(clay, 6) AS clay, round((clay + silt) / (clay + silt + sand), 6) AS fine FROM x""")
def p10_depth_weighted_soil(spark, d):
    x = V.table(spark, d, "lineitem").withColumn("clay", C.depth_weighted([F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount")]))
    return V.rounded(x.select("l_orderkey", "l_partkey", "clay", C.fine_fraction(F.col("clay"), F.col("l_quantity"), F.col("l_tax")).alias("fine")))


@query("""SELECT c_custkey, round(cos(radians(b)) * cos(radians(a)), 6) AS x, round(cos(radians(b)) * sin(radians(a)), 6) AS y, round(sin(radians(b)), 6) AS z,
 concat(CAST(floor(b / (20 / 111.0)) AS BIGINT), ':', CAST(floor(a / (20 / (111.0 * greatest(0.1, cos(radians(b)))))) AS BIGINT)) AS block FROM (SELECT c_custkey, (c_custkey * 7) % 360 - 179.7 AS a, (c_custkey * 3) % 170 - 84.6 AS b FROM customer)""")
def p11_p14_sphere_and_blocks(spark, d):
    k = F.col("c_custkey")
    p = V.table(spark, d, "customer").select(k, (k * 7 % 360 - 179.7).cast("double").alias("lon"), (k * 3 % 170 - 84.6).cast("double").alias("lat"))
    x, y, z = C.unit_sphere(F.col("lon"), F.col("lat"))
    return V.rounded(p.select("c_custkey", x.alias("x"), y.alias("y"), z.alias("z"), C.block_id(F.col("lat"), F.col("lon"), 20.0).alias("block")))


@query(f"""WITH {V.CELLS} SELECT season_id, grid_row, grid_col, round(500000.0 + season_id * 1000 + 10 * (grid_col + 0.5), 4) AS x, round(6000000.0 - 10 * (grid_row + 0.5), 4) AS y FROM cells""")
def p15_cell_centres(spark, d):
    affine = F.array(F.lit(10.0), F.lit(0.0), F.lit(500000.0) + F.col("season_id") * 1000, F.lit(0.0), F.lit(-10.0), F.lit(6000000.0))
    x, y = C.cell_centre(F.col("grid_row"), F.col("grid_col"), affine)
    return V.rounded(V.cells(spark, d).select(*KEY, x.alias("x"), y.alias("y")), 4)


@query("""SELECT s_suppkey, concat('DUP', s_suppkey % 3) AS provider, concat('farm', s_suppkey % 7) AS farm, concat('field', s_suppkey) AS field, CASE s_suppkey % 2 WHEN 0 THEN 'corn' ELSE 'wheat' END AS crop, CAST(2018 + s_suppkey % 6 AS INT) AS year, CASE s_suppkey % 2 WHEN 0 THEN 'G-C' ELSE 'G-W' END AS pair FROM supplier""")
def p16_p17_season_names(spark, d):
    k = F.col("s_suppkey")
    name = F.concat(F.lit("Germany_DUP"), k % 3, F.lit("_farm"), k % 7, F.lit("_field"), k, F.when(k % 2 == 0, "_corn_").otherwise("_wheat_"), 2018 + k % 6)
    x = V.table(spark, d, "supplier").select(k, C.parse_season_name(name).alias("p"))
    return x.select("s_suppkey", "p.provider", "p.farm", "p.field", "p.crop", "p.year", C.pair_code(F.col("p.country"), F.col("p.crop"), {"Germany": "G"}, {"corn": "C", "wheat": "W"}).alias("pair"))


@query("""WITH m AS (SELECT o_orderkey, unnest(generate_series(date_trunc('month', o_orderdate), date_trunc('month', o_orderdate) + INTERVAL 2 MONTH, INTERVAL 1 MONTH)) AS month FROM orders) SELECT CAST((year(month) - 1996) * 12 + month(month) - 1 AS INT) AS slot, count(*) AS n FROM m GROUP BY 1""")
def p19_month_slots(spark, d):
    o = V.table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("a"), F.add_months(F.to_date("o_orderdate"), 2).alias("b"))
    return C.months_between(o, "a", "b").groupBy(C.month_slot(F.col("month"), F.lit(1997)).alias("slot")).agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT CAST(l_partkey % 256 AS INT) AS code FROM lineitem) SELECT coalesce(CASE WHEN code = 1 THEN 'corn' WHEN code = 5 THEN 'soybean' WHEN code = 24 THEN 'winter_wheat' WHEN code IN (22, 23) THEN 'spring_wheat' WHEN code = 31 THEN 'canola'
 WHEN code BETWEEN 1 AND 61 OR code BETWEEN 66 AND 80 OR code BETWEEN 200 AND 255 THEN 'other_crop' END, 'none') AS crop_group, count(*) AS n FROM x GROUP BY 1""")
def p20_crop_groups(spark, d):
    return V.table(spark, d, "lineitem").groupBy(F.coalesce(C.crop_group((F.col("l_partkey") % 256).cast("int")), F.lit("none")).alias("crop_group")).agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT s_suppkey AS k, ['corn', 'soybean', 'winter_wheat', 'spring_wheat', 'canola', 'other_crop'][1 + s_suppkey % 6] AS g, CAST(2018 + s_suppkey % 5 AS INT) AS y, ['WA', 'NV', 'IA', 'TX', 'ZZ'][1 + s_suppkey % 5] AS s FROM supplier)
 SELECT k, CASE g WHEN 'corn' THEN make_date(y, 5, 1) WHEN 'soybean' THEN make_date(y, 5, 15) WHEN 'winter_wheat' THEN make_date(y - 1, 10, 1) WHEN 'spring_wheat' THEN make_date(y, 4, 25) WHEN 'canola' THEN make_date(y, 5, 5) ELSE make_date(y, 4, 1) END AS seeding,
 CASE g WHEN 'corn' THEN make_date(y, 10, 15) WHEN 'soybean' THEN make_date(y, 10, 15) WHEN 'winter_wheat' THEN make_date(y, 7, 1) WHEN 'spring_wheat' THEN make_date(y, 8, 20) WHEN 'canola' THEN make_date(y, 8, 25) ELSE make_date(y, 10, 31) END AS harvest,
 CASE s WHEN 'WA' THEN 'northwest' WHEN 'NV' THEN 'west' WHEN 'IA' THEN 'upper_midwest' WHEN 'TX' THEN 'south' END AS region FROM x""")
def p21_p22_regions_and_seasons(spark, d):
    k = F.col("s_suppkey")
    pick = lambda xs: F.get(F.array(*map(F.lit, xs)), (k % len(xs)).cast("int"))
    s, h = C.fallback_season(pick(C.FALLBACK_SEASONS), (2018 + k % 5).cast("int"))
    return V.table(spark, d, "supplier").select(k.alias("k"), s.alias("seeding"), h.alias("harvest"), C.climate_region(pick(["WA", "NV", "IA", "TX", "ZZ"])).alias("region"))


@query("""SELECT p_partkey, trim(regexp_replace(lower(trim(concat(p_brand, ' / ', p_type))), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part""")
def p23_slugs(spark, d):
    return V.table(spark, d, "part").select("p_partkey", C.slug(F.concat_ws(" / ", "p_brand", "p_type")).alias("slug"))


@query(f"""WITH {V.CELLS}, q AS (SELECT season_id, min(target) lo, max(target) hi, quantile_cont(target, 0.02) a, quantile_cont(target, 0.98) b FROM cells GROUP BY 1)
 SELECT season_id, grid_row, grid_col, CASE WHEN hi > lo THEN round((target - lo) / (hi - lo), 6) END AS scaled, CAST(floor(greatest(0, least(1, (target - a) / greatest(b - a, 1e-6))) * 255) AS INT) AS shown FROM cells JOIN q USING (season_id)""")
def p27_p29_scaling(spark, d):
    x = C.display_stretch(C.min_max(V.cells(spark, d), "target", ["season_id"], "scaled"), "target", ["season_id"], "shown")
    return V.rounded(x.select(*KEY, "scaled", "shown"))


@query(f"""WITH {V.CELLS}, q AS (SELECT quantile_cont(target, [0.2, 0.4, 0.6, 0.8]) AS q FROM cells) SELECT season_id, grid_row, grid_col, (target > q[1])::int + (target > q[2])::int + (target > q[3])::int + (target > q[4])::int AS colour FROM cells, q""")
def p28_quantile_classes(spark, d):
    return C.quantile_classes(V.cells(spark, d), "target", [], [0.2, 0.4, 0.6, 0.8], "colour").select(*KEY, "colour")


# --- sampling ------------------------------------------------------------------------------------

CELL = "season_id * 1024 + grid_row * 32 + grid_col"


@query(f"WITH {V.CELLS}, x AS (SELECT *, row_number() OVER (PARTITION BY season_id ORDER BY {H(CELL)}, grid_row, grid_col) i FROM cells) SELECT season_id, grid_row, grid_col FROM x WHERE i <= 50")
def t01_capped_rows(spark, d):
    return T.capped(V.cells(spark, d), ["season_id"], F.expr(CELL), 50, ["grid_row", "grid_col"]).select(*KEY)


@query(f"""WITH {V.CELLS}, s AS (SELECT season_id, sqrt(count(*)) w FROM cells GROUP BY 1), p AS (SELECT season_id, (sum(w) OVER (ORDER BY season_id) - w) / sum(w) OVER () lo, sum(w) OVER (ORDER BY season_id) / sum(w) OVER () hi FROM s),
 d AS (SELECT range AS draw, ({H('range', 3)} + 0.5) / 4294967296 AS u FROM range(500)) SELECT draw, season_id FROM d JOIN p ON u >= lo AND u < hi""")
def t02_balanced_draws(spark, d):
    return T.balanced_draws(V.cells(spark, d).groupBy("season_id").agg(F.count("*").alias("n")), "season_id", 500, 0.5, 3)


@query(f"""WITH {V.CELLS}, s AS (SELECT season_id, sqrt(count(*)) w, count(*) m FROM cells GROUP BY 1), p AS (SELECT season_id, m, (sum(w) OVER (ORDER BY season_id) - w) / sum(w) OVER () lo, sum(w) OVER (ORDER BY season_id) / sum(w) OVER () hi FROM s),
 d AS (SELECT draw, season_id, m, CAST(floor(({H('draw', 1)} + 0.5) / 4294967296 * m) AS BIGINT) AS start FROM (SELECT range AS draw, ({H('range', 0)} + 0.5) / 4294967296 AS u FROM range(100)) JOIN p ON u >= lo AND u < hi), r AS (SELECT *, row_number() OVER (PARTITION BY season_id ORDER BY grid_row, grid_col) - 1 AS i FROM cells)
 SELECT draw, CAST(step AS INT) AS step, d.season_id, grid_row, grid_col FROM d, (SELECT range AS step FROM range(16)) JOIN r ON r.season_id = d.season_id AND r.i = (start + step) % m""")
def t02_contiguous_blocks(spark, d):
    c = V.cells(spark, d)
    draws = T.balanced_draws(c.groupBy("season_id").agg(F.count("*").alias("n")), "season_id", 100)
    return T.contiguous_block(draws, c, "season_id", ["grid_row", "grid_col"], 16).select("draw", "step", *KEY)


@query(f"""WITH {V.CELLS}, a AS (SELECT season_id AS draw, season_id, grid_row r, grid_col c FROM (SELECT *, row_number() OVER (PARTITION BY season_id ORDER BY {H(CELL)}, grid_row, grid_col) i FROM cells) WHERE i = 1),
 x AS (SELECT draw, cells.season_id, grid_row, grid_col, row_number() OVER (PARTITION BY draw ORDER BY (grid_row = r AND grid_col = c) DESC, {H('grid_row * 1024 + grid_col + draw * 7')}, grid_row, grid_col) i FROM a JOIN cells ON cells.season_id = a.season_id AND abs(grid_row - r) <= 3 AND abs(grid_col - c) <= 3)
 SELECT draw, season_id, grid_row, grid_col FROM x WHERE i <= 8""")
def t03_cluster_draws(spark, d):
    c = V.cells(spark, d)
    anchors = T.capped(c, ["season_id"], F.expr(CELL), 1, ["grid_row", "grid_col"]).select(F.col("season_id").alias("draw"), *KEY)
    return T.cluster_draws(anchors, c, 3, 8)


@query(f"""WITH {V.CELLS}, x AS (SELECT *, row_number() OVER (PARTITION BY season_id ORDER BY {H(CELL)}, grid_row, grid_col) - 1 i, count(*) OVER (PARTITION BY season_id) n FROM cells), y AS (SELECT *, CAST(ceil((600 - i) / least(n, 600)::DOUBLE) AS BIGINT) t FROM x WHERE i < 600)
 SELECT season_id, grid_row, grid_col, CAST(unnest(range(1, t + 1)) AS INT) AS draw FROM y""")
def t04_context_rows(spark, d):
    return T.context_rows(V.cells(spark, d), ["season_id"], F.expr(CELL), 600, ["grid_row", "grid_col"]).select(*KEY, "draw")


@query(f"""{V.PANEL}, w AS (SELECT country, crop, sum(n_rows)::DOUBLE w FROM seasons GROUP BY 1, 2), x AS (SELECT *, least(2, 100 // count(*) OVER k) f, sum(w) OVER k s FROM w WINDOW k AS (PARTITION BY country)), y AS (SELECT *, w / s * (100 - sum(f) OVER (PARTITION BY country)) sh FROM x),
 z AS (SELECT *, floor(sh) b, 100 - sum(f) OVER (PARTITION BY country) - sum(floor(sh)) OVER (PARTITION BY country) l, row_number() OVER (PARTITION BY country ORDER BY sh - floor(sh) DESC, crop) i FROM y) SELECT country, crop, CAST(f + b + (i <= l)::int AS BIGINT) AS quota FROM z""")
def t06_largest_remainder(spark, d):
    w = V.seasons(spark, d).groupBy("country", "crop").agg(F.sum("n_rows").cast("double").alias("w"))
    return T.largest_remainder(w, ["country"], "crop", "w", F.lit(100), 2).select("country", "crop", "quota")


@query("""SELECT n_nationkey AS k, [2021, 2022, 2023, 2024, 2025][1 + y] AS year, CAST((n_nationkey + 3) // 5 + (((y - n_nationkey % 5 + 5) % 5) < (n_nationkey + 3) % 5)::int AS BIGINT) AS quota FROM nation, (SELECT unnest(range(0, 5)) AS y)""")
def t07_year_quotas(spark, d):
    n = F.col("n_nationkey")
    x = V.table(spark, d, "nation").select(n.alias("k"), (n + 3).alias("n"), (n % 5).alias("o"))
    return T.year_quotas(x, "n", [2021, 2022, 2023, 2024, 2025], "o").select("k", "year", "quota")


@query(f"""WITH c AS (SELECT c_custkey AS id, c_mktsegment AS stratum, (c_custkey % 100) / 200.0 AS share, 1.0 + c_custkey % 17 AS w FROM customer WHERE c_custkey % 10 <> 3), t AS (SELECT *, CASE WHEN count(CASE WHEN share >= 0.25 THEN 1 END) OVER k >= 5 THEN 0.25 WHEN count(CASE WHEN share >= 0.1 THEN 1 END) OVER k >= 5 THEN 0.1 ELSE 0.02 END AS threshold FROM c WINDOW k AS (PARTITION BY stratum)),
 e AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY -ln(({H('id')} + 0.5) / 4294967296) / w, id) i FROM t WHERE share >= threshold) SELECT stratum, id, threshold::DOUBLE AS threshold FROM e WHERE i <= 5""")
def t08_select_clusters(spark, d):
    k = F.col("c_custkey")
    c = V.table(spark, d, "customer").select(k.alias("id"), F.col("c_mktsegment").alias("stratum"), (k % 100 / 200.0).alias("share"), (1.0 + k % 17).alias("w"))
    quota = c.select("stratum").distinct().withColumn("quota", F.lit(5))
    return T.select_clusters(c, ["stratum"], quota, "share", "w", "id", c.filter("id % 10 = 3")).select("stratum", "id", "threshold")


@query(f"""WITH {V.CELLS}, x AS (SELECT *, row_number() OVER (PARTITION BY season_id, grid_row // 4, grid_col // 4 ORDER BY {H(CELL)}, {CELL}) i FROM cells WHERE target >= 20) SELECT season_id, grid_row, grid_col FROM x WHERE i = 1""")
def t09_thinned_points(spark, d):
    c = V.cells(spark, d).withColumn("k", F.expr(CELL))
    return T.thinned(c, [F.col("season_id"), F.floor(F.col("grid_row") / 4), F.floor(F.col("grid_col") / 4)], "k", F.col("target") >= 20).select(*KEY)


@query("""SELECT p_brand, CAST(count(*) AS BIGINT) AS importance FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def t10_top_features(spark, d):
    g = V.table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("importance"))
    return T.top(g, [F.col("importance").desc(), F.col("p_brand")], 5)


@query(f"""SELECT event_id, CASE WHEN ({H('user_id * 131 + day(ts)', 1)} + 0.5) / 4294967296 < 0.5 + ({H('user_id')} + 0.5) / 4294967296 * 0.5 THEN value END AS value FROM events""")
def t11_observation_dropout(spark, d):
    return T.observation_dropout(V.table(spark, d, "events"), F.col("user_id"), F.dayofmonth("ts"), ["value"]).select("event_id", "value")


@query(f"""SELECT event_id, CASE WHEN ({H('event_id', 5)} + 0.5) / 4294967296 >= 0.3 THEN value END AS value, ({H('event_id', 5)} + 0.5) / 4294967296 < 0.3 AND value IS NOT NULL AS is_masked FROM events""")
def t12_masked_observations(spark, d):
    return T.masked_observations(V.table(spark, d, "events"), F.col("event_id"), 0.3, "value", 5).select("event_id", "value", "is_masked")


@query("""WITH x AS (SELECT user_id, event_id, value, max(event_id) OVER w l, count(*) OVER w n FROM events WINDOW w AS (PARTITION BY user_id)) SELECT x.event_id, x.value, y.value AS target FROM x JOIN events y ON y.event_id = x.l WHERE n >= 2 AND x.event_id < l""")
def t12_forecast_split(spark, d):
    return T.forecast_split(V.table(spark, d, "events"), ["user_id"], "event_id", "value").select("event_id", "value", "target")


@query("""SELECT o_custkey, max(o_totalprice) AS best, arg_max(o_orderkey, row(o_totalprice, -o_orderkey)) AS o_orderkey FROM orders GROUP BY 1""")
def t13_best_entry(spark, d):
    return V.table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("best"), F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("o_orderkey"))


@query(f"""{V.PANEL} SELECT crop, count(CASE WHEN ({CELL}) * 2654435761 % 1000 < 250 THEN 1 END) AS dropped, count(*) AS n, round(avg(CASE WHEN ({CELL}) * 2654435761 % 1000 >= 250 THEN target END), 6) AS kept_mean FROM cells JOIN seasons USING (season_id) GROUP BY 1""")
def t16_dropped_stream(spark, d):
    x = T.drop_stream(V.panel(spark, d).withColumn("k", F.expr(CELL)), "k", 0.25, ["target"])
    return V.rounded(x.groupBy("crop").agg(F.count_if("dropped").alias("dropped"), F.count("*").alias("n"), F.avg("target").alias("kept_mean")))


@query(f"""{V.PANEL}, m AS (SELECT crop, season_id, round(avg(abs(pred - target)), 9) AS e FROM cells JOIN seasons USING (season_id) GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY crop ORDER BY e, season_id) i, count(*) OVER (PARTITION BY crop) n FROM m) SELECT crop, season_id FROM o WHERE i = n // 2 + 1""")
def t17_representative_season(spark, d):
    e = V.panel(spark, d).groupBy("crop", "season_id").agg(F.round(F.avg(F.abs(F.col("pred") - F.col("target"))), 9).alias("e"))
    return T.representative(e, ["crop"], "e", "season_id").select("crop", "season_id")


# --- splits --------------------------------------------------------------------------------------


def _with_field(spark, d):
    return V.seasons(spark, d).withColumn("physical_field_id", F.concat(F.lit("g"), F.floor(F.col("season_id") / 3)))


FIELD = V.PANEL + ", sf AS (SELECT *, concat('g', season_id // 3) AS physical_field_id FROM seasons)"


@query(f"""WITH RECURSIVE {V.BOXES}, l AS (SELECT a.id a, b.id b FROM boxes a JOIN boxes b ON a.grp = b.grp AND a.id <> b.id WHERE greatest(0, least(a.x0+a.w, b.x0+b.w) - greatest(a.x0, b.x0)) * greatest(0, least(a.y0+a.h, b.y0+b.h) - greatest(a.y0, b.y0)) >= 0.1 *
 (a.w*a.h + b.w*b.h - greatest(0, least(a.x0+a.w, b.x0+b.w) - greatest(a.x0, b.x0)) * greatest(0, least(a.y0+a.h, b.y0+b.h) - greatest(a.y0, b.y0)))),
 r AS (SELECT id AS node, id AS root FROM boxes UNION SELECT l.a, r.root FROM r JOIN l ON l.b = r.node WHERE r.root < l.a) SELECT node, min(root) AS root FROM r GROUP BY 1""")
def g01_connected_fields(spark, d):
    return G.connected_boxes(V.boxes(spark, d), ["grp"])


@query("""WITH x AS (SELECT s_nationkey AS root, s_suppkey FROM supplier) SELECT root, string_agg(CAST(s_suppkey AS VARCHAR), '+' ORDER BY CAST(s_suppkey AS VARCHAR)) AS label FROM x GROUP BY 1""")
def g01_joined_labels(spark, d):
    return G.joined_labels(V.table(spark, d, "supplier").select(F.col("s_nationkey").alias("root"), F.col("s_suppkey").alias("member")))


_SHARES = {"train": 0.65, "val": 0.15, "test": 0.2}
_LACK = {p: f"{share} * total - {p}" for p, share in _SHARES.items()}
_PICK = f"CASE WHEN {_LACK['train']} >= greatest({_LACK['val']}, {_LACK['test']}) THEN 'train' WHEN {_LACK['val']} >= {_LACK['test']} THEN 'val' ELSE 'test' END"


@query(f"""{V.PANEL.replace('WITH', 'WITH RECURSIVE', 1)}, g AS (SELECT country, farm_id, CAST(sum(n_rows) AS DOUBLE) AS n FROM seasons GROUP BY 1, 2),
 o AS (SELECT *, sum(n) OVER (PARTITION BY country) AS total, row_number() OVER (PARTITION BY country ORDER BY n * (0.5 + ({H(C.text_key_sql('farm_id'))} + 0.5) / 4294967296) DESC, farm_id) AS i FROM g),
 w AS (SELECT country, farm_id, n, i, total, 'train' AS p, n AS train, CAST(0 AS DOUBLE) AS val, CAST(0 AS DOUBLE) AS test FROM o WHERE i = 1 UNION ALL
  SELECT country, farm_id, n, i, total, p, train + CASE WHEN p = 'train' THEN n ELSE 0 END, val + CASE WHEN p = 'val' THEN n ELSE 0 END, test + CASE WHEN p = 'test' THEN n ELSE 0 END FROM (SELECT o.country, o.farm_id, o.n, o.i, o.total, {_PICK.replace('total', 'o.total')} AS p, train, val, test FROM w JOIN o ON o.country = w.country AND o.i = w.i + 1)),
 k AS (SELECT country, count(*) FILTER (p = 'train') AS trains, count(*) FILTER (p = 'val') AS vals, count(*) FILTER (p = 'test') AS tests FROM w GROUP BY 1),
 v AS (SELECT w.country, farm_id, n, CASE WHEN vals = 0 AND greatest(trains, tests) > 1 AND p = CASE WHEN trains >= tests THEN 'train' ELSE 'test' END AND row_number() OVER (PARTITION BY w.country, p ORDER BY n, farm_id) = 1 THEN 'val' ELSE p END AS p FROM w JOIN k USING (country)),
 l AS (SELECT country, count(*) FILTER (p = 'train') AS trains, count(*) FILTER (p = 'val') AS vals, count(*) FILTER (p = 'test') AS tests FROM v GROUP BY 1)
 SELECT country, farm_id, CASE WHEN tests = 0 AND greatest(trains, vals) > 1 AND p = CASE WHEN trains >= vals THEN 'train' ELSE 'val' END AND row_number() OVER (PARTITION BY v.country, p ORDER BY n, farm_id) = 1 THEN 'test' ELSE p END AS partition FROM v JOIN l USING (country)""")
def g02_g03_greedy_assignment(spark, d):
    groups = V.seasons(spark, d).groupBy("country", "farm_id").agg(F.sum("n_rows").alias("n"))
    return G.assign_groups(groups, "country", "farm_id", "n")


ASSIGNED = FIELD + ", a AS (SELECT *, CASE WHEN season_id % 5 = 0 THEN 'test' WHEN season_id % 5 = 1 THEN 'val' ELSE 'train' END AS partition FROM sf)"


def _assigned(spark, d):
    k = F.col("season_id") % 5
    return _with_field(spark, d).withColumn("partition", F.when(k == 0, "test").when(k == 1, "val").otherwise("train"))


@query(f"""{ASSIGNED}, m AS (SELECT season_id, min(CASE partition WHEN 'test' THEN 0 WHEN 'val' THEN 1 ELSE 2 END) OVER (PARTITION BY physical_field_id) r FROM a) SELECT season_id, CASE r WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS partition FROM m""")
def g04_strictest_partition(spark, d):
    return G.strictest(_assigned(spark, d), "physical_field_id").select("season_id", "partition")


@query(f"""{ASSIGNED} SELECT 'physical_field_id' AS key, physical_field_id AS value, string_agg(DISTINCT partition, ',' ORDER BY partition) AS partitions FROM a GROUP BY 2 HAVING count(DISTINCT partition) > 1
 UNION ALL SELECT 'farm_id', farm_id, string_agg(DISTINCT partition, ',' ORDER BY partition) FROM a GROUP BY 2 HAVING count(DISTINCT partition) > 1""")
def g05_leaks(spark, d):
    return G.leaks(_assigned(spark, d), ["physical_field_id", "farm_id"]).withColumn("partitions", F.array_join("partitions", ","))


@query(f"""{V.PANEL} SELECT season_id, CAST(CASE WHEN season_id % 4 = 0 THEN 0 ELSE 2 END AS BIGINT) AS times FROM seasons WHERE season_id % 4 IN (0, 1)""")
def u03_cover_errors(spark, d):
    s = V.seasons(spark, d)
    a = s.filter("season_id % 4 <> 0").unionByName(s.filter("season_id % 4 = 1"))
    return G.cover_errors(a, s)


@query(f"{FIELD} SELECT season_id FROM sf WHERE season_id % 5 <> 0 AND physical_field_id IN (SELECT physical_field_id FROM sf WHERE season_id % 5 = 0)")
def u04_shares_ground(spark, d):
    s = _with_field(spark, d)
    return G.shares_ground(s, s.filter("season_id % 5 = 0"), "physical_field_id").select("season_id")


@query(f"""{FIELD} SELECT f.year AS fold, CASE WHEN s.year = f.year THEN 'test' ELSE 'other' END AS role, count(*) AS seasons, count(CASE WHEN s.year <> f.year AND EXISTS (SELECT 1 FROM sf t WHERE t.year = f.year AND t.physical_field_id = s.physical_field_id) THEN 1 END) AS overlap
 FROM (SELECT DISTINCT year FROM sf) f, sf s GROUP BY 1, 2""")
def g06_leave_year_out_folds(spark, d):
    x = G.folds_by(_with_field(spark, d), "year", "physical_field_id")
    return x.groupBy("fold", F.when(F.col("partition") == "test", "test").otherwise("other").alias("role")).agg(F.count("*").alias("seasons"), F.count_if("shares_ground").alias("overlap"))


@query(f"""{FIELD} SELECT f.year AS fold, count(*) AS seasons FROM (SELECT DISTINCT year FROM sf) f, sf s WHERE s.year = f.year OR NOT EXISTS (SELECT 1 FROM sf t WHERE t.year = f.year AND t.physical_field_id = s.physical_field_id) GROUP BY 1""")
def g06_strict_folds(spark, d):
    return G.folds_by(_with_field(spark, d), "year", "physical_field_id", "strict").groupBy("fold").agg(F.count("*").alias("seasons"))


@query(f"""{V.PANEL.replace('WITH', 'WITH RECURSIVE', 1)}, u AS (SELECT farm_id, country, CAST(greatest(1, n_rows // 100) AS DOUBLE) AS w FROM seasons), m AS (SELECT farm_id, list(w ORDER BY country) AS v FROM (SELECT f.farm_id, c.country, coalesce(sum(u.w), 0) AS w FROM (SELECT DISTINCT farm_id FROM u) f CROSS JOIN (SELECT DISTINCT country FROM u) c LEFT JOIN u ON u.farm_id = f.farm_id AND u.country = c.country GROUP BY 1, 2) GROUP BY 1),
 o AS (SELECT farm_id, v, row_number() OVER (ORDER BY -round(list_aggregate(v, 'stddev_pop'), 9), {H(C.text_key_sql('farm_id'))}, farm_id) AS i FROM m), t AS (SELECT list(w ORDER BY country) AS total FROM (SELECT country, sum(w) AS w FROM u GROUP BY 1)),
 r AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS farm_id, CAST(NULL AS INT) AS fold, list_transform(range(3), lambda f: list_transform(total, lambda x: CAST(0 AS DOUBLE))) AS have FROM t
  UNION ALL SELECT i, farm_id, CAST(best.f AS INT), cand[best.f + 1] FROM (SELECT i, farm_id, cand, list_sort(list_transform(range(3), lambda f: {{'score': round(list_avg(list_transform(range(1, len(total) + 1), lambda s: list_aggregate(list_transform(cand[f + 1], lambda x: x[s] / total[s]), 'stddev_pop'))), 12), 'held': list_sum(cand[f + 1][f + 1]), 'f': f}}))[1] AS best
   FROM (SELECT o.i, o.farm_id, total, list_transform(range(3), lambda f: list_transform(have, lambda x, j: CASE WHEN j = f + 1 THEN list_transform(x, lambda y, s: y + v[s]) ELSE x END)) AS cand FROM r JOIN o ON o.i = r.i + 1, t)))
 SELECT farm_id, fold FROM r WHERE i > 0""")
def g07_stratified_group_folds(spark, d):
    return G.stratified_group_folds(V.seasons(spark, d), "farm_id", "country", 3)


@query(f"{ASSIGNED} SELECT partition, count(*) AS n FROM (SELECT CASE WHEN partition = 'test' THEN 'test' ELSE 'train' END AS partition FROM a UNION ALL SELECT 'val' FROM a WHERE partition = 'test') GROUP BY 1")
def g08_without_validation(spark, d):
    return G.without_validation(_assigned(spark, d)).groupBy("partition").agg(F.count("*").alias("n"))


@query(f"""{V.PANEL}, t AS (SELECT fold AS pool, season_id FROM seasons) SELECT p.pool, s.season_id, CASE WHEN EXISTS (SELECT 1 FROM t WHERE t.pool = p.pool AND t.season_id = s.season_id) THEN 'test' ELSE 'train' END AS partition FROM (SELECT DISTINCT pool FROM t) p, seasons s""")
def g09_pooled_folds(spark, d):
    s = V.seasons(spark, d)
    return G.pooled_folds(s.select("fold", "season_id"), s, "fold")


@query(f"""{V.PANEL} SELECT CASE WHEN country IN ('ASIA') AND year = 2022 THEN 'test' WHEN country IN ('EUROPE') AND year = 2021 THEN 'val' WHEN country IN ('AFRICA', 'AMERICA', 'MIDDLE EAST') AND year < 2022 AND year >= 2019 THEN 'train' END AS partition, count(*) AS n FROM seasons GROUP BY 1 HAVING partition IS NOT NULL""")
def g10_cross_location(spark, d):
    x = G.cross_location(V.seasons(spark, d), "country", "year", {"test": ["ASIA"], "val": ["EUROPE"], "train": ["AFRICA", "AMERICA", "MIDDLE EAST"]}, 2022, 3)
    return x.groupBy("partition").agg(F.count("*").alias("n"))


@query(f"""WITH {V.CELLS}, b AS (SELECT DISTINCT season_id, grid_row // 4 AS br, grid_col // 4 AS bc FROM cells), o AS (SELECT *, (row_number() OVER (PARTITION BY season_id ORDER BY {H('br * 4096 + bc + season_id * 97')}, br, bc) - 1) % 5 AS fold FROM b)
 SELECT season_id, grid_row, grid_col, CAST(fold AS INT) AS fold FROM cells JOIN o ON o.season_id = cells.season_id AND br = grid_row // 4 AND bc = grid_col // 4""".replace("SELECT season_id, grid_row, grid_col, CAST", "SELECT cells.season_id, grid_row, grid_col, CAST"))
def g11_block_folds(spark, d):
    return G.block_folds(V.cells(spark, d), 4).select(*KEY, "fold")


@query(f"{FIELD} SELECT count(*) AS seasons, count(DISTINCT physical_field_id) AS fields FROM sf WHERE physical_field_id NOT IN (SELECT physical_field_id FROM sf WHERE fold = 0)")
def g12_pretraining_unit(spark, d):
    s = _with_field(spark, d)
    return G.pretraining_unit(s, s.filter("fold = 0"), "physical_field_id").agg(F.count("*").alias("seasons"), F.count_distinct("physical_field_id").alias("fields"))


@query(f"{ASSIGNED} SELECT partition, country, count(*) AS seasons, CAST(sum(n_rows) AS BIGINT) AS rows, count(DISTINCT farm_id) AS farms, string_agg(DISTINCT crop, ',' ORDER BY crop) AS crops FROM a GROUP BY 1, 2")
def a40_split_summary(spark, d):
    return G.split_summary(_assigned(spark, d))


@query(f"{ASSIGNED} SELECT partition, sha256(string_agg(CAST(season_id AS VARCHAR), ',' ORDER BY CAST(season_id AS VARCHAR))) AS hash, count(*) AS seasons FROM a GROUP BY 1")
def g13_s26_split_hash(spark, d):
    return G.split_hash(_assigned(spark, d), ["partition"])


@query(f"""{V.PANEL}, u AS (SELECT concat('u', season_id % 4) AS unit, CASE WHEN season_id % 4 < 2 THEN 'cv' ELSE 'year' END AS protocol, season_id FROM seasons WHERE season_id % 3 <> 0), t AS (SELECT concat('f', season_id % 6) AS fold, CASE WHEN season_id % 6 < 3 THEN 'cv' ELSE 'year' END AS protocol, season_id FROM seasons WHERE season_id % 8 < 1),
 z AS (SELECT unit, protocol up, count(*) n FROM u GROUP BY 1, 2), c AS (SELECT DISTINCT fold, protocol, unit, up, n FROM t, z WHERE NOT EXISTS (SELECT 1 FROM u JOIN t t2 ON t2.season_id = u.season_id WHERE u.unit = z.unit AND t2.fold = t.fold)),
 o AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY (protocol = up) DESC, n DESC, unit) i FROM c) SELECT fold, unit FROM o WHERE i = 1""")
def g15_unit_for_fold(spark, d):
    s, k = V.seasons(spark, d), F.col("season_id")
    u = s.filter("season_id % 3 <> 0").select(F.concat(F.lit("u"), k % 4).alias("unit"), F.when(k % 4 < 2, "cv").otherwise("year").alias("protocol"), k)
    t = s.filter("season_id % 8 < 1").select(F.concat(F.lit("f"), k % 6).alias("fold"), F.when(k % 6 < 3, "cv").otherwise("year").alias("protocol"), k)
    return G.unit_for_fold(u, t)


@query(f"""{V.PANEL}, c AS (SELECT season_id, row_number() OVER (ORDER BY season_id) i, count(*) OVER () n FROM seasons WHERE crop IN ('crop1', 'crop2')) SELECT count(*) AS seasons, max(greatest(1, round(n * 0.2)))::BIGINT AS val FROM c""")
def g16_donor_split(spark, d):
    x = G.donor_split(V.seasons(spark, d), F.col("crop").isin("crop1", "crop2"), 0.2)
    return x.agg(F.count("*").alias("seasons"), F.count_if(F.col("partition") == "val").alias("val"))


@query(f"""{V.PANEL}, f AS (SELECT DISTINCT crop AS pair, fold FROM seasons), m AS (SELECT * FROM (SELECT unnest(['s2', 's2w']) AS inputs), (SELECT unnest([1, 2, 3]) AS seed), (SELECT unnest(['crop0', 'crop1', 'crop9']) AS pair)) SELECT inputs, CAST(seed AS BIGINT) AS seed, m.pair, f.fold FROM m JOIN f USING (pair)""")
def g14_g17_run_matrix(spark, d):
    folds = V.seasons(spark, d).select(F.col("crop").alias("pair"), "fold").distinct()
    runs, _ = G.run_matrix({"inputs": ["s2", "s2w"], "seed": [1, 2, 3], "pair": ["crop0", "crop1", "crop9"]}, spark, folds, ["pair"])
    return runs


# --- reshape -------------------------------------------------------------------------------------


@query(f"WITH {V.CELLS} SELECT season_id, grid_row, " + ", ".join(f'max(CASE WHEN grid_col = {k} THEN target END) AS "target@{k}", max(CASE WHEN grid_col = {k} THEN 1 ELSE 0 END) = 1 AS "dated@{k}"' for k in range(4)) + " FROM cells GROUP BY 1, 2")
def r01_wide(spark, d):
    return R.wide(V.cells(spark, d), ["season_id", "grid_row"], "grid_col", list(range(4)), ["target"])


@query(f"""WITH {V.CELLS} SELECT season_id, CAST(grid_row // 16 AS INT) AS tile_row, CAST(grid_col // 16 AS INT) AS tile_col, min(grid_row) AS row0, max(grid_row) AS row1, min(grid_col) AS col0, max(grid_col) AS col1, count(*) AS cells, count(target) AS valid FROM cells GROUP BY 1, 2, 3 HAVING count(target) >= 100""")
def r02_f08_tiles(spark, d):
    return R.tiles(V.cells(spark, d), 16, ["season_id"], least=100)


@query(f"WITH {V.CELLS} SELECT season_id, CAST(grid_row // 10 * 3 + grid_col // 10 AS INT) AS tile, CAST(grid_row % 10 AS INT) AS r, CAST(grid_col % 10 AS INT) AS c, target FROM cells WHERE grid_row < 30 AND grid_col < 30")
def r03_retiled(spark, d):
    return R.retiled(V.cells(spark, d), 32, 32, 10).select("season_id", "tile", "r", "c", "target")


@query(f"WITH {V.CELLS}, p AS (SELECT unnest(range(0, 7)) AS a), q AS (SELECT unnest(range(0, 7)) AS b) SELECT season_id, CAST(a AS INT) AS patch_row, CAST(b AS INT) AS patch_col, count(*) AS cells, round(avg(target), 6) AS mean FROM cells, p, q WHERE grid_row BETWEEN a * 4 AND a * 4 + 7 AND grid_col BETWEEN b * 4 AND b * 4 + 7 GROUP BY 1, 2, 3")
def r04_stride_patches(spark, d):
    x = R.stride_patches(V.cells(spark, d), 32, 32, 8, 4)
    return V.rounded(x.groupBy("season_id", "patch_row", "patch_col").agg(F.count("*").alias("cells"), F.avg("target").alias("mean")))


@query(f"""WITH {V.CELLS} SELECT a.season_id, a.grid_row, a.grid_col, count(b.target) AS valid, round(sum(b.target * ((2 - (b.grid_col - a.grid_col)) * 5 + (b.grid_row - a.grid_row) + 2)), 4) AS turned FROM cells a LEFT JOIN cells b ON a.season_id = b.season_id AND abs(a.grid_row - b.grid_row) <= 2 AND abs(a.grid_col - b.grid_col) <= 2 GROUP BY 1, 2, 3""")
def r05_packed_windows(spark, d):
    t = R.rotated(R.packed_windows(V.cells(spark, d), "target"), "values", 5, 1)
    total = F.aggregate(F.transform("values", lambda v, i: F.coalesce(v, F.lit(0.0)) * i), F.lit(0.0), lambda a, v: a + v)
    return V.rounded(t.select(*KEY, F.size(F.filter("valid", lambda v: v)).cast("long").alias("valid"), total.alias("turned")), 4)


@query(f"WITH {V.CELLS} SELECT season_id, count(*) AS positions, (SELECT count(*) FROM cells c WHERE c.season_id = s.season_id) AS filled FROM (SELECT DISTINCT season_id FROM cells) s, range(1024) GROUP BY 1")
def r06_dense_grid(spark, d):
    g = R.dense_grid(V.cells(spark, d), ["season_id"], "target", 32, 32)
    return g.groupBy("season_id").agg(F.count("*").alias("positions"), F.count("target").alias("filled"))


@query(f"WITH {V.CELLS} SELECT season_id, grid_col AS r, grid_row AS c, target FROM cells")
def r07_augmented_tiles(spark, d):
    x = V.cells(spark, d).select("season_id", F.col("grid_row").alias("r"), F.col("grid_col").alias("c"), "target")
    return R.augmented(x, 32, 1, True)


@query("""SELECT user_id, max((CASE WHEN event_type = 'view' THEN value END IS NOT NULL)::int) = 1 AS has_optical, max((CASE WHEN event_type = 'error' THEN value END IS NOT NULL)::int) = 1 AS has_weather FROM events GROUP BY 1""")
def r08_stream_availability(spark, d):
    e = V.table(spark, d, "events").withColumns({k: F.when(F.col("event_type") == k, F.col("value")) for k in ("view", "error")})
    return R.stream_availability(e, ["user_id"], {"optical": ["view"], "weather": ["error"]})


# --- bootstraps and kernels ----------------------------------------------------------------------


def _arms(spark, d):
    p = V.panel(spark, d)
    return M.field_sums(p, ["crop", "season_id"]), M.field_sums(p.withColumn("pred", F.col("pred") * 0.99 + 0.2), ["crop", "season_id"])


def draws_sql(n: str, draws: int) -> str:
    return f"SELECT rep, d, {H('rep * 1000003 + d')} % {n} AS i FROM (SELECT range AS rep FROM range({draws})), (SELECT range AS d FROM range({n}))"


BOOT = f"""{V.PANEL}, f AS (SELECT fold, count(*) n, sum(target) sy, sum(target*target) syy, sum((pred-target)*(pred-target)) sa, sum((pred*0.99+0.2-target)*(pred*0.99+0.2-target)) sb FROM cells JOIN seasons USING (season_id) GROUP BY 1),
 k AS (SELECT *, row_number() OVER (ORDER BY fold) - 1 AS i FROM f), w AS ({draws_sql('5', 200)}), r AS (SELECT rep, (sum(sb) - sum(sa)) / (sum(syy) - sum(sy)*sum(sy)/sum(n)) AS d FROM w JOIN k USING (i) GROUP BY 1)"""


@query(f"""{BOOT} SELECT 'pooled' AS kind, round(avg(d), 6) AS mean, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high, count(*) AS replicates, (quantile_cont(d, 0.025) > 0 OR quantile_cont(d, 0.975) < 0) AS excludes_zero FROM r""")
def b01_fold_bootstrap(spark, d):
    p = V.panel(spark, d)
    arm = lambda x: M.fold_statistics(x, ["fold"]).withColumns({"wsse": F.lit(0.0), "wsst": F.lit(0.0)})
    return V.rounded(B.paired_bootstrap(arm(p), arm(p.withColumn("pred", F.col("pred") * 0.99 + 0.2)), "fold", 200).filter("kind = 'pooled'"))


#: Season sums of both arms, and how often each season of a crop is drawn in each of 200 replicates.
ARMS = f"""{V.PANEL}, c AS (SELECT crop, season_id, target y, pred a, pred * 0.99 + 0.2 b FROM cells JOIN seasons USING (season_id)),
 s AS (SELECT crop, season_id, count(*) n, sum(y) sy, sum(y*y) syy, sum((a-y)**2) ea, sum((b-y)**2) eb, var_pop(y) * count(*) wt, sum((a-y)**2) - sum(a-y)**2 / count(*) wa, sum((b-y)**2) - sum(b-y)**2 / count(*) wb FROM c GROUP BY 1, 2),
 k AS (SELECT *, row_number() OVER (PARTITION BY crop ORDER BY season_id) - 1 i, count(*) OVER (PARTITION BY crop) m FROM s), w AS (SELECT crop, rep, {H('rep * 1000003 + k.i')} % m AS i FROM k, (SELECT range AS rep FROM range(200))),
 r AS (SELECT crop, rep, (sum(eb) - sum(ea)) / (sum(syy) - sum(sy)**2 / sum(n)) pooled, (sum(wb) - sum(wa)) / sum(wt) AS within FROM w JOIN k USING (crop, i) GROUP BY 1, 2)"""
INTERVAL = "avg(d) AS mean, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high, count(*) AS replicates"


@query(f"""{ARMS}, z AS (SELECT crop, 'pooled' AS kind, pooled AS d FROM r UNION ALL SELECT crop, 'within', within FROM r), q AS (SELECT crop, kind, {INTERVAL} FROM z GROUP BY 1, 2)
 SELECT crop, kind, round(mean, 4) AS mean, round(low, 4) AS low, round(high, 4) AS high, replicates, (low > 0 OR high < 0) AS excludes_zero FROM q""")
def b02_season_bootstrap(spark, d):
    return V.rounded(B.paired_bootstrap(*_arms(spark, d), "season_id", 200, ["crop"]), 4)


@query(f"""{ARMS}, z AS (SELECT rep, avg(pooled) AS d FROM r GROUP BY 1), q AS (SELECT {INTERVAL} FROM z) SELECT round(mean, 4) AS mean, round(low, 4) AS low, round(high, 4) AS high, replicates, (low > 0 OR high < 0) AS excludes_zero FROM q""")
def b02_mean_over_pairs(spark, d):
    return V.rounded(B.mean_over_strata(*_arms(spark, d), "season_id", ["crop"], 200), 4)


@query(f"""{V.PANEL}, c AS (SELECT seed, season_id, target y, pred + sin(target + seed) p FROM cells JOIN seasons USING (season_id), (SELECT range AS seed FROM range(3))), s AS (SELECT seed, season_id, count(*) n, sum(y) sy, sum(y*y) syy, sum((p-y)**2) e FROM c GROUP BY 1, 2),
 u AS (SELECT season_id, row_number() OVER (ORDER BY season_id) - 1 i, count(*) OVER () m FROM (SELECT DISTINCT season_id FROM s)), w AS (SELECT rep, {H('rep * 1000003 + u.i')} % m AS i FROM u, (SELECT range AS rep FROM range(200))),
 r AS (SELECT rep, seed, 1 - sum(e) / (sum(syy) - sum(sy)**2 / sum(n)) r2 FROM w JOIN u USING (i) JOIN s USING (season_id) GROUP BY 1, 2), z AS (SELECT rep, avg(r2) d FROM r GROUP BY 1), q AS (SELECT {INTERVAL} FROM z)
 SELECT 'a' AS arm, round(mean, 4) AS mean, round(low, 4) AS low, round(high, 4) AS high, replicates, (low > 0 OR high < 0) AS excludes_zero FROM q""")
def b03_seed_averaged(spark, d):
    p = V.panel(spark, d)
    s = p.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("pred", F.col("pred") + F.sin(F.col("target") + F.col("seed")))
    return V.rounded(B.seed_averaged(M.field_sums(s.withColumn("arm", F.lit("a")), ["arm", "seed", "season_id"]), "season_id", "seed", "arm", 200), 4)


@query(f"""{V.PANEL}, s AS (SELECT season_id, sum(abs(pred-target) - 1) s, count(*) n FROM cells GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY season_id) - 1 AS i, count(*) OVER () AS m FROM s), x AS (SELECT rep, {H('rep * 1000003 + d')} % m AS i FROM (SELECT range AS rep FROM range(100)), (SELECT i AS d, m FROM k)),
 r AS (SELECT rep, sum(s)/sum(n) AS d FROM x JOIN k USING (i) GROUP BY 1) SELECT round(avg(d), 6) AS mean, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high, count(*) AS replicates, (quantile_cont(d, 0.025) > 0 OR quantile_cont(d, 0.975) < 0) AS excludes_zero FROM r""")
def b04_b05_difference_bootstrap(spark, d):
    x = V.cells(spark, d).withColumn("v", F.abs(F.col("pred") - F.col("target")) - 1)
    return V.rounded(B.difference_bootstrap(x, "season_id", "v", 100))


@query(f"""{V.PANEL}, g AS (SELECT crop, year, sum(pred*pred) xx, sum(pred*target) xy FROM cells JOIN seasons USING (season_id) GROUP BY 1, 2) SELECT crop, year, round((sum(xy) OVER (PARTITION BY crop) - xy) / (sum(xx) OVER (PARTITION BY crop) - xx), 6) AS beta FROM g""")
def b06_leave_year_out_blend(spark, d):
    x = B.leave_one_out_blend(V.panel(spark, d), ["crop"], "year", "target", ["pred"], (0.0, 3.0))
    return V.rounded(x.select("crop", "year", F.get("beta", F.lit(0)).alias("beta")))


def _scale_bands_sql() -> str:
    """All pairs of a season's cells weighed by the five Gaussians; differences of neighbouring scales, then sums by band."""
    weight = lambda s: f"CASE WHEN greatest(abs(p.r - q.r), abs(p.c - q.c)) <= {int(4 * s + 0.5)} THEN exp(-0.5 * ((p.r - q.r) * (p.r - q.r) + (p.c - q.c) * (p.c - q.c)) / {s * s}) ELSE 0 END"
    levels = ", ".join(f"sum(w{i} * q{v}) / sum(w{i}) AS {v}{i + 1}" for i in range(len(K.SIGMAS)) for v in "yp")
    last = len(K.SIGMAS)
    bands = ", ".join(f"{{'band': {i}, 'y': y{i} - y{i + 1}, 'p': p{i} - p{i + 1}}}" if i < last else f"{{'band': {i}, 'y': y{i}, 'p': p{i}}}" for i in range(last + 1))
    return f"""{V.PANEL}, x AS (SELECT crop, season_id, grid_row AS r, grid_col AS c, CAST(target AS DOUBLE) - avg(CAST(target AS DOUBLE)) OVER s AS y, CAST(pred AS DOUBLE) - avg(CAST(pred AS DOUBLE)) OVER s AS p FROM cells JOIN seasons USING (season_id) WINDOW s AS (PARTITION BY season_id) QUALIFY count(*) OVER s >= 50),
 w AS (SELECT p.crop, p.season_id, p.r, p.c, p.y AS y0, p.p AS p0, q.y AS qy, q.p AS qp, {", ".join(f"{weight(s)} AS w{i}" for i, s in enumerate(K.SIGMAS))} FROM x p JOIN x q USING (season_id)),
 l AS (SELECT crop, y0, p0, {levels} FROM w GROUP BY crop, season_id, r, c, y0, p0), b AS (SELECT crop, unnest([{bands}]) AS z FROM l),
 g AS (SELECT crop, CAST(z.band AS INT) AS band, sum(z.y * z.y) AS syy, sum(z.p * z.p) AS spp, sum(z.y * z.p) AS spy, sum((z.y - z.p) * (z.y - z.p)) AS see FROM b GROUP BY 1, 2)
 SELECT crop, band, round(syy / sum(syy) OVER (PARTITION BY crop), 5) AS share, round(1 - see / syy, 5) AS explained, round(spy / sqrt(syy * spp), 5) AS corr FROM g"""


@query(_scale_bands_sql())
def a23_a61_scale_bands(spark, d):
    return V.rounded(K.band_totals(K.scale_bands(V.panel(spark, d), ["crop"]), ["crop"]), 5)
