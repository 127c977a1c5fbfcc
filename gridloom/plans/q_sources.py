"""Queries: sources and sinks, rules, composite tables, reports and the streaming jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars as C
from ..operators import metrics as M
from ..operators import rules as Q
from ..operators import sampling as T
from ..operators import windows as X
from ..sources import tables as S
from ..streaming import jobs
from . import views as V
from .registry import query

KEY = ["season_id", "grid_row", "grid_col"]


@query("""SELECT lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS fips, [concat('r/weather/2020/', lpad(CAST(c_custkey AS VARCHAR), 5, '0'), '-04.csv'), concat('r/weather/2020/', lpad(CAST(c_custkey AS VARCHAR), 5, '0'), '-09.csv')] AS ends, 6 AS short_months, 60 AS long_months, 4 AS quarters FROM customer""".replace("[concat", "concat_ws(',', concat").replace("'-09.csv')]", "'-09.csv'))"))
def s01_s02_county_manifest(spark, d):
    c = V.table(spark, d, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 5, "0").alias("FIPS"), F.lit(2020).alias("y"))
    m = S.county_manifest(c, None, "y", "r")
    short = F.col("data.weather.short_term")
    return m.select(F.col("FIPS").alias("fips"), F.concat_ws(",", F.element_at(short, 1), F.element_at(short, -1)).alias("ends"), F.size(short).alias("short_months"), F.size(F.flatten("data.weather.long_term")).alias("long_months"), F.size("data.imagery").alias("quarters"))


@query("""SELECT year(o_orderdate)::INT AS year, lpad(CAST(o_custkey % 3 AS VARCHAR), 2, '0') AS state_ansi, lpad(CAST(o_custkey % 5 AS VARCHAR), 3, '0') AS county_ansi, round(o_totalprice * 2, 4) AS production, round(o_totalprice, 4) AS yield, round(ln(o_totalprice), 6) AS log_yield FROM orders WHERE o_custkey % 3 = 2 AND o_custkey % 5 = 4""")
def s03_county_yields(spark, d):
    k = F.col("o_custkey")
    t = V.table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), (k % 3).cast("string").alias("state_ansi"), (k % 5).cast("string").alias("county_ansi"), (F.col("o_totalprice") * 2).alias("production"), F.col("o_totalprice").alias("yield"))
    y = S.county_yields(t, "02", "004")
    return y.select("year", "state_ansi", "county_ansi", *[F.round(c, n).alias(c) for c, n in (("production", 4), ("yield", 4), ("log_yield", 6))])


@query("""SELECT user_id AS grid, count(*) AS days, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY day(ts), event_id) AS series FROM events WHERE day(ts) BETWEEN 1 AND 28 GROUP BY 1""")
def s04_s05_daily_series(spark, d):
    e = V.table(spark, d, "events").select(F.col("user_id").alias("grid"), F.dayofmonth("ts").alias("day"), "event_id")
    s = S.daily_series(e, ["grid"], "day", ["event_id"])
    return s.select("grid", F.size("series").cast("long").alias("days"), F.array_join(F.transform("series", lambda x: x["event_id"].cast("string")), ",").alias("series"))


@query("SELECT doc_id, lang, source FROM documents")
def s06_strict_columns(spark, d):
    return S.strict_columns(V.table(spark, d, "documents"), ["doc_id", "lang", "source"])


@query("SELECT c_custkey, n_name AS nation FROM customer JOIN nation ON n_nationkey = c_nationkey")
def s07_decoded_codes(spark, d):
    dic = V.table(spark, d, "nation").select(F.lit("nation").alias("var"), F.col("n_nationkey").alias("code"), F.col("n_name").alias("value"))
    c = V.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    return S.decoded(c, dic, "nation", "nation")


@query("SELECT event_id, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INT) AS obs_day FROM events")
def s08_days_since_1970(spark, d):
    days = F.datediff(F.to_date("ts"), F.lit("2016-01-01").cast("date"))
    return V.table(spark, d, "events").select("event_id", C.days_since_1970(F.lit("days since 2016-01-01"), days, F.lit("standard")).alias("obs_day"))


@query(f"{V.PANEL} SELECT season_id, count(*) AS n_rows, min(grid_row) AS row0, max(grid_row) AS row1, min(grid_col) AS col0, max(grid_col) AS col1, round(avg(target), 6) AS target_mean, round(stddev_pop(target), 6) AS target_std, min(crop) AS crop, CAST(count(DISTINCT year) AS INT) AS year_values FROM cells JOIN seasons USING (season_id) GROUP BY 1")
def s09_season_table(spark, d):
    return V.rounded(S.season_table(V.panel(spark, d), constant=("crop",), dates=("year",)))


@query("""SELECT l_suppkey AS season_id, l_partkey % 32 AS grid_row, arg_min(l_quantity, row(l_orderkey, l_linenumber, l_quantity)) AS dem, (max(l_quantity) - min(l_quantity) > 0)::int AS flags FROM lineitem GROUP BY 1, 2""")
def s13_canonical_statics(spark, d):
    l = V.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("season_id"), (F.col("l_partkey") % 32).alias("grid_row"), F.struct("l_orderkey", "l_linenumber", "l_quantity").alias("slot"), F.col("l_quantity").alias("dem"), F.col("l_shipdate").alias("obs_day"))  # noqa: E741
    return X.canonical(l, ["season_id", "grid_row"], ["dem"])


@query("""SELECT regexp_extract(u, '^(\\w+)/(\\w+)/', 1) AS grp, regexp_extract(u, '^(\\w+)/(\\w+)/', 2) AS inputs, count(*) AS n FROM (SELECT concat(lang, '/', source, '/fold', doc_id % 5) AS u FROM documents) GROUP BY 1, 2""")
def s18_run_parts(spark, d):
    u = V.table(spark, d, "documents").select(F.concat_ws("/", "lang", "source", F.concat(F.lit("fold"), F.col("doc_id") % 5)).alias("u"))
    x = S.with_run_parts(u, r"^(\w+)/(\w+)/fold(\d+)", ["grp", "inputs", "fold"], F.col("u"))
    return x.groupBy("grp", "inputs").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) % 100 AS a, o_orderkey % 90 + 10 AS b FROM orders) SELECT k, 'm' AS model, p AS pair, CASE p WHEN 'A' THEN a / 100.0 ELSE b / 100.0 END AS r2_mean, 0.07 AS r2_std, CASE p WHEN 'A' THEN 1.13 ELSE 2.5 END AS rmse_mean, CASE p WHEN 'A' THEN 0.22 ELSE 0.3 END AS rmse_std, CASE WHEN k % 2 = 0 THEN 'CV10' ELSE 'LOYO' END AS protocol FROM r, (SELECT unnest(['A', 'B']) AS p)""")
def s20_benchmark_text(spark, d):
    k = F.col("o_orderkey")
    two = lambda c: F.concat(F.lit("0."), F.lpad(c.cast("string"), 2, "0"))
    body = F.concat(F.lit("m "), two(F.floor("o_totalprice") % 100), F.lit("±0.071.13±0.22"), two(k % 90 + 10), F.lit("±0.072.5±0.3"))
    lines = V.table(spark, d, "orders").select(k.alias("k"), F.posexplode(F.array(F.when(k % 2 == 0, "CV10").otherwise("LOYO"), F.lit("junk"), body)).alias("line_no", "line"))
    row = F.when(F.col("line").startswith("m "), F.regexp_replace("line", "^m ", ""))
    return S.benchmark_rows(lines, {"protocol": F.when(F.col("line").isin("CV10", "LOYO"), F.col("line"))}, row, r"^(m) ", ["A", "B"], by=["k"])


@query("""WITH r AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<ul>(.*?)</ul>', 1)) AS u FROM pages), c AS (SELECT page_id, regexp_extract_all(u, '(?s)<li>(.*?)</li>', 1) AS l FROM r) SELECT page_id, CAST(len(l) AS INT) AS cells, trim(regexp_replace(l[1], '<[^>]+>', '', 'g')) AS first FROM c""")
def s21_html_rows(spark, d):
    r = S.html_rows(V.table(spark, d, "pages"), "page_id", "html", "ul", "li")
    return r.select("page_id", F.size("cells").alias("cells"), F.element_at("cells", 1).alias("first"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def s22_pending_items(spark, d):
    return S.pending(V.table(spark, d, "documents").select("doc_id"), V.table(spark, d, "labels"), "doc_id")


@query(f"""{V.PANEL}, s AS (SELECT farm_id, crop, 1 - avg(abs(pred-target))/avg(target) AS v FROM cells JOIN seasons USING (season_id) GROUP BY 1, 2) SELECT farm_id, printf('%.2f', max(CASE WHEN crop = 'crop0' THEN v END)) AS crop0, printf('%.2f', max(CASE WHEN crop = 'crop1' THEN v END)) AS crop1, printf('%.2f', avg(v)) AS mean FROM s WHERE crop IN ('crop0', 'crop1') GROUP BY 1""")
def s24_report_table(spark, d):
    s = V.panel(spark, d).groupBy("farm_id", "crop").agg((1 - F.avg(F.abs(F.col("pred") - F.col("target"))) / F.avg("target")).alias("v"))
    return S.report(s.filter(F.col("crop").isin("crop0", "crop1")), ["farm_id"], "crop", ["crop0", "crop1"], "v")


@query(f"""{V.PANEL}, r AS (SELECT 'overall' AS scope, '' AS name, pred, target FROM cells UNION ALL SELECT 'country', country, pred, target FROM cells JOIN seasons USING (season_id) UNION ALL SELECT 'crop', crop, pred, target FROM cells JOIN seasons USING (season_id)) SELECT scope, name, count(*) AS n, round(sqrt(avg((pred-target)*(pred-target))), 6) AS rmse FROM r GROUP BY 1, 2""")
def s25_run_collector(spark, d):
    p = V.panel(spark, d)
    scopes = F.array(*[F.struct(F.lit(s).alias("scope"), c.alias("name")) for s, c in (("overall", F.lit("")), ("country", F.col("country")), ("crop", F.col("crop")))])
    x = p.select("pred", "target", F.explode(scopes).alias("z")).select("pred", "target", "z.*")
    return V.rounded(M.regression_metrics(x, ["scope", "name"]).select("scope", "name", "n", "rmse"))


@query(f"""SELECT lang, count(*) AS rows, {C.additive_hash_sql("concat(coalesce(length(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-;'), coalesce(length(text) || ':' || text, '-;'))")} AS hash FROM documents GROUP BY 1""")
def s26_content_hash(spark, d):
    return S.content_hash(V.table(spark, d, "documents"), ["lang"], ["doc_id", "text"])


@query("""SELECT lang, min(CASE WHEN source = 'src0' THEN doc_id END) IS NOT NULL AS has_src0, min(CASE WHEN source = 'src1' THEN doc_id END) IS NOT NULL AS has_src1, CAST((min(CASE WHEN source = 'src0' THEN doc_id END) IS NOT NULL)::int + (min(CASE WHEN source = 'src1' THEN doc_id END) IS NOT NULL)::int AS INT) AS available FROM documents GROUP BY 1""")
def s27_availability(spark, d):
    return S.availability(V.table(spark, d, "documents"), "lang", "source", "doc_id", ["src0", "src1"]).select("lang", "has_src0", "has_src1", "available")


@query(f"""{V.PANEL}, s AS (SELECT crop, country, avg(abs(pred-target)) AS v, stddev_pop(pred-target) AS w FROM cells JOIN seasons USING (season_id) GROUP BY 1, 2) SELECT crop, country, v = min(v) OVER (PARTITION BY crop) AS is_best, concat(printf('%.3f [%.3f, %.3f]', v, v - w, v + w), CASE WHEN v - w > 0 OR v + w < 0 THEN '*' ELSE '' END) AS shown FROM s""")
def s28_publication_table(spark, d):
    e = F.col("pred") - F.col("target")
    s = V.panel(spark, d).groupBy("crop", "country").agg(F.avg(F.abs(e)).alias("v"), F.stddev_pop(e).alias("w"))
    b = S.best_flag(s, ["crop"], "v", lowest=True)
    return b.select("crop", "country", "is_best", S.with_interval(F.col("v"), F.col("v") - F.col("w"), F.col("v") + F.col("w")).alias("shown"))


@query("SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def s17_json_metadata(spark, d):
    return S.parsed_json(V.table(spark, d, "events"), "props", "k long").groupBy("user_id", F.col("parsed.k").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS k, 'o' AS side FROM orders UNION ALL SELECT c_custkey, 'c' FROM customer")
def u01_union_by_name(spark, d):
    o = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.lit("o").alias("side"))
    return S.union_all([o, V.table(spark, d, "customer").select(F.lit("c").alias("side"), F.col("c_custkey").alias("k"))])


@query("SELECT DISTINCT o_custkey % 40 AS member FROM orders WHERE o_custkey % 40 NOT IN (SELECT n_nationkey FROM nation)")
def u02_unknown_members(spark, d):
    return S.unknown_members(V.table(spark, d, "orders").select((F.col("o_custkey") % 40).alias("c")), "c", V.table(spark, d, "nation"), "n_nationkey")


# --- rules and composite tables ------------------------------------------------------------------


@query("""WITH x AS (SELECT ['corn', 'wheat', 'rapeseed', 'soybean'][1 + l_partkey % 4] AS crop, l_quantity AS t, l_discount * 8 AS r, l_tax * 20 AS f, l_extendedprice / 200 AS s FROM lineitem)
 SELECT crop, count(CASE WHEN crop IN ('corn', 'soybean') THEN 1 END) AS rainfed_crop, count(CASE WHEN t <= CASE crop WHEN 'wheat' THEN 32 WHEN 'rapeseed' THEN 30 ELSE 35 END THEN 1 END) AS no_heat_stress, count(CASE WHEN r < 0.5 THEN 1 END) AS dry_half, count(CASE WHEN f >= 1 THEN 1 END) AS has_relief, count(CASE WHEN false THEN 1 END) AS thermal_pattern, count(CASE WHEN s < 120 THEN 1 END) AS mineral_soil FROM x GROUP BY 1""")
def f13_rule_gates(spark, d):
    crop = F.get(F.array(*map(F.lit, ("corn", "wheat", "rapeseed", "soybean"))), (F.col("l_partkey") % 4).cast("int"))
    g = Q.gates(F.col("crop"), F.col("l_quantity"), F.col("l_discount") * 8, F.col("l_tax") * 20, F.col("l_extendedprice") / 200)
    return V.table(spark, d, "lineitem").withColumn("crop", crop).groupBy("crop").agg(*[F.count_if(c).alias(n) for n, c in g.items()])


@query("""WITH o AS (SELECT user_id, day(ts) AS t, value AS nir, 500 - value AS red, value + 50 AS e1, 300 AS e2, 200 AS swir FROM events), f AS (SELECT *, (t - 3) / 25.0 AS f, CASE WHEN nir > 0 AND red > 0 THEN (nir-red)/(nir+red) END v, CASE WHEN e1 > 0 AND e2 > 0 THEN (e1-e2)/(e1+e2) END e, CASE WHEN nir > 0 AND swir > 0 THEN (nir-swir)/(nir+swir) END m FROM o),
 g AS (SELECT user_id, max(CASE WHEN f BETWEEN 0 AND 1 THEN v END) top, min(CASE WHEN f BETWEEN 0 AND 0.3 THEN v END) low, avg(CASE WHEN f BETWEEN 0.6 AND 1 THEN v END) late, avg(CASE WHEN f BETWEEN 0.3 AND 0.8 THEN e END) ndre_mid, avg(CASE WHEN f BETWEEN 0.3 AND 0.8 THEN m END) ndmi_mid FROM f GROUP BY 1)
 SELECT user_id, round(top - low, 6) AS ndvi_rise, round(ndre_mid, 6) AS ndre_mid, CASE WHEN top > 0.1 THEN round(late / top, 6) END AS persist_ratio, round(ndmi_mid, 6) AS ndmi_mid FROM g""")
def a33_season_indices(spark, d):
    e, v = V.table(spark, d, "events"), F.col("value")
    return V.rounded(Q.season_indices(e, ["user_id"], F.dayofmonth("ts").cast("double"), F.lit(3.0), F.lit(28.0), v, 500 - v, (v + 50, F.lit(300.0)), F.lit(200.0)))


@query("SELECT l_suppkey AS cell, round(max(CASE WHEN l_quantity > 0 AND l_discount > 0 THEN (l_quantity - l_discount * 100) / (l_quantity + l_discount * 100) END), 6) AS peak FROM lineitem GROUP BY 1")
def a24_peak_ndvi(spark, d):
    l = V.table(spark, d, "lineitem").withColumn("cell", F.col("l_suppkey"))  # noqa: E741
    return V.rounded(Q.peak(l, ["cell"], C.guarded_ratio(F.col("l_quantity"), F.col("l_discount") * 100)))


@query(f"""WITH {V.CELLS}, l AS (SELECT 'target' AS channel, CASE WHEN target >= 5 THEN target END AS v FROM cells UNION ALL SELECT 'pred', pred FROM cells) SELECT channel, round(avg((v IS NULL)::int), 6) AS missing, round(quantile_cont(v, 0.05), 6) AS p5, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95 FROM l GROUP BY 1""")
def a35_raw_summary(spark, d):
    c = V.cells(spark, d).withColumn("target", F.when(F.col("target") >= 5, F.col("target")))
    return V.rounded(Q.raw_summary(c, ["target", "pred"]))


@query("""WITH x AS (SELECT c_nationkey AS cell, CASE c_mktsegment WHEN 'FURNITURE' THEN 'winter' WHEN 'MACHINERY' THEN 'spring' ELSE 'other' END AS g FROM customer) SELECT cell, count(CASE WHEN g = 'winter' THEN 1 END) AS winter, count(CASE WHEN g = 'spring' THEN 1 END) AS spring, count(CASE WHEN g IN ('winter', 'spring') THEN 1 END) AS wheat, round(count(CASE WHEN g IN ('winter', 'spring') THEN 1 END) / count(*), 6) AS share FROM x GROUP BY 1""")
def a37_a38_class_histogram(spark, d):
    g = F.when(F.col("c_mktsegment") == "FURNITURE", "winter").when(F.col("c_mktsegment") == "MACHINERY", "spring").otherwise("other")
    p = V.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("cell")).agg(*[F.count_if(g == n).alias(n) for n in ("winter", "spring", "other")])
    wheat = F.col("winter") + F.col("spring")
    return V.rounded(p.select("cell", "winter", "spring", wheat.alias("wheat"), (wheat / (wheat + F.col("other"))).alias("share")))


@query(f"""WITH {V.CELLS}, l AS (SELECT season_id, 'target' AS channel, target AS v FROM cells UNION ALL SELECT season_id, 'n_src', n_src::DOUBLE FROM cells) SELECT season_id, channel, count(v) AS n, round(avg(v), 6) AS mean, round(min(v), 6) AS low, round(max(v), 6) AS high FROM l GROUP BY 1, 2""")
def a39_evidence_summary(spark, d):
    return V.rounded(Q.evidence(V.cells(spark, d), ["season_id"], ["target", "n_src"]))


@query(f"""{V.PANEL}, r AS (SELECT farm_id, fold, avg(abs(pred-target)) e FROM cells JOIN seasons USING (season_id) GROUP BY 1, 2), k AS (SELECT farm_id FROM r GROUP BY 1 HAVING count(DISTINCT fold) >= 2) SELECT farm_id, fold, round(e, 6) AS mae FROM r WHERE farm_id IN (SELECT farm_id FROM k)""")
def f17_complete_experiments(spark, d):
    r = M.regression_metrics(V.panel(spark, d), ["farm_id", "fold"]).select("farm_id", "fold", "mae")
    return V.rounded(Q.complete_only(r, r.select("farm_id").distinct().withColumn("expected", F.lit(2)), ["farm_id"], "fold"))


@query(f"""WITH {V.CELLS}, u AS (SELECT season_id, corr(target, pred) r, avg(abs(pred-target)) e, count(*) n FROM cells GROUP BY 1) SELECT count(*) AS units, count(CASE WHEN r > 0.99 THEN 1 END) AS tight, count(CASE WHEN e < 1.3 THEN 1 END) AS exact, round(median(CASE WHEN n >= 450 THEN e END), 6) AS median_e FROM u""")
def a53_health_counts(spark, d):
    u = V.cells(spark, d).groupBy("season_id").agg(F.corr("target", "pred").alias("r"), F.avg(F.abs(F.col("pred") - F.col("target"))).alias("e"), F.count("*").alias("n"))
    return V.rounded(Q.health(u, {"tight": F.col("r") > 0.99, "exact": F.col("e") < 1.3}, ["e"], "n", 450))


@query(f"""{V.PANEL}, f AS (SELECT farm_id, crop, fold, 1 - sum((pred-target)*(pred-target)) / (count(*) * var_pop(target)) r2 FROM cells JOIN seasons USING (season_id) GROUP BY 1, 2, 3), p AS (SELECT farm_id, crop, avg(r2) v FROM f GROUP BY 1, 2) SELECT farm_id, count(*) AS pairs, round(avg(v), 6) AS mean_r2 FROM p GROUP BY 1""")
def a55_a56_protocol_report(spark, d):
    f = M.regression_metrics(V.panel(spark, d), ["farm_id", "crop", "fold"]).groupBy("farm_id", "crop").agg(F.avg("r2").alias("v"))
    return V.rounded(f.groupBy("farm_id").agg(F.count("*").alias("pairs"), F.avg("v").alias("mean_r2")))


@query("""SELECT lang AS job, count(CASE WHEN l.doc_id IS NOT NULL AND quality = 1 THEN 1 END) AS done, count(CASE WHEN l.doc_id IS NOT NULL AND quality = 0 THEN 1 END) AS failed, count(CASE WHEN l.doc_id IS NULL AND d.doc_id % 7 = 0 THEN 1 END) AS skipped, count(CASE WHEN l.doc_id IS NULL AND d.doc_id % 7 <> 0 THEN 1 END) AS pending FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def a57_status_rollup(spark, d):
    docs, labels = V.table(spark, d, "documents").select("doc_id", F.col("lang").alias("job")), V.table(spark, d, "labels")
    return Q.status_rollup(docs, labels.filter("quality = 1"), labels.filter("quality = 0"), docs.filter("doc_id % 7 = 0"), "doc_id", "job")


@query(f"""{V.PANEL}, b AS (SELECT crop, country, 1 - avg(abs(pred-target))/avg(target) AS v FROM cells JOIN seasons USING (season_id) GROUP BY 1, 2), m AS (SELECT crop, max(v) best FROM b GROUP BY 1), r AS (SELECT crop, farm_id, 1 - avg(abs(pred-target))/avg(target) AS v FROM cells JOIN seasons USING (season_id) GROUP BY 1, 2)
 SELECT crop, farm_id, round(v, 6) AS v, round(best, 6) AS best, round(v - best, 6) AS gain FROM r JOIN m USING (crop)""")
def j17_results_against_benchmark(spark, d):
    p, skill = V.panel(spark, d), (1 - F.avg(F.abs(F.col("pred") - F.col("target"))) / F.avg("target")).alias("v")
    best = p.groupBy("crop", "country").agg(skill).groupBy("crop").agg(F.max("v").alias("best"))
    r = p.groupBy("crop", "farm_id").agg(skill).join(best, "crop", "left")
    return V.rounded(r.select("crop", "farm_id", "v", "best", (F.col("v") - F.col("best")).alias("gain")))


@query(f"""WITH {V.CELLS}, f AS (SELECT season_id FROM cells GROUP BY 1 HAVING count(*) = count(CASE WHEN n_src < 6 THEN 1 END)) SELECT c.season_id, grid_row, grid_col, round(target - pred, 6) AS residual FROM cells c JOIN f USING (season_id)""")
def j15_j18_attach_when_complete(spark, d):
    c = V.cells(spark, d)
    side = c.filter("n_src < 6").select(*KEY, (F.col("target") - F.col("pred")).alias("residual"))
    full = c.join(side, KEY, "left").groupBy("season_id").agg(F.count("*").alias("a"), F.count("residual").alias("b")).filter("a = b")
    return V.rounded(c.select(*KEY).join(side, KEY).join(full, "season_id", "left_semi"))


@query(f"""WITH {V.CELLS}, s AS (SELECT DISTINCT season_id FROM cells), p AS (SELECT season_id, (row_number() OVER (ORDER BY season_id) - 1) / count(*) OVER ()::DOUBLE lo, row_number() OVER (ORDER BY season_id) / count(*) OVER ()::DOUBLE hi FROM s), d AS (SELECT range AS draw, ({T.mixed_sql('range', 9)} + 0.5) / 4294967296 AS u FROM range(300))
 SELECT count(*) AS draws, count(DISTINCT season_id) AS seasons FROM d JOIN p ON u >= lo AND u < hi""")
def t05_season_balanced_draws(spark, d):
    sizes = V.cells(spark, d).groupBy("season_id").agg(F.count("*").alias("n"))
    return T.balanced_draws(sizes, "season_id", 300, 0.0, 9).agg(F.count("*").alias("draws"), F.count_distinct("season_id").alias("seasons"))


@query("""SELECT lang, count(*) AS members, count(DISTINCT source) AS fields FROM documents GROUP BY 1""")
def t15_negatives_cover(spark, d):
    x = V.table(spark, d, "documents").select("doc_id", "lang", "source")
    n = T.negatives(x, "doc_id", "source", 500, 1)
    return x.join(n, "doc_id", "left").groupBy("lang").agg(F.count_distinct("doc_id").alias("members"), F.count_distinct("source").alias("fields"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS s, round(min(value), 4) AS mn, round(max(value), 4) AS mx FROM events GROUP BY 1")
def s22_streaming_statistics(spark, d):
    """A01 as a stream: files of the folder are read as they come, statistics per key are kept as state."""
    schema = V.table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet")  # a pattern, so that the table may be a file or a folder
    name = f"stats_{uuid.uuid4().hex}"
    q = jobs.running_statistics(stream, ["event_type"], "value").writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return V.rounded(spark.table(name).drop("ss"), 4)
