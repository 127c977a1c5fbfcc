"""Queries: data contracts (readers, snapshots, publication), annotation and library gates, supports, tile selection, probes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars as C
from ..operators import joins as J
from ..operators import kernels as K
from ..operators import rules as Q
from ..operators import sampling as T
from ..sources import tables as S
from ..util import shared_folder
from . import views as V
from .q_sampling import CELL, KEY, H
from .registry import query


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/query-{uuid.uuid4().hex}"


# --- sources -------------------------------------------------------------------------------------


@query(None)
def s11_fingerprints(spark, d):
    """Size and hash of head and tail of every file of two tables, and whether the file differs from its own record."""
    now = S.fingerprints(spark, f"{d}/*.parquet")
    stale = S.changed(now, now.withColumn("digest", F.when(F.col("path").contains("region"), F.lit("old")).otherwise(F.col("digest"))))
    x = now.join(stale.withColumn("stale", F.lit(True)), "path", "left")
    return x.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", "digest", F.coalesce("stale", F.lit(False)).alias("stale"))


@query("SELECT lang, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1")
def s12_snapshot(spark, d):
    """The actual facts of a table, after the check against expectations that agree with another count of the same table."""
    docs = V.table(spark, d, "documents")
    actual = docs.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))
    expected = docs.groupBy("lang", "source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars")).groupBy("lang").agg(F.sum("docs").alias("docs"), F.sum("chars").alias("chars"))
    S.check_snapshot(actual, expected.filter("lang is not null"), "lang", ["docs", "chars"])
    return actual


@query("SELECT CAST(event_id AS BIGINT) AS day, round(value, 6) AS tavg, CASE WHEN event_type <> 'view' THEN round(value * 2, 6) END AS prec, CAST(NULL AS DOUBLE) AS rh FROM events")
def s16_weather_files(spark, d):
    """Daily weather files of which some lack a column, written as CSV and read by the common schema."""
    e = V.table(spark, d, "events").select(F.col("event_id").alias("day"), F.round("value", 6).alias(" tavg "), F.round(F.col("value") * 2, 6).alias("prec"), F.col("event_type").alias("kind"))
    at = _folder(spark)
    e.filter("kind = 'view'").select("day", " tavg ").write.csv(f"{at}/a", header=True)
    e.filter("kind <> 'view'").select("day", "prec", " tavg ").write.csv(f"{at}/b", header=True)
    return V.rounded(S.read_weather(spark, [f"{at}/a", f"{at}/b"], "day long, tavg double, prec double, rh double", ["day", "tavg", "prec", "rh"]))


@query("SELECT s_suppkey AS tile, concat_ws('_', concat('n', s_nationkey), s_suppkey) AS season_id, s_suppkey % 4 AS k FROM supplier")
def s19_tile_files(spark, d):
    """Tile metadata, an object a line, with the season's id."""
    s = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("tile"), F.concat(F.lit("n"), F.col("s_nationkey")).alias("country"), F.col("s_suppkey").cast("string").alias("field"), (F.col("s_suppkey") % 4).alias("k"))
    at = _folder(spark)
    s.write.json(at)
    return S.read_tiles(spark, at, "tile long, country string, field string, k long").select("tile", "season_id", "k")


@query("SELECT c_custkey, c_nationkey FROM customer")
def s23_published(spark, d):
    """Rows read back from a publication that its checks let pass."""
    at = _folder(spark)
    c = V.table(spark, d, "customer").select("c_custkey", "c_nationkey")
    S.publish(c, at, [("no nation", F.col("c_nationkey").isNotNull()), ("no key", F.col("c_custkey") >= 0)])
    return spark.read.schema(c.schema).parquet(at)


COUNTIES = [f"{k:05d}" for k in range(1, 60, 3)]


@query(f"SELECT lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS fips, concat('r/weather/2020/', lpad(CAST(c_custkey AS VARCHAR), 5, '0'), '-09.csv') AS last FROM customer WHERE lpad(CAST(c_custkey AS VARCHAR), 5, '0') IN ({', '.join(repr(k) for k in COUNTIES)})")
def s01_county_list(spark, d):
    c = V.table(spark, d, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 5, "0").alias("FIPS"), F.lit(2020).alias("y"))
    return S.county_manifest(c, COUNTIES, "y", "r").select(F.col("FIPS").alias("fips"), F.element_at("data.weather.short_term", -1).alias("last"))


# --- gates ---------------------------------------------------------------------------------------


@query("SELECT regexp_replace(concat(o_orderstatus, '-arm', o_custkey % 5, CASE o_orderkey % 3 WHEN 0 THEN '_seed' WHEN 1 THEN '-s' ELSE '_x' END, o_orderkey % 7), '[-_]s(eed)?[0-9]+$', '') AS arm, count(*) AS runs FROM orders GROUP BY 1")
def p32_arms_of_runs(spark, d):
    k = F.col("o_orderkey")
    run = F.concat("o_orderstatus", F.lit("-arm"), F.col("o_custkey") % 5, F.when(k % 3 == 0, "_seed").when(k % 3 == 1, "-s").otherwise("_x"), k % 7)
    return V.table(spark, d, "orders").groupBy(C.without_seed(run).alias("arm")).agg(F.count("*").alias("runs"))


@query("""WITH x AS (SELECT o_orderpriority AS p, (dayofyear(o_orderdate) - 60) / 240.0 AS f FROM orders) SELECT p AS priority, count(CASE WHEN f BETWEEN 0 AND 0.3 THEN 1 END) AS early, count(CASE WHEN f BETWEEN 0.3 AND 0.8 THEN 1 END) AS mid, count(CASE WHEN f BETWEEN 0.6 AND 1.0 THEN 1 END) AS late FROM x GROUP BY 1""")
def w16_season_windows(spark, d):
    f = C.season_fraction(F.dayofyear("o_orderdate"), F.lit(60), F.lit(300))
    o = V.table(spark, d, "orders").select(F.col("o_orderpriority").alias("priority"), f.alias("f"))
    return o.groupBy("priority").agg(*[F.count_if(C.in_window(F.col("f"), w)).alias(n) for n, w in (("early", C.EARLY), ("mid", C.MID), ("late", C.LATE))])


@query(f"WITH {V.CELLS} SELECT season_id, grid_row, count(*) AS n, round(avg(target), 6) AS mean FROM cells GROUP BY 1, 2 HAVING count(target) >= 15")
def f12_minimum_support(spark, d):
    c = Q.supported(V.cells(spark, d), ["season_id", "grid_row"], "target", 15)
    return V.rounded(c.groupBy("season_id", "grid_row").agg(F.count("*").alias("n"), F.avg("target").alias("mean")))


@query("""WITH r AS (SELECT conv_id AS sample, list(concat('t', turn % 3)) AS ids, max(length(coalesce(text, '')) % 12) AS top, bool_or(coalesce(role, '') <> 'assistant') AS other FROM conversations GROUP BY 1)
 SELECT sample, 'wrong ids' AS error FROM r WHERE len(ids) <> 3 OR len(list_distinct(ids)) <> 3 UNION ALL SELECT sample, 'score out of range' FROM r WHERE top > 10 UNION ALL SELECT sample, 'citation not allowed' FROM r WHERE other""")
def f14_response_errors(spark, d):
    """Turns as annotation items: each conversation must have the three wanted ids once and cite the assistant only."""
    c = V.table(spark, d, "conversations").select("conv_id", F.concat(F.lit("t"), F.col("turn") % 3).alias("id"), (F.length(F.coalesce("text", F.lit(""))) % 12 / 10.0).alias("score"), F.array(F.coalesce("role", F.lit(""))).alias("cites"))
    responses = c.groupBy(F.col("conv_id").alias("sample")).agg(F.collect_list(F.struct("id", "score", "cites")).alias("items"))
    return Q.response_errors(responses, c.select("id"), spark.range(1).select(F.lit("assistant").alias("id")))


@query("""WITH a AS (SELECT l_orderkey AS sample, CASE WHEN l_linenumber <= 4 THEN 'concepts' ELSE 'rules' END AS kind, concat('c', CASE WHEN l_suppkey % 17 = 0 THEN 9 ELSE l_linenumber END) AS id, l_linenumber AS n, CASE WHEN l_suppkey % 11 = 0 THEN 'guess' WHEN l_returnflag = 'A' THEN 'estimated' WHEN l_returnflag = 'N' THEN 'unknown' ELSE 'not_observable' END AS status,
  CASE WHEN l_returnflag = 'A' THEN l_tax * 15 WHEN l_suppkey % 7 = 0 THEN 0.5 END AS score, CASE WHEN l_returnflag = 'A' THEN l_discount * 10 END AS confidence, CASE l_partkey % 5 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['dates'] WHEN 2 THEN ['dates', concat('channels.ch', l_linenumber)] WHEN 3 THEN ['image'] ELSE [concat('channels.ch', l_linenumber % 3)] END AS cites, CASE WHEN l_partkey % 13 = 0 THEN ' ' ELSE 'seen' END AS reason FROM lineitem),
 d AS (SELECT CASE WHEN k <= 4 THEN 'concepts' ELSE 'rules' END AS kind, concat('c', k) AS id, [concat('ch', k)] AS own, CASE WHEN k % 2 = 0 THEN 'optical' ELSE 'soil' END AS family FROM (SELECT unnest(range(1, 8)) AS k)),
 j AS (SELECT a.*, family IS NULL AS strange, list_concat(CASE WHEN kind = 'concepts' THEN coalesce(list_transform(own, lambda c: concat('channels.', c)), []) ELSE ['channels.ch1', 'channels.ch2', 'channels.ch5'] END, CASE WHEN kind = 'rules' OR family = 'optical' THEN ['image'] ELSE [] END) AS beyond FROM a LEFT JOIN d USING (kind, id)),
 e AS (SELECT sample, id, unnest([CASE WHEN strange THEN 'unknown id' END, CASE WHEN status = 'guess' THEN 'invalid status' END, CASE WHEN status = 'estimated' AND NOT (coalesce(score BETWEEN 0 AND 1, false) AND coalesce(confidence BETWEEN 0 AND 1, false)) THEN 'invalid score' END, CASE WHEN status <> 'estimated' AND (score IS NOT NULL OR confidence IS NOT NULL) THEN 'unknown is not a negative' END,
  CASE WHEN len(list_filter(cites, lambda c: NOT list_contains(list_concat(beyond, ['dates']), c))) > 0 THEN 'unsupported citation' END, CASE WHEN status = 'estimated' AND len(cites) = 0 THEN 'estimate without evidence' END, CASE WHEN status = 'estimated' AND kind = 'concepts' AND len(cites) > 0 AND NOT list_has_any(cites, beyond) THEN 'no sensor evidence' END, CASE WHEN reason = ' ' THEN 'no reason' END]) AS error FROM j)
 SELECT sample, id, error FROM e WHERE error IS NOT NULL UNION SELECT sample, id, 'repeated id' FROM a GROUP BY sample, kind, id HAVING count(*) > 1 UNION SELECT sample, NULL, 'missing ids' FROM j GROUP BY 1 HAVING count(DISTINCT CASE WHEN NOT strange THEN id END) < 7""")
def f14_annotation_errors(spark, d):
    """Lines of an order as its annotations, with statuses, scores and citations of every kind."""
    l, n = V.table(spark, d, "lineitem"), F.col("l_linenumber")  # noqa: E741
    kind = F.when(n <= 4, "concepts").otherwise("rules")
    of = lambda c, k: F.col(c) % k
    status = F.when(of("l_suppkey", 11) == 0, "guess").when(F.col("l_returnflag") == "A", "estimated").when(F.col("l_returnflag") == "N", "unknown").otherwise("not_observable")
    channel = lambda k: F.concat(F.lit("channels.ch"), k.cast("string"))
    part = of("l_partkey", 5)
    cites = F.when(part == 0, F.array().cast("array<string>")).when(part == 1, F.array(F.lit("dates"))).when(part == 2, F.array(F.lit("dates"), channel(n))).when(part == 3, F.array(F.lit("image"))).otherwise(F.array(channel(n % 3)))
    a = l.select(F.col("l_orderkey").alias("sample"), kind.alias("kind"), F.concat(F.lit("c"), F.when(of("l_suppkey", 17) == 0, 9).otherwise(n).cast("string")).alias("id"), status.alias("status"), F.when(F.col("l_returnflag") == "A", F.col("l_tax") * 15).when(of("l_suppkey", 7) == 0, 0.5).alias("score"),
        F.when(F.col("l_returnflag") == "A", F.col("l_discount") * 10).alias("confidence"), cites.alias("cites"), F.when(of("l_partkey", 13) == 0, " ").otherwise("seen").alias("reason"))
    k = F.col("l_linenumber")
    definitions = l.select("l_linenumber").distinct().select(kind.alias("kind"), F.concat(F.lit("c"), k.cast("string")).alias("id"), F.array(F.concat(F.lit("ch"), k.cast("string"))).alias("channels"), F.when(k % 2 == 0, "optical").otherwise("soil").alias("family"))
    return Q.annotation_errors(a, definitions, ["ch1", "ch2", "ch5"], vision=True)


@query("SELECT lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS FIPS, n_name AS State, c_name AS County, CASE WHEN n_nationkey % 7 <> 0 THEN 'N' || n_nationkey END AS state_code FROM customer JOIN nation ON c_nationkey = n_nationkey")
def s01_county_scan(spark, d):
    """A county list written as CSV and scanned by its schema: codes keep their zeros, states without a code have none."""
    n = V.table(spark, d, "nation")
    c = V.table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    folder = _folder(spark)
    c.select(F.col("c_custkey").cast("string").alias("FIPS"), F.col("n_name").alias("State"), F.col("c_name").alias("County")).write.csv(folder, header=True)
    states = {r.n_name: f"N{r.n_nationkey}" for r in n.filter("n_nationkey % 7 <> 0").collect()}  # a fixed list of 25
    return S.read_counties(spark, folder, states)


@query("""WITH c AS (SELECT concat('c', n_nationkey) AS id, n_nationkey // 2 AS ch, n_regionkey AS fam, CASE WHEN n_nationkey % 6 = 0 THEN 'draft' ELSE 'approved' END AS review FROM nation),
 r AS (SELECT concat('r', s_suppkey) AS id, concat('c', s_nationkey) AS a, concat('c', s_nationkey * 3 % 30) AS b, s_suppkey % 13 / 10.0 AS p, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'approved' END AS review FROM supplier)
 SELECT id, concat('shared channel ', ch) AS error FROM c WHERE ch IN (SELECT ch FROM c GROUP BY 1 HAVING count(*) > 1) UNION SELECT id, 'not approved' FROM c WHERE review <> 'approved' UNION SELECT id, 'not approved' FROM r WHERE review IS NULL
 UNION SELECT id, 'unknown concept' FROM r WHERE a NOT IN (SELECT id FROM c) OR b NOT IN (SELECT id FROM c) UNION SELECT r.id, 'concepts of one family' FROM r JOIN c x ON x.id = a JOIN c y ON y.id = b WHERE x.fam = y.fam UNION SELECT id, 'presence out of range' FROM r WHERE p > 1""")
def f15_library_errors(spark, d):
    k, s = F.col("n_nationkey"), F.col("s_suppkey")
    name = lambda x: F.concat(F.lit("c"), x.cast("string"))
    concepts = V.table(spark, d, "nation").select(name(k).alias("id"), F.array(F.floor(k / 2).cast("string")).alias("channels"), F.col("n_regionkey").alias("family"), F.when(k % 6 == 0, "draft").otherwise("approved").alias("review"))
    rules = V.table(spark, d, "supplier").select(F.concat(F.lit("r"), s.cast("string")).alias("id"), name(F.col("s_nationkey")).alias("concept_a"), name(F.col("s_nationkey") * 3 % 30).alias("concept_b"), (s % 13 / 10.0).alias("minimum_presence"), F.when(s % 4 != 0, "approved").alias("review"))
    return Q.library_errors(concepts, rules)


@query("""WITH a AS (SELECT doc_id AS s, source, n_chars % 7 AS h FROM documents UNION ALL SELECT doc_id, source, n_chars % 7 FROM documents WHERE doc_id % 17 = 0), p AS (SELECT doc_id AS s, n_chars % 7 + (doc_id % 13 = 0)::INT AS h, CASE WHEN doc_id % 3 = 0 THEN 'val' ELSE 'train' END AS part FROM documents WHERE doc_id % 11 <> 0)
 SELECT * FROM (SELECT DISTINCT s AS sample, unnest([CASE WHEN p.s IS NULL THEN 'not prepared' END, CASE WHEN a.source <> 'src0' THEN 'other profile' END, CASE WHEN a.h <> p.h THEN 'stale' END, CASE WHEN s % 5 = 0 THEN 'not audited' END, CASE WHEN s % 17 = 0 THEN 'repeated' END, CASE WHEN p.part <> 'train' THEN 'not a training sample' END]) AS error FROM a LEFT JOIN p USING (s)) WHERE error IS NOT NULL""")
def f18_acceptance_errors(spark, d):
    x, k = V.table(spark, d, "documents"), F.col("doc_id")
    a = x.select(k.alias("sample"), F.col("source").alias("profile"), (F.col("n_chars") % 7).alias("hash"))
    prepared = x.filter(k % 11 != 0).select(k.alias("sample"), (F.col("n_chars") % 7 + (k % 13 == 0).cast("int")).alias("hash"), F.when(k % 3 == 0, "val").otherwise("train").alias("partition"))
    return Q.acceptance_errors(a.unionByName(a.filter("sample % 17 = 0")), prepared, x.filter(k % 5 != 0).select(k.alias("sample")), "src0")


# --- sampling and joins over whole tables ----------------------------------------------------------


@query(f"""{V.PANEL}, held AS (SELECT DISTINCT farm_id FROM seasons WHERE fold = 0), t AS (SELECT cells.*, crop, row_number() OVER (PARTITION BY crop ORDER BY {H(CELL)}, season_id, grid_row, grid_col) i FROM cells JOIN seasons USING (season_id) WHERE fold <> 0 AND farm_id NOT IN (SELECT farm_id FROM held))
 SELECT crop, season_id, grid_row, grid_col, i <= 100 AS for_statistics FROM t WHERE i <= 400""")
def t14_select_tiles(spark, d):
    x = V.panel(spark, d)
    s = V.seasons(spark, d)
    out = T.select_tiles(x.filter("fold <> 0"), s.filter("fold = 0"), "farm_id", ["crop"], F.expr(CELL), 400, 100, ["season_id", "grid_row", "grid_col"])
    return out.select("crop", *KEY, "for_statistics")


@query(f"""WITH {V.CELLS}, x AS (SELECT *, row_number() OVER (PARTITION BY season_id ORDER BY {H(CELL)}, grid_row, grid_col) - 1 i, count(*) OVER (PARTITION BY season_id) n FROM cells), y AS (SELECT *, CAST(ceil((1100 - i) / least(n, 1100)::DOUBLE) AS BIGINT) t FROM x WHERE i < 1100)
 SELECT season_id, grid_row, grid_col, CAST(unnest(range(1, t + 1)) AS INT) AS draw FROM y""")
def t04_context_rows_of_all_cells(spark, d):
    """More rows than a season can have, so that every season repeats some of its cells."""
    return T.context_rows(V.cells(spark, d), ["season_id"], F.expr(CELL), 1100, ["grid_row", "grid_col"]).select(*KEY, "draw")


@query("""WITH d AS (SELECT count(*) AS n, count(DISTINCT source) AS k FROM documents) SELECT n AS members, CAST(0 AS BIGINT) AS without, CAST(0 AS BIGINT) AS same_source, n AS most FROM d WHERE k > 1""")
def t15_negatives(spark, d):
    """Every document has a negative, and no pair shares its source; the rows of `negatives` are counted themselves."""
    x = V.table(spark, d, "documents").select("doc_id", "source")
    n = T.negatives(x, "doc_id", "source", 500, 1)
    y = x.join(n, "doc_id", "left").join(x.select(F.col("doc_id").alias("negative"), F.col("source").alias("other")), "negative", "left")
    return y.agg(F.count_distinct("doc_id").alias("members"), F.count_if(F.col("negative").isNull()).alias("without"), F.count_if(F.col("source") == F.col("other")).alias("same_source"), F.count("negative").alias("most"))


ALL_POINTS = """t AS (SELECT c_custkey AS target_id, c_nationkey AS grp, ((c_custkey * 7919) % 1000)::DOUBLE AS x, ((c_custkey * 104729) % 1000)::DOUBLE AS y FROM customer),
 s AS (SELECT o_orderkey AS source_id, CAST(o_orderkey % 25 AS INT) AS grp, ((o_orderkey * 6151) % 1000)::DOUBLE AS x, ((o_orderkey * 3079) % 1000)::DOUBLE AS y FROM orders)"""
ALL_NEAREST = f"""WITH {ALL_POINTS}, p AS (SELECT target_id, source_id, sqrt((t.x-s.x)*(t.x-s.x)+(t.y-s.y)*(t.y-s.y)) d FROM t JOIN s USING (grp)), m AS (SELECT target_id, min(row(d, source_id)) b FROM p WHERE d <= 20 GROUP BY 1)"""


def _all_points(spark, d):
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    t = V.table(spark, d, "customer").select(k.alias("target_id"), F.col("c_nationkey").alias("grp"), (k * 7919 % 1000).cast("double").alias("x"), (k * 104729 % 1000).cast("double").alias("y"))
    s = V.table(spark, d, "orders").select(o.alias("source_id"), (o % 25).cast("int").alias("grp"), (o * 6151 % 1000).cast("double").alias("x"), (o * 3079 % 1000).cast("double").alias("y"))
    return J.nearest(t, s, 20.0, 20.0, by=["grp"])


@query(f"{ALL_NEAREST} SELECT t.target_id, coalesce(struct_extract(b, 2), -1) AS source, round(struct_extract(b, 1), 6) AS distance FROM t LEFT JOIN m USING (target_id)")
def j03_nearest_of_all_cells(spark, d):
    return V.rounded(_all_points(spark, d).select("target_id", "source", "distance"))


@query(f"{ALL_NEAREST} SELECT CAST(l AS INT) AS layer, count(*) AS n, round(sum(o_totalprice * l), 2) AS total FROM m JOIN orders ON o_orderkey = struct_extract(b, 2), (SELECT unnest([1, 2]) AS l) GROUP BY 1")
def j03_layers_of_all_cells(spark, d):
    layers = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("source_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("layer"), "o_totalprice")
    x = J.apply_mapping(_all_points(spark, d), layers)
    return V.rounded(x.groupBy("layer").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice") * F.col("layer")).alias("total")), 2)


# --- probes --------------------------------------------------------------------------------------


@query(f"""{V.PANEL}, x AS (SELECT fold = 0 AS test, pred::DOUBLE AS x, target::DOUBLE AS y FROM cells JOIN seasons USING (season_id)), m AS (SELECT avg(x) AS mx, stddev_samp(x) AS sx, avg(y) AS my FROM x WHERE NOT test),
 b AS (SELECT sum((x - mx) / sx * (y - my)) / (sum(((x - mx) / sx) ** 2) + 1.0) AS beta FROM x, m WHERE NOT test) SELECT round(1 - sum((my + beta * (x - mx) / sx - y) ** 2) / (count(*) * var_pop(y)), 5) AS r2 FROM x, m, b WHERE test""")
def a45_ridge_probe(spark, d):
    x = V.panel(spark, d).select("fold", F.col("pred").cast("double").alias("x"), F.col("target").cast("double").alias("y"))
    r2 = K.ridge_probe(x.filter("fold <> 0"), x.filter("fold = 0"), ["x"], "y")
    return V.rounded(spark.createDataFrame([(r2,)], "r2 double"), 5)
