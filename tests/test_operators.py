"""Contracts, failures and brute force on small inline tables."""

import itertools
import math
import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import scalars as C
from gridloom.operators import joins as J
from gridloom.operators import kernels as K
from gridloom.operators import metrics as M
from gridloom.operators import resampling as B
from gridloom.operators import reshape as R
from gridloom.operators import rules as Q
from gridloom.operators import sampling as T
from gridloom.operators import splits as G
from gridloom.operators import stats as S
from gridloom.operators import windows as X
from gridloom.sources import tables as SRC
from gridloom.streaming import jobs


@pytest.fixture(scope="module")
def seasons(spark):
    rows = [(k, f"c{k % 2}", f"r{k % 3}", f"farm{k % 6}", f"g{k // 2}", 100 + 37 * k % 500) for k in range(24)]
    return spark.createDataFrame(rows, "season_id long, country string, province string, farm_id string, physical_field_id string, n_rows long")


def test_columns_fail(spark):
    df = spark.range(1).select("id", F.lit(1).alias("a"), F.lit(2).alias("a"))
    with pytest.raises(ValueError, match="repeated"):
        SRC.strict_columns(df, ["id"])
    with pytest.raises(ValueError, match="missing"):
        SRC.strict_columns(spark.range(1), ["id", "x"])
    with pytest.raises(ValueError, match="extra"):
        SRC.strict_columns(spark.range(1).withColumn("x", F.lit(1)), ["id"], full=True)


def test_unknown_code_fails_and_zero_is_valid(spark):
    d = spark.createDataFrame([("crop", 0, "corn"), ("crop", 1, "wheat")], "var string, code int, value string")
    ok = SRC.decoded(spark.createDataFrame([(0,), (1,), (None,)], "crop int"), d, "crop", "crop")
    assert sorted(str(r.crop) for r in ok.collect()) == ["None", "corn", "wheat"]
    with pytest.raises(Exception, match="unknown crop code 7"):
        SRC.decoded(spark.createDataFrame([(7,)], "crop int"), d, "crop", "crop").collect()


def test_names_and_grids_fail(spark):
    one = spark.range(1)
    with pytest.raises(Exception, match="unrecognised"):
        one.select(C.parse_season_name(F.lit("nonsense"))).collect()
    with pytest.raises(Exception, match="rotated"):
        one.select(C.bounding_box(F.array(*map(F.lit, (1.0, 0.5, 0.0, 0.0, -1.0, 0.0))), F.lit(3), F.lit(4)).alias("b")).select("b.x0").collect()
    box = one.select(C.bounding_box(F.array(*map(F.lit, (10.0, 0.0, 5.0, 0.0, -10.0, 100.0))), F.lit(3), F.lit(4)).alias("b")).first().b
    assert tuple(box) == (5.0, 60.0, 35.0, 100.0)
    x, y = C.cell_centre(F.lit(1), F.lit(2), C.shifted_affine(F.array(*map(F.lit, (10.0, 0.0, 5.0, 0.0, -10.0, 100.0))), F.lit(4), F.lit(3)))
    assert tuple(one.select(x, y).first()) == (60.0, 45.0)


def test_half_even_weather_cell(spark):
    got = spark.createDataFrame([(0.25,), (0.35,), (-0.25,)], "v double").select(C.weather_cell(F.col("v"))).collect()
    assert [round(r[0], 3) for r in got] == [round(np.round(v * 10) / 10, 3) for v in (0.25, 0.35, -0.25)]


def test_slots(spark):
    b = {r.slot: r for r in C.slot_bounds(spark, 2024).collect()}
    assert len(b) == 72 and str(b[0].first_day) == "2023-01-01" and str(b[41].first_day) == "2024-02-21" and str(b[41].last_day) == "2024-02-29"
    days = spark.sql("select explode(sequence(date'2023-01-01', date'2024-12-31')) d").select("d", C.ten_day_slot(F.col("d"), F.lit(2024)).alias("s")).collect()
    assert all(b[r.s].first_day <= r.d <= b[r.s].last_day for r in days)


def test_decibels_are_refused(spark):
    with pytest.raises(Exception, match="decibels"):
        C.sar_normalised(spark.createDataFrame([(1, -12.0), (1, -9.0), (1, 0.5)], "g int, v double"), "v", ["g"]).collect()


def test_validity_rules(spark):
    s = spark.createDataFrame([(1, 0, None, 1.0, 1.0), (1, 1, 10, 2.0, 2.0), (1, 2, 20, float("nan"), 3.0)], "c int, slot int, obs_day int, o double, w double")
    got = [(r.o, r.w) for r in X.temporal_validity(s, ["c"], ["o"], ["w"]).orderBy("slot").collect()]
    assert got == [(None, None), (2.0, None), (None, 3.0)]
    assert X.temporal_validity(s, ["c"], ["o"], ["w"], keep_first_weather=True).orderBy("slot").collect()[1].w == 2.0
    with pytest.raises(ValueError, match="cutoff"):
        X.before_cutoff(F.lit(1), "weekly", F.lit(1), F.lit(1))
    c = X.canonical(spark.createDataFrame([(1, 0, None, float("nan")), (1, 1, 5, 3.0), (1, 2, 6, 3.5), (2, 0, None, None)], "c int, slot int, obs_day int, dem double"), ["c"], ["dem"]).orderBy("c").collect()
    assert [(r.dem, r.flags) for r in c] == [(3.0, 1), (None, 6)]


def test_weather_window(spark):
    s = spark.createDataFrame([(1, 0, 10.0, 5.0), (1, 1, None, 9.0), (1, 2, 19.0, 20.0), (1, 3, 29.0, 22.0)], "c int, slot int, t double, p double")
    r = J.window_from_intervals(s, ["c"], "t", ["p"], F.lit(12.0), F.lit(28.0)).first()
    covered, total = (20 - 12) + (28 - 19), 20 / 10 * 8 + 22 / 11 * 9
    assert r.coverage == pytest.approx(covered / 16) and r.p == pytest.approx(total * 16 / covered)
    assert J.window_from_intervals(s, ["c"], "t", ["p"], F.lit(25.0), F.lit(90.0)).first().p is None


def test_pooled_is_not_the_mean_of_folds(spark):
    rng = np.random.default_rng(0)
    y = np.concatenate([rng.normal(0, 1, 50), rng.normal(10, 1, 50)])
    p = y + rng.normal(0, 0.8, 100)
    df = spark.createDataFrame([(i // 50, i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, p))] + [(0, 999, None, 1.0), (0, 998, float("nan"), 1.0)], "fold int, id int, target double, pred double")
    r = M.fold_summary(df, "fold").first()
    r2 = lambda y, p: 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert r.n == 100 and r.r2_pooled == pytest.approx(r2(y, p)) and r.r2_mean == pytest.approx(np.mean([r2(y[:50], p[:50]), r2(y[50:], p[50:])])) and abs(r.r2_pooled - r.r2_mean) > 0.2
    with pytest.raises(Exception, match="two folds"):
        M.refuse_repeats(df.unionByName(df.filter("id = 3").withColumn("fold", F.lit(1))), ["id"]).collect()


def test_matched_targets_must_agree(spark):
    a = spark.createDataFrame([(1, 1.0, 2.0)], "k int, target double, pred double")
    assert J.matched(a, a, ["k"]).count() == 1
    with pytest.raises(Exception, match="disagree"):
        J.matched(a, a.withColumn("target", F.lit(2.0)), ["k"]).collect()
    with pytest.raises(Exception, match="different keys"):
        J.paired_arms(a, a.withColumn("k", F.lit(2)), ["k"], "pred").collect()


def test_nearest(spark):
    rng = np.random.default_rng(1)
    t, s = rng.uniform(0, 100, (60, 2)), rng.uniform(0, 100, (40, 2))
    td = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(t)], "target_id int, x double, y double")
    sd = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(s)], "source_id int, x double, y double")
    d = np.sqrt(((t[:, None] - s[None]) ** 2).sum(2))
    want = {i: int(d[i].argmin()) if d[i].min() <= 9 else -1 for i in range(60)}
    assert {r.target_id: r.source for r in J.nearest(td, sd, 10.0, 9.0).collect()} == want and -1 in want.values()


def test_weighted_quantiles(spark):
    rng = np.random.default_rng(2)
    rows = [(s, float(round(v, 1))) for s in range(5) for v in rng.normal(s, 1, 10 + 20 * s)]
    got = [r.value for r in S.weighted_quantiles(spark.createDataFrame(rows, "season_id int, v double").withColumn("st", F.lit("a")), "v", ["st"], points=51, least=5).orderBy("k").collect()]
    n = {s: sum(r[0] == s for r in rows) for s in range(5)}
    v, w = np.array([r[1] for r in rows]), np.array([1 / n[r[0]] for r in rows])
    order = np.argsort(v, kind="stable")
    v, w = v[order], w[order]
    # equal values share one weight here, so ties are spread evenly as well
    for x in np.unique(v):
        w[v == x] = w[v == x].mean()
    c = (np.cumsum(w) - 0.5 * w) / w.sum()
    assert got == pytest.approx(np.interp(np.linspace(0, 1, 51), c, v).tolist())
    assert S.weighted_quantiles(spark.createDataFrame(rows, "season_id int, v double").withColumn("st", F.lit("a")), "v", ["st"], least=6).count() == 0


def test_splits(spark, seasons):
    a = G.assign_groups(seasons.groupBy("country", "farm_id").agg(F.sum("n_rows").alias("n")), "country", "farm_id", "n")
    assert {r.partition for r in a.collect()} == {"train", "val", "test"}
    joined = seasons.join(a, ["country", "farm_id"])
    strict = G.strictest(joined, "physical_field_id")
    G.check_split(strict, seasons, ["physical_field_id"])
    with pytest.raises(ValueError, match="leaks"):
        G.check_split(seasons.withColumn("partition", F.when(F.col("season_id") % 2 == 0, "test").otherwise("train")), seasons, ["physical_field_id"])
    with pytest.raises(ValueError, match="cover"):
        G.check_split(seasons.filter("season_id > 0").withColumn("partition", F.lit("train")), seasons, ["farm_id"])
    folds = G.stratified_group_folds(seasons, "farm_id", "province", 3).collect()
    assert len(folds) == 6 and {r.fold for r in folds} == {0, 1, 2}
    with pytest.raises(Exception, match="only 6 groups"):
        G.stratified_group_folds(seasons, "farm_id", "province", 9).collect()


def test_components(spark):
    rng = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(i, i + 1) for i in range(300, 360)]
    root = list(range(400))
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in links:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.root for r in G.components(spark.createDataFrame(links, "a long, b long"), spark.range(400).withColumnRenamed("id", "node")).collect()}
    assert got == {i: find(i) for i in range(400)}


def test_largest_remainder(spark):
    df = spark.createDataFrame([("a", "x", 5.0), ("a", "y", 3.0), ("a", "z", 0.0), ("b", "x", 1.0)], "g string, k string, w double")
    got = {(r.g, r.k): r.quota for r in T.largest_remainder(df, ["g"], "k", "w", F.lit(7)).collect()}
    assert got == {("a", "x"): 4, ("a", "y"): 3, ("a", "z"): 0, ("b", "x"): 7}


def test_uniform_is_even(spark):
    u = np.array([r[0] for r in spark.range(20000).select(T.uniform(F.col("id"), 3)).collect()])
    assert 0 < u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.01 and abs(np.corrcoef(u[1:], u[:-1])[0, 1]) < 0.03


def test_bootstrap(spark):
    x = spark.createDataFrame([(i, 1.0 + 0.1 * (i % 5)) for i in range(40)], "u int, v double")
    r = B.difference_bootstrap(x, "u", "v", 300).first()
    assert r.low < 1.2 < r.high and r.excludes_zero and r.replicates == 300
    m = B.multiplicities(x, "u", 20).groupBy("rep").agg(F.sum("m").alias("n")).collect()
    assert {r.n for r in m} == {40}


def test_leave_one_out_blend(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(0, 1, (90, 2))
    y = a @ [1.5, -0.5] + rng.normal(0, 0.1, 90)
    df = spark.createDataFrame([("s", i % 3, float(p), float(q), float(t)) for i, ((p, q), t) in enumerate(zip(a, y))], "s string, year int, p double, q double, t double")
    for r in B.leave_one_out_blend(df, ["s"], "year", "t", ["p", "q"]).collect():
        keep = np.arange(90) % 3 != r.year
        assert r.beta == pytest.approx(np.linalg.lstsq(a[keep], y[keep], rcond=None)[0].tolist())


def test_kernels(spark):
    assert K.digamma(1) == pytest.approx(-0.5772156649, abs=1e-8) and K.digamma(10) == pytest.approx(2.2517525890667, abs=1e-9)
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, 800)
    df = spark.createDataFrame([("a", i, float(u), float(0.9 * u + math.sqrt(1 - 0.81) * e)) for i, (u, e) in enumerate(zip(x, rng.normal(0, 1, 800)))], "g string, i long, x double, y double")
    assert K.mutual_information(df, ["g"], ["x"], "y", F.col("i")).first().mi == pytest.approx(-0.5 * math.log(1 - 0.81), abs=0.12)
    cells = spark.createDataFrame([(1, r, c, float(r + rng.normal()), float(r)) for r, c in itertools.product(range(12), range(12)) if (r * c) % 7], "season_id int, grid_row int, grid_col int, target double, pred double")
    bands = K.band_totals(K.scale_bands(cells.withColumn("g", F.lit(1)), ["g"]), ["g"]).collect()
    assert len(bands) == 6 and sum(b.share for b in bands) == pytest.approx(1)
    p = spark.createDataFrame([(float(a), float(2 * a + 0.01 * b)) for a, b in rng.normal(0, 1, (60, 2))], "x double, y double")
    assert K.ridge_probe(p, p, ["x"], "y") > 0.99 and K.ridge_probe(p.limit(5), p, ["x"], "y") is None


def test_rank_of_covariance(spark):
    v = [[float(a), float(b), 0.0] for a, b in np.random.default_rng(7).normal(0, 1, (500, 2))]
    r = S.effective_rank(spark.createDataFrame([(x,) for x in v], "v array<double>"), "v").first()
    assert r.n == 500 and r.effective_rank == pytest.approx(2, abs=0.05)


def test_window_rotation_and_tiles(spark):
    side = np.arange(9).reshape(3, 3)
    assert R.rotated_positions(3, 1) == np.rot90(side).ravel().tolist() and R.rotated_positions(3, 3) == np.rot90(side, 3).ravel().tolist()
    tile = spark.createDataFrame([(r, c, int(side[r, c]), 10.0) for r in range(3) for c in range(3)], "r int, c int, v int, aspect double")
    for turns, flip in itertools.product(range(4), (False, True)):
        want = np.rot90(side[:, ::-1] if flip else side, turns)
        assert all(want[x.r, x.c] == x.v for x in R.augmented(tile, 3, turns, flip, "aspect").collect())
    with pytest.raises(Exception, match="outside"):
        R.dense_grid(spark.createDataFrame([(1, 9, 0, 1.0)], "s int, grid_row int, grid_col int, v double"), ["s"], "v", 3, 3).collect()


def test_benchmark_text(spark):
    one = spark.range(1)
    got = one.select(SRC.mean_std_runs(F.lit("0.84±0.071.13±0.22 0.5±0.10.60±0.3")).alias("c")).first().c
    assert [tuple(x) for x in got] == [(0.84, 0.07), (1.13, 0.22), (0.5, 0.10), (0.6, 0.3)] or len(got) == 4
    with pytest.raises(Exception, match="cannot split"):
        one.select(SRC.mean_std_runs(F.lit("0.8±x0.1±0.2"))).collect()


def test_snapshot_collects_all_failures(spark):
    want = spark.createDataFrame([("a", 1, 2), ("b", 3, 4)], "k string, n int, m int")
    SRC.check_snapshot(want, want, "k", ["n", "m"])
    with pytest.raises(ValueError, match="a: n 9, expected 1.*b: m missing, expected 4"):
        SRC.check_snapshot(spark.createDataFrame([("a", 9, 2)], "k string, n int, m int"), want, "k", ["n", "m"])


def test_publish(spark, tmp_path):
    df = spark.range(5)
    with pytest.raises(ValueError, match="positive"):
        SRC.publish(df, f"{tmp_path}/t", [("positive", F.col("id") > 0)])
    SRC.publish(df, f"{tmp_path}/t", [("not_negative", F.col("id") >= 0)])
    assert spark.read.parquet(f"{tmp_path}/t").count() == 5
    with pytest.raises(FileExistsError):
        SRC.publish(df, f"{tmp_path}/t")
    f = SRC.fingerprints(spark, f"{tmp_path}/t/*.parquet")
    assert SRC.changed(f, f).count() == 0 and SRC.changed(f, f.withColumn("digest", F.lit("x"))).count() == f.count()


def test_rules(spark):
    c = spark.createDataFrame([("a", "f1", ["x"], "approved"), ("b", "f2", ["x"], "approved"), ("c", "f1", ["y"], None)], "id string, family string, channels array<string>, review string")
    r = spark.createDataFrame([("r1", "a", "c", 0.5, "approved"), ("r2", "a", "zz", 1.5, "approved")], "id string, concept_a string, concept_b string, minimum_presence double, review string")
    got = {(x.id, x.error) for x in Q.library_errors(c, r).collect()}
    assert got == {("a", "shared channel x"), ("b", "shared channel x"), ("c", "not approved"), ("r1", "concepts of one family"), ("r2", "unknown concept"), ("r2", "presence out of range")}
    said = spark.createDataFrame([("s1", [("a", 0.5, ["e"]), ("b", None, [])]), ("s2", [("a", 1.5, ["q"])])], "sample string, items array<struct<id:string,score:double,cites:array<string>>>")
    bad = {(x.sample, x.error) for x in Q.response_errors(said, c.filter("id <> 'c'"), spark.createDataFrame([("e",)], "id string")).collect()}
    assert bad == {("s2", "wrong ids"), ("s2", "score out of range"), ("s2", "citation not allowed")}
    ann = spark.createDataFrame([("s1", "p", "h"), ("s2", "q", "old"), ("s3", "p", "h")], "sample string, profile string, hash string")
    prep = spark.createDataFrame([("s1", "h", "train"), ("s2", "h", "test")], "sample string, hash string, partition string")
    errors = {(x.sample, x.error) for x in Q.acceptance_errors(ann, prep, spark.createDataFrame([("s1",), ("s2",)], "sample string"), "p").collect()}
    assert errors == {("s2", "other profile"), ("s2", "stale"), ("s2", "not a training sample"), ("s3", "not prepared"), ("s3", "not audited")}


def test_stream_ingest_is_resumable(spark, tmp_path):
    src, target, ledger, ck = (f"{tmp_path}/{n}" for n in ("src", "out", "ledger", "ck"))
    spark.range(4).write.parquet(src)
    run = lambda: jobs.ingest_files(spark, src, "id long", target, ledger, ck, "id", lambda d: d.withColumn("v", F.col("id") * 2))
    run()
    spark.range(2, 7).write.mode("append").parquet(src)
    run()
    run()
    assert sorted((r.id, r.v) for r in spark.read.parquet(target).collect()) == [(i, 2 * i) for i in range(7)]
    # A failure before the last batch was committed: it runs again, with and without its ledger entry.
    last = max(int(n) for n in os.listdir(f"{ck}/commits") if n.isdigit())
    for lost in (False, True):
        for n in (str(last), f".{last}.crc"):
            if os.path.exists(f"{ck}/commits/{n}"):
                os.remove(f"{ck}/commits/{n}")
        if lost:
            shutil.rmtree(next(f"{ledger}/{d}" for d in os.listdir(ledger) if d.endswith(f"-{last}")))
        run()
        assert sorted((r.id, r.v) for r in spark.read.parquet(target).collect()) == [(i, 2 * i) for i in range(7)]
    jobs.ingest_files(spark, src, "id long", target, ledger, f"{ck}2", "id", lambda d: d.withColumn("v", F.col("id") * 2))
    assert spark.read.parquet(target).count() == 7  # a new checkpoint replaces nothing


def test_slot_windows(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01' + make_interval(0, 0, 0, id) ts, id % 2 g, 1.0 v from range(30)").withColumn("id", F.lit(1)).write.parquet(f"{tmp_path}/s")
    s = spark.readStream.schema("ts timestamp, g long, v double, id int").parquet(f"{tmp_path}/s")
    q = jobs.slot_windows(s, "ts", "v", ["g"]).writeStream.outputMode("append").format("memory").queryName("slots").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("slots").agg(F.sum("n")).first()[0] >= 10


def test_split_hash_is_of_the_sorted_list(spark):
    import hashlib

    from gridloom.operators import splits

    rows = [("a", s) for s in (10, 9, 101, 1)] + [("b", 5)]
    got = {r.partition: (r.hash, r.seasons) for r in splits.split_hash(spark.createDataFrame(rows, "partition string, season_id long"), ["partition"]).collect()}
    assert got == {"a": (hashlib.sha256(b"1,10,101,9").hexdigest(), 4), "b": (hashlib.sha256(b"5").hexdigest(), 1)}


def test_draws_of_a_bootstrap_are_dealt_over_tasks(spark, monkeypatch):
    from gridloom.operators import resampling

    monkeypatch.setattr(resampling, "DRAWS", 1000, raising=False)
    m = resampling.multiplicities(spark.range(70).withColumnRenamed("id", "u"), "u", 100)
    assert "RepartitionByExpression [u" in (plan := m._jdf.queryExecution().optimizedPlan().toString()) and "], 7" in plan
    got = m.groupBy("rep").agg(F.sum("m").alias("n"), F.max("u").alias("u")).collect()
    assert len(got) == 100 and all(r.n == 70 and r.u < 70 for r in got)
