"""Ingest of items with failures, retries and repeated batches; ranged fingerprints; table functions."""

import datetime
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from gridloom.functions import tables as TF
from gridloom.sources import tables as S
from gridloom.streaming import jobs

IN, OUT = "id long, v double", "part int, twice double"


def step(broken):
    def f(item):
        if item["id"] in broken:
            yield {"part": 0, "twice": -1.0}  # what a failing item made before is left out
            raise ValueError(f"no {item['id']}")
        for k in range(int(item["id"]) % 3):
            yield {"part": k, "twice": None if item["v"] is None else 2 * item["v"]}

    return f


@pytest.fixture
def places(spark, tmp_path):
    src = f"{tmp_path}/src"
    spark.createDataFrame([(k, None if k == 4 else float(k)) for k in range(12)], IN).coalesce(2).write.parquet(src)
    return {"source": src, "target": f"{tmp_path}/target", "ledger": f"{tmp_path}/ledger", "quarantine": f"{tmp_path}/bad", "checkpoint": f"{tmp_path}/ck"}


def rows(spark, path, *columns):
    return sorted(map(tuple, spark.read.parquet(path).select(*columns).collect()), key=str)


def want(ids, broken=()):
    return sorted(((k, j, None if k == 4 else 2.0 * k) for k in ids if k not in broken for j in range(k % 3)), key=str)


def test_a_failing_item_is_kept_apart_and_retried(spark, places):
    run = lambda broken: jobs.ingest_items(spark, places["source"], IN, places["target"], places["ledger"], places["quarantine"], places["checkpoint"], "id", step(broken), OUT)
    retry = lambda broken: jobs.retry_quarantined(spark, IN, places["target"], places["ledger"], places["quarantine"], "id", step(broken), OUT)
    run({2, 4, 5})
    assert rows(spark, places["target"], "id", "part", "twice") == want(range(12), {2, 4, 5})
    assert [r[:2] for r in rows(spark, places["quarantine"], "id", "error")] == [(k, f"ValueError: no {k}") for k in (2, 4, 5)]
    assert [r[0] for r in rows(spark, places["ledger"], "id")] == sorted(set(range(12)) - {2, 4, 5}, key=lambda k: f"({k},)")
    run(set())  # nothing new in the source
    assert len(rows(spark, places["target"], "id")) == len(want(range(12), {2, 4, 5}))
    retry({5})
    assert rows(spark, places["target"], "id", "part", "twice") == want(range(12), {5})
    spark.createDataFrame([(20, 1.0), (3, 9.0)], IN).coalesce(1).write.mode("append").parquet(places["source"])
    run(set())  # a new item, and one whose key is done
    retry(set())
    retry(set())
    assert rows(spark, places["target"], "id", "part", "twice") == sorted([*want(range(12)), (20, 0, 2.0), (20, 1, 2.0)], key=str)


def test_a_retry_that_broke_off_leaves_nothing_twice(spark, places):
    jobs.ingest_items(spark, places["source"], IN, places["target"], places["ledger"], places["quarantine"], places["checkpoint"], "id", step({7, 8}), OUT)
    jobs.retry_quarantined(spark, IN, places["target"], places["ledger"], places["quarantine"], "id", step(set()), OUT)
    os.rename(f"{places['ledger']}/ingest_batch=retry-0", f"{places['ledger']}-lost")  # as if it had ended before its ledger
    jobs.retry_quarantined(spark, IN, places["target"], places["ledger"], places["quarantine"], "id", step(set()), OUT)
    assert rows(spark, places["target"], "id", "part", "twice") == want(range(12))


def test_fail_publishes_nothing_and_the_next_run_takes_all(spark, places):
    args = [spark, places["source"], IN, places["target"], places["ledger"], places["quarantine"], places["checkpoint"], "id"]
    with pytest.raises(Exception, match="no 7"):
        jobs.ingest_items(*args, step({7}), OUT, on_error="fail")
    assert not os.path.exists(places["target"]) and not os.path.exists(places["ledger"])
    jobs.ingest_items(*args, step(set()), OUT, on_error="fail")
    assert rows(spark, places["target"], "id", "part", "twice") == want(range(12))
    with pytest.raises(ValueError):
        jobs.ingest_items(*args, step(set()), OUT, on_error="ignore")


def test_only_the_ends_of_a_large_file_are_read(spark, tmp_path):
    big, small = tmp_path / "big.bin", tmp_path / "small.bin"
    with open(big, "wb") as f:  # a hole of three gigabytes
        f.write(b"head" * 20_000)
        f.truncate(3 << 30)
        f.seek((3 << 30) - 5)
        f.write(b"tail!")
    small.write_bytes(b"abc")
    (tmp_path / "none.bin").write_bytes(b"")  # the listing leaves empty files out
    got = {r["path"].rsplit("/", 1)[-1]: r for r in S.fingerprints(spark, f"{tmp_path}/*.bin").collect()}
    head, tail = (b"head" * 20_000)[: 1 << 16], bytes((1 << 16) - 5) + b"tail!"
    assert got["big.bin"]["length"] == 3 << 30 and got["big.bin"]["digest"] == hashlib.sha256(head + tail).hexdigest()
    assert got["small.bin"]["digest"] == hashlib.sha256(b"abcabc").hexdigest()
    listed = spark.read.format("binaryFile").load(f"{tmp_path}/*.bin").select("path", "length")
    assert S.file_ends(listed, 1 << 16).agg(F.max("bytes_read")).first()[0] == 1 << 17
    with pytest.raises(Exception, match="shorter"):
        S.file_ends(listed.filter("length = 3").withColumn("length", F.lit(9).cast("long")), 8).collect()


def test_slots_of_intervals(spark):
    d = datetime.date
    df = spark.createDataFrame([(1, d(2024, 2, 9), d(2024, 3, 1)), (2, d(2024, 12, 31), d(2025, 1, 1)), (3, d(2024, 1, 2), d(2024, 1, 1)), (4, None, d(2024, 1, 1))], "id int, a date, b date")
    got = TF.fan_out(df, TF.SlotsOf, TF.SLOT_SCHEMA, F.col("a"), F.col("b")).orderBy("id", "slot_start").collect()
    assert [tuple(r)[0:1] + tuple(r)[3:] for r in got] == [(1, d(2024, 2, 1), 2), (1, d(2024, 2, 11), 10), (1, d(2024, 2, 21), 9), (1, d(2024, 3, 1), 1), (2, d(2024, 12, 21), 1), (2, d(2025, 1, 1), 1)]
