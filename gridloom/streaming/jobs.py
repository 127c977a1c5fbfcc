"""Structured Streaming jobs: resumable file ingest with a ledger and a quarantine, mergeable statistics, slot windows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def ingest_files(spark: SparkSession, source: str, schema: str, target: str, ledger: str, checkpoint: str, key: str, step: Callable[[DataFrame], DataFrame], glob: str | None = None) -> None:
    """Everything new under `source` goes through `step` to `target` once; finished keys are appended to the ledger.

    Ends when the files at hand are done. Target and ledger are partitioned by `ingest_batch` (the query's id and the batch's number), and
    a batch replaces its own partitions: one repeated after a failure, wherever that was, adds nothing twice. Keys that other batches
    have in the ledger are skipped.
    """
    def publish(df: DataFrame, name: str) -> None:
        df = df.persist()
        step(df).write.mode("overwrite").parquet(f"{target}/ingest_batch={name}")
        df.select(key).distinct().write.mode("overwrite").parquet(f"{ledger}/ingest_batch={name}")
        df.unpersist()

    _each_batch(spark, source, schema, ledger, checkpoint, key, publish, glob)


def _read_or_none(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def _unfinished(spark: SparkSession, df: DataFrame, ledger: str, key: str, name: str) -> DataFrame:
    """Rows whose key no other batch has in the ledger."""
    done = _read_or_none(spark, ledger, StructType([df.schema[key], StructField("ingest_batch", StringType())]))
    return df if done is None else df.join(done.filter(F.col("ingest_batch") != name).select(key), key, "left_anti")


def _each_batch(spark: SparkSession, source: str, schema: str, ledger: str, checkpoint: str, key: str, publish: Callable[[DataFrame, str], None], glob: str | None) -> None:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64)
    if glob:
        reader = reader.option("pathGlobFilter", glob)

    def batch(df: DataFrame, number: int) -> None:
        query = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        name = f"{query}-{number}"
        publish(_unfinished(spark, df, ledger, key, name), name)

    reader.parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


#: A step for one item: its row as a dict to any number of rows.
Step = Callable[[dict], Iterable[dict]]


def attempted(df: DataFrame, key: str, step: Step, schema: str) -> DataFrame:
    """(key, item, error, out): a row for each row that the step makes of an item, one with neither out nor error if it makes none, and one with
    the error if it fails; what a failing item made before is left out. `item` is the row as JSON."""
    kind = dict(df.dtypes)[key]
    names = [f.name for f in StructType.fromDDL(schema).fields]

    def run(batches):
        for pdf in batches:
            out = []
            for row, item in zip(pdf.drop(columns="__item").to_dict("records"), pdf["__item"]):
                own = {k: None if v is None or v != v else v for k, v in row.items()}
                try:
                    made = [tuple(x.get(n) for n in names) for x in step(own)]
                    out += [(row[key], item, None, x) for x in made] or [(row[key], item, None, None)]
                except Exception as e:  # the policy decides about it
                    out.append((row[key], item, f"{type(e).__name__}: {e}", None))
            yield pd.DataFrame({key: [r[0] for r in out], "item": pd.Series([r[1] for r in out], dtype=object), "error": pd.Series([r[2] for r in out], dtype=object), "out": pd.Series([r[3] and dict(zip(names, r[3])) for r in out], dtype=object)})

    return df.withColumn("__item", F.to_json(F.struct(*df.columns))).mapInPandas(run, f"`{key}` {kind}, item string, error string, out struct<{', '.join(f'{f.name}: {f.dataType.simpleString()}' for f in StructType.fromDDL(schema).fields)}>")


def _publish_items(spark: SparkSession, df: DataFrame, name: str, target: str, ledger: str, quarantine: str, key: str, step: Step, schema: str, on_error: str) -> None:
    """One attempt at each item, kept in a table; then results, failures and last the ledger, each in the batch's own partition."""
    staged = f"{quarantine.rstrip('/')}-attempts/{name}"
    attempted(df, key, step, schema).write.mode("overwrite").parquet(staged)
    tried = spark.read.parquet(staged)
    failed = tried.filter("error is not null")
    if on_error == "fail" and (first := failed.select(key, "error").first()):
        raise ValueError(f"item {first[key]}: {first['error']}")
    tried.filter("out is not null").select(key, "out.*").write.mode("overwrite").parquet(f"{target}/ingest_batch={name}")
    failed.select(key, "item", "error").write.mode("overwrite").parquet(f"{quarantine}/ingest_batch={name}")
    tried.filter("error is null").select(key).distinct().write.mode("overwrite").parquet(f"{ledger}/ingest_batch={name}")


def ingest_items(spark: SparkSession, source: str, schema: str, target: str, ledger: str, quarantine: str, checkpoint: str, key: str, step: Step, out_schema: str, on_error: str = "skip", glob: str | None = None) -> None:
    """Every new item under `source` goes through `step` to `target` once; one that fails goes with its error to the quarantine.

    With on_error="skip" other items go on, and the failed one is not in the ledger, so that `retry_quarantined` may try it again. With "fail" the
    first error is raised before the batch publishes anything, and the next run takes the batch again. A repeated batch replaces its partitions.
    """
    if on_error not in ("skip", "fail"):
        raise ValueError("on_error is skip or fail")

    def publish(df: DataFrame, name: str) -> None:
        _publish_items(spark, df, name, target, ledger, quarantine, key, step, out_schema, on_error)

    _each_batch(spark, source, schema, ledger, checkpoint, key, publish, glob)


def retry_quarantined(spark: SparkSession, schema: str, target: str, ledger: str, quarantine: str, key: str, step: Step, out_schema: str) -> None:
    """Another attempt at the quarantined items that are not in the ledger.

    The attempt is numbered by those the ledger has, so one that broke off before its ledger is repeated under its own name and replaces what it left.
    """
    kind = StructType.fromDDL(schema)
    done = _read_or_none(spark, ledger, StructType([kind[key], StructField("ingest_batch", StringType())]))
    number = 0 if done is None else done.filter(F.col("ingest_batch").startswith("retry-")).select("ingest_batch").distinct().count()
    held = _read_or_none(spark, quarantine, StructType([kind[key], StructField("item", StringType()), StructField("error", StringType()), StructField("ingest_batch", StringType())]))
    if held is None:
        return
    name = f"retry-{number}"
    items = _unfinished(spark, held.filter(F.col("ingest_batch") != name).groupBy(key).agg(F.max("item").alias("item")), ledger, key, name)
    _publish_items(spark, items.select(F.from_json("item", kind).alias("x")).select("x.*"), name, target, ledger, quarantine, key, step, out_schema, "skip")


def running_statistics(stream: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, sum, sum of squares, least and largest of the values: for output mode update or complete."""
    v = F.col(value)
    return stream.groupBy(*by).agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("ss"), F.min(v).alias("mn"), F.max(v).alias("mx"))


def slot_windows(stream: DataFrame, ts: str, value: str, by: list[str], width: str = "10 days", late: str = "1 day") -> DataFrame:
    """Tumbling slots with a watermark, for output mode append."""
    g = stream.withWatermark(ts, late).groupBy(F.window(ts, width), *by)
    return g.agg(F.count("*").alias("n"), F.sum(value).alias("s")).select(F.col("window.start").alias("slot_start"), *by, "n", "s")
