"""Small helpers shared by the text operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; pure ASCII rows take the fast built-in."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints. Only a local session, as in tests, may go without: it gets one of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("spark.checkpoint.dir names no shared folder; executors of a cluster can't read the driver's own")
            import tempfile

            named = tempfile.mkdtemp(prefix="ckpt-")
        sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage with a compressed table in the shared folder: a fraction of a checkpoint's bytes."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._stored_at = path  # only tables made here are ever deleted
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of `stored` that nothing reads any more; any other DataFrame is left alone."""
    for df in tables:
        if path := getattr(df, "_stored_at", None):
            sc = df.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now: it does so when the driver's collectors find that nothing refers to them.

    The last execution is referred to until another one has run, so a tiny one comes first.
    """
    import gc

    gc.collect()
    spark.range(1).count()
    spark.sparkContext._jvm.System.gc()


def sha_hex(c: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, lowercase hex."""
    return F.sha2(c.cast("binary"), 256)
