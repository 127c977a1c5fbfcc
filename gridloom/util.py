"""Session helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a local session, as in tests, may name none: it gets one of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir names no shared folder; executors of a cluster can't read the driver's own")
            import tempfile

            named = tempfile.mkdtemp(prefix="ckpt-")
        sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the session's folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Rows that one task of `spread` holds, on average.
SHARE = 300_000


def spread(df: DataFrame, *keys, parts: int = 1) -> DataFrame:
    """`df` dealt by `keys` over so many tasks that the share of one (`SHARE` / `parts` rows) doesn't grow with the table; a table that the session's
    partitions keep under that is left as it is."""
    n = -(-df.count() * parts // SHARE)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage with a compressed table in the session's folder: a fraction of a checkpoint's bytes."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
