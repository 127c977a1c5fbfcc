"""Running sums, row numbers and next rows along an order, for groups of any size: range partitions, then one offset a partition and group.

A window of a whole table or of a large group would put it into one task. Here rows are range-partitioned by group and order, so
that a large group lies in several partitions; each partition sums up its own rows, and a table of one row for each partition
and group (at most partitions + groups) carries what stands before and after. The range partitions are stored once, as their bounds must
be the same for both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..util import cut


def in_order(df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column] | None = None, ahead: dict[str, Column] | None = None, partitions: int | None = None) -> DataFrame:
    """`df` with `name` (the sum over the group's rows up to this one) and `name_total` for each of `sums`, and the next row's value for each of `ahead`.

    A sum of F.lit(1) numbers the rows from 1. Nulls are groups and stand first in the order, as in a window; null summands count as nothing, and
    a sum of nothing is null as in SQL. Rows that are equal in group and order stay in one partition: give an order without large ties.
    """
    sums, ahead = sums or {}, ahead or {}
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.withColumns({**{f"__s_{k}": c for k, c in sums.items()}, **{f"__a_{k}": c for k, c in ahead.items()}}).repartitionByRange(n, *by, *order).withColumn("__p", F.spark_partition_id()))
    w = W.partitionBy("__p", *by).orderBy(*order)
    local = ranged.withColumns({f"__s_{k}": F.sum(f"__s_{k}").over(w.rowsBetween(W.unboundedPreceding, 0)) for k in sums} | {f"__a_{k}": F.lead(f"__a_{k}").over(w) for k in ahead} | {"__end": F.lead(F.lit(1)).over(w).isNull()})
    first = F.min_by(F.struct(F.lit(1).alias("__there"), *[F.col(f"__a_{k}").alias(k) for k in ahead]), F.struct(*order)).alias("__first")
    pieces = ranged.groupBy("__p", *by).agg(first, *[F.sum(f"__s_{k}").alias(k) for k in sums])
    v = W.partitionBy(*by).orderBy("__p")  # a row a partition in each group
    before = {f"__b_{k}": F.sum(k).over(v.rowsBetween(W.unboundedPreceding, -1)) for k in sums} | {f"{k}_total": F.sum(k).over(W.partitionBy(*by)) for k in sums}
    offsets = pieces.withColumns({**before, "__after": F.lead("__first").over(v)}).select(F.col("__p").alias("__q"), *[F.col(c).alias(f"__k_{c}") for c in by], *before, "__after")
    same = F.col("__p") == F.col("__q")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    x = local.join(offsets, same)
    plus = lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
    run = [plus(F.col(f"__b_{k}"), F.col(f"__s_{k}")).alias(k) for k in sums]
    following = [F.when(F.col("__end"), F.col(f"__after.{k}")).otherwise(F.col(f"__a_{k}")).alias(k) for k in ahead]
    return x.select(*df.columns, *run, *[f"{k}_total" for k in sums], *following)
