"""Running sums over range partitions against windows."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.operators.ordered import in_order


@pytest.mark.parametrize("by", [[], ["g"], ["g", "h"]])
@pytest.mark.parametrize("partitions", [1, 7])
def test_in_order_is_a_window(spark, by, partitions):
    """A hot group over several partitions, small ones inside one, null groups, null summands and null orders."""
    x = F.xxhash64("id")
    df = spark.range(900).select("id", F.when(F.col("id") % 3 > 0, "hot").when(x % 7 == 0, None).otherwise((x % 5).cast("string")).alias("g"), (x % 2).alias("h"), F.when(x % 11 > 0, x % 100).alias("v"), F.when(F.col("id") % 50 > 0, x % 40).alias("o"))
    order = ["o", "id"]
    got = in_order(df, by, order, {"run": F.col("v"), "i": F.lit(1)}, {"next": F.col("v"), "next_id": F.col("id")}, partitions)
    assert got.columns == [*df.columns, "run", "i", "run_total", "i_total", "next", "next_id"]
    w = W.partitionBy(*by).orderBy(*order)
    run = w.rowsBetween(W.unboundedPreceding, 0)
    want = df.select("*", F.sum("v").over(run).alias("run"), F.sum(F.lit(1)).over(run).alias("i"), F.sum("v").over(W.partitionBy(*by)).alias("run_total"), F.count("*").over(W.partitionBy(*by)).alias("i_total"), F.lead("v").over(w).alias("next"), F.lead("id").over(w).alias("next_id"))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, (tuple(r) for r in want.collect())))


def test_no_rows(spark):
    df = spark.range(0).select("id", F.lit("a").alias("g"))
    assert in_order(df, ["g"], ["id"], {"n": F.lit(1)}).collect() == []
    assert in_order(df, [], ["id"], {"n": F.lit(1)}, {"next": F.col("id")}).collect() == []
