"""Panel views over the given tables, each as a DataFrame and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..util import spread

CELLS = """cells AS (
  SELECT l_suppkey AS season_id, l_orderkey % 32 AS grid_row, l_partkey % 32 AS grid_col,
         max(l_quantity) AS target, max(l_quantity) * (1 - max(l_discount)) AS pred, count(*) AS n_src
  FROM lineitem GROUP BY l_suppkey, l_orderkey % 32, l_partkey % 32)"""
SEASONS = """seasons AS (
  SELECT s.s_suppkey AS season_id, r.r_name AS country, concat('crop', s.s_suppkey % 4) AS crop, 2018 + s.s_suppkey % 6 AS year,
         concat('farm', s.s_suppkey % 7) AS farm_id, s.s_suppkey % 5 AS fold, x.n_rows
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN (SELECT season_id, count(*) AS n_rows FROM cells GROUP BY season_id) x ON x.season_id = s.s_suppkey)"""
ACQ = """acq AS (
  SELECT user_id AS cell_id, CAST(ts AS date) AS day, event_type AS scene, value AS b, event_id,
         CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 1 ELSE 0 END AS clear FROM events)"""
BOXES = """boxes AS (
  SELECT c_custkey AS id, c_nationkey AS grp, (c_custkey * 7919) % 1000 AS x0, (c_custkey * 104729) % 1000 AS y0,
         40 + c_custkey % 60 AS w, 40 + (c_custkey * 13) % 60 AS h FROM customer)"""
PANEL = f"WITH {CELLS}, {SEASONS}"


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    keys = [F.col("l_suppkey").alias("season_id"), (F.col("l_orderkey") % 32).alias("grid_row"), (F.col("l_partkey") % 32).alias("grid_col")]
    names = ["season_id", "grid_row", "grid_col"]
    return spread(l.select(*keys, "l_quantity", "l_discount"), *names).groupBy(*names).agg(F.max("l_quantity").alias("target"), (F.max("l_quantity") * (1 - F.max("l_discount"))).alias("pred"), F.count("*").alias("n_src"))


def places(spark, sf_dir: str) -> DataFrame:
    """Seasons without the number of their cells, those without cells among them."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    k = F.col("s_suppkey")
    joined = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(k.alias("season_id"), F.col("r_name").alias("country"), F.concat(F.lit("crop"), k % 4).alias("crop"), (2018 + k % 6).alias("year"), F.concat(F.lit("farm"), k % 7).alias("farm_id"), (k % 5).alias("fold"))


def seasons(spark, sf_dir: str) -> DataFrame:
    size = cells(spark, sf_dir).groupBy("season_id").agg(F.count("*").alias("n_rows"))
    return places(spark, sf_dir).join(size, "season_id")


def panel(spark, sf_dir: str) -> DataFrame:
    """Cells with the columns of their season."""
    return cells(spark, sf_dir).join(seasons(spark, sf_dir), "season_id")


def acq(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("cell_id"), F.to_date("ts").alias("day"), F.col("event_type").alias("scene"), F.col("value").alias("b"), "event_id", F.col("event_type").isin("view", "click", "purchase").cast("int").alias("clear"))


def boxes(spark, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.col("c_nationkey").alias("grp"), (k * 7919 % 1000).alias("x0"), (k * 104729 % 1000).alias("y0"), (40 + k % 60).alias("w"), (40 + k * 13 % 60).alias("h"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a sum leaves no trace."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
