"""Queries: earlier seasons of a field and blends with them, oracles of further arms, information per season."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import kernels as K
from ..operators import resampling as B
from ..operators import splits as G
from . import views as V
from .registry import query

#: Cells of ten metres whose grid lies a little differently in each season.
PRIOR = f"""WITH {V.CELLS}, {V.SEASONS}, c AS (SELECT season_id, grid_row * 4096 + grid_col AS cell_id, grid_row, grid_col, grid_row * 10 + season_id % 7 AS x, grid_col * 10 + season_id % 5 AS y, target, pred FROM cells),
 e AS (SELECT season_id, struct_extract(max(row(year, season_id)) OVER (PARTITION BY farm_id ORDER BY year RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 2) AS prev_season FROM seasons),
 m AS (SELECT t.season_id, t.cell_id, e.prev_season, min(row(sqrt((t.x - s.x) * (t.x - s.x) + (t.y - s.y) * (t.y - s.y)), s.cell_id)) AS b FROM c t JOIN e USING (season_id), (SELECT unnest([-1, 0, 1]) AS dr), (SELECT unnest([-1, 0, 1]) AS dc), c s
  WHERE s.season_id = e.prev_season AND s.grid_row = t.grid_row + dr AND s.grid_col = t.grid_col + dc AND (t.x - s.x) * (t.x - s.x) + (t.y - s.y) * (t.y - s.y) <= 25 GROUP BY 1, 2, 3),
 p AS (SELECT season_id, cell_id, prev_season, struct_extract(b, 2) AS prev_cell, struct_extract(b, 1) AS distance FROM m QUALIFY count(*) OVER (PARTITION BY season_id) >= 200)"""


def placed(spark, d):
    c, s = V.cells(spark, d), F.col("season_id")
    return c.select("season_id", (F.col("grid_row") * 4096 + F.col("grid_col")).alias("cell_id"), (F.col("grid_row") * 10 + s % 7).alias("x"), (F.col("grid_col") * 10 + s % 5).alias("y"), "target", "pred")


@query(f"""{PRIOR} SELECT season_id, cell_id, prev_season, prev_cell, round(distance, 6) AS distance FROM p""")
def j04_nearest_prior_cell(spark, d):
    return V.rounded(J.prior_cells(placed(spark, d), V.seasons(spark, d), "farm_id"))


#: Two unknowns by Cramer's rule, over all other years.
_SOLVED = "round(least(3, greatest(0, (y0 * x11 - y1 * x01) / (x00 * x11 - x01 * x01))), 6) AS b0, round(least(3, greatest(0, (y1 * x00 - y0 * x01) / (x00 * x11 - x01 * x01))), 6) AS b1"


@query(f"""{PRIOR}, r AS (SELECT a.year, CASE WHEN a.crop = b.crop THEN 'same crop' ELSE 'rotation' END AS relation, CAST(c.pred AS DOUBLE) AS f, CAST(q.target AS DOUBLE) AS g, CAST(c.target AS DOUBLE) AS t FROM p JOIN c USING (season_id, cell_id) JOIN c q ON q.season_id = p.prev_season AND q.cell_id = p.prev_cell JOIN seasons a ON a.season_id = p.season_id JOIN seasons b ON b.season_id = p.prev_season),
 s AS (SELECT subset, year, sum(f*f) x00, sum(f*g) x01, sum(g*g) x11, sum(f*t) y0, sum(g*t) y1 FROM (SELECT 'all' AS subset, * FROM r UNION ALL SELECT relation AS subset, * FROM r) GROUP BY 1, 2),
 o AS (SELECT subset, year, {", ".join(f"sum({n}) OVER (PARTITION BY subset) - {n} AS {n}" for n in ("x00", "x01", "x11", "y0", "y1"))}, count(*) OVER (PARTITION BY subset) AS years FROM s) SELECT subset, year, {_SOLVED} FROM o WHERE years > 1""")
def b06_blend_with_prior_season(spark, d):
    """Predictions and the earlier season's yields of the same place, over all pairs, those of one crop, and rotations."""
    c, s = placed(spark, d), V.seasons(spark, d)
    r = J.prior_cells(c, s, "farm_id").join(c.select("season_id", "cell_id", "target", "pred"), ["season_id", "cell_id"])
    r = r.join(c.select(F.col("season_id").alias("prev_season"), F.col("cell_id").alias("prev_cell"), F.col("target").alias("prior")), ["prev_season", "prev_cell"])
    r = r.join(s.select("season_id", "crop", "year"), "season_id").join(s.select(F.col("season_id").alias("prev_season"), F.col("crop").alias("prev_crop")), "prev_season")
    r = r.withColumn("subset", F.explode(F.array(F.lit("all"), F.when(F.col("crop") == F.col("prev_crop"), "same crop").otherwise("rotation"))))
    r = r.select("subset", "year", *[F.col(x).cast("double").alias(x) for x in ("target", "pred", "prior")])
    several = r.groupBy("subset").agg(F.min("year").alias("low"), F.max("year").alias("high")).filter("low < high")
    x = B.leave_one_out_blend(r.join(several.select("subset"), "subset", "left_semi"), ["subset"], "year", "target", ["pred", "prior"], (0.0, 3.0))
    return V.rounded(x.select("subset", "year", F.get("beta", F.lit(0)).alias("b0"), F.get("beta", F.lit(1)).alias("b1")))


def _blocks(spark, d):
    return G.block_folds(V.panel(spark, d), 4).withColumns({"x1": F.col("grid_row") * 1.0, "x2": F.col("grid_col") * 1.0})


@query(None)
def a46_boosted_trees(spark, d):
    return V.rounded(K.oracle_table(K.boosted_oracle(_blocks(spark, d), ["crop", "season_id"], "fold", ["pred", "x1", "x2"], "target"), ["crop"]), 5)
