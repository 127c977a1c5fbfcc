"""Queries: oracles fitted a season, shift scores of both arms, blends with earlier seasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import kernels as K
from ..operators import oracles as O
from ..operators import resampling as B
from ..operators import shift as X
from ..operators import splits as G
from ..operators.sampling import mixed_sql
from . import views as V
from .q_priors import PRIOR, placed
from .registry import query


def _cramer(a: list[list[str]], y: list[str]) -> list[str]:
    """The solution of two or three equations as SQL."""

    def det(m):
        if len(m) == 2:
            return f"({m[0][0]} * {m[1][1]} - {m[0][1]} * {m[1][0]})"
        return "(" + " + ".join(f"{m[0][k]} * ({m[1][(k + 1) % 3]} * {m[2][(k + 2) % 3]} - {m[1][(k + 2) % 3]} * {m[2][(k + 1) % 3]})" for k in range(3)) + ")"

    n = len(a)
    return [f"{det([[y[r] if c == k else a[r][c] for c in range(n)] for r in range(n)])} / {det(a)}" for k in range(n)]


def ridge_sql(features: dict[str, str]) -> str:
    """Out-of-fold ridge of each season from sums: those of all its cells less those of the fold, standardised, plus one on the diagonal."""
    k = range(len(features))
    sums = {"n": "count(*)", "b": "sum(y)"} | {f"m{i}": f"sum(x{i})" for i in k} | {f"g{i}{j}": f"sum(x{i} * x{j})" for i in k for j in k if j >= i} | {f"h{i}": f"sum(x{i} * y)" for i in k}
    cov = lambda i, j: f"(g{min(i, j)}{max(i, j)} - n * m{i} * m{j}) / (s{i} * s{j})" + (" + 1" if i == j else "")
    beta = _cramer([[f"c{min(i, j)}{max(i, j)}" for j in k] for i in k], [f"e{i}" for i in k])
    return f"""{V.PANEL}, d AS (SELECT season_id, br, bc, (row_number() OVER (PARTITION BY season_id ORDER BY {mixed_sql('br * 4096 + bc + season_id * 97')}, br, bc) - 1) % 5 AS fold FROM (SELECT DISTINCT season_id, grid_row // 4 AS br, grid_col // 4 AS bc FROM cells)),
 x AS (SELECT crop, season_id, d.fold, CAST(target AS DOUBLE) AS y, {', '.join(f'CAST({e} AS DOUBLE) AS x{i}' for i, e in enumerate(features.values()))} FROM cells JOIN seasons USING (season_id) JOIN d USING (season_id) WHERE d.br = grid_row // 4 AND d.bc = grid_col // 4 QUALIFY count(*) OVER (PARTITION BY season_id) >= 200),
 f AS (SELECT season_id, fold, {', '.join(f'{e} AS {n}' for n, e in sums.items())} FROM x GROUP BY 1, 2), t AS (SELECT season_id, fold, {', '.join(f'sum({n}) OVER w - {n} AS {n}' for n in sums)} FROM f WINDOW w AS (PARTITION BY season_id)),
 u AS (SELECT season_id, fold, n, b / n AS b, {', '.join(f'm{i} / n AS m{i}, greatest(sqrt(greatest(0, g{i}{i} / n - (m{i} / n) * (m{i} / n))), 1e-12) AS s{i}, h{i}' for i in k)}, {', '.join(n for n in sums if n[0] == 'g')} FROM t),
 v AS (SELECT *, {', '.join(f'{cov(i, j)} AS c{i}{j}' for i in k for j in k if j >= i)}, {', '.join(f'(h{i} - n * m{i} * b) / s{i} AS e{i}' for i in k)} FROM u), w AS (SELECT *, {', '.join(f'{e} AS beta{i}' for i, e in enumerate(beta))} FROM v),
 z AS (SELECT crop, season_id, count(*) AS n, sum((y - b - ({' + '.join(f'beta{i} * (x{i} - m{i}) / s{i}' for i in k)})) ** 2) AS sse, var_pop(y) * count(*) AS sst FROM x JOIN w USING (season_id, fold) GROUP BY 1, 2)
 SELECT crop, count(*) AS fields, CAST(sum(n) AS BIGINT) AS cells, round(1 - sum(sse) / sum(sst), 5) AS r2 FROM z GROUP BY 1"""


def _ridge(spark, d, features):
    x = G.block_folds(V.panel(spark, d), 4).withColumns({"x1": F.col("grid_row") * 1.0, "x2": F.col("grid_col") * 1.0})
    return V.rounded(K.oracle_table(K.ridge_oracle(x, ["crop", "season_id"], "fold", features, "target"), ["crop"]), 5)


@query(ridge_sql({"pred": "pred", "x1": "grid_row", "x2": "grid_col"}))
def a46_a47_ridge_oracle(spark, d):
    return _ridge(spark, d, ["pred", "x1", "x2"])


@query(ridge_sql({"x1": "grid_row", "x2": "grid_col"}))
def a46_coordinates_only(spark, d):
    return _ridge(spark, d, ["x1", "x2"])


@query(None)
def a46_a47_oracles_per_season(spark, d):
    """Boosted trees, ridge and coordinates alone, fitted a season, block size and fold."""
    p = V.panel(spark, d)
    cells = [G.block_folds(p, size).withColumn("block", F.lit(size)) for size in (4, 8)]
    x = reduce(lambda a, b: a.unionByName(b), cells)
    scores = O.season_oracle(x, ["crop", "season_id", "block"], "fold", ["pred", "n_src", "grid_row"], ["grid_row", "grid_col"], "target", rounds=8, rate=0.2, leaves=6)
    return V.rounded(K.oracle_table(scores, ["crop", "block", "method"]), 5)


def _season_features(spark, d):
    return V.panel(spark, d).groupBy("crop", "season_id").agg(F.avg("pred").alias("p"), F.stddev_pop("pred").alias("q"), F.avg("n_src").alias("r"), F.avg("target").alias("target"))


@query(f"{V.PANEL} SELECT crop, season_id, round(avg(pred), 6) AS p, round(stddev_pop(pred), 6) AS q, round(avg(n_src), 6) AS r, round(avg(target), 6) AS target FROM cells JOIN seasons USING (season_id) GROUP BY 1, 2")
def a48_season_features(spark, d):
    return V.rounded(_season_features(spark, d))


@query(None)
def a48_a49_shift_scores(spark, d):
    """Each crop told from the rest by all features and by those of the imagery alone, over the seasons."""
    return V.rounded(X.shift_scores(_season_features(spark, d), "crop", {"all": ["p", "q", "r"], "imagery": ["p", "q"]}, "target", key=F.col("season_id")), 4)


@query(None)
def a49_shift_of_cells(spark, d):
    """The same over all cells, a group a year."""
    return V.rounded(X.shift_scores(V.panel(spark, d), "year", {"all": ["pred", "n_src", "grid_row"], "imagery": ["pred"]}, "target", key=F.col("season_id")), 4)


def _det(m):
    (a, b, c), (d, e, f), (g, h, i) = m
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


_GRAM, _RIGHT = [["mm", "m1", "m2"], ["m1", "f11", "f12"], ["m2", "f12", "f22"]], ["my", "y1", "y2"]
_WEIGHTS = [f"{_det([[_RIGHT[r] if c == k else _GRAM[r][c] for c in range(3)] for r in range(3)])} / {_det(_GRAM)}" for k in range(3)]
_SUMS = {"mm": "m*m", "m1": "m*f1", "m2": "m*f2", "f11": "f1*f1", "f12": "f1*f2", "f22": "f2*f2", "my": "m*y", "y1": "f1*y", "y2": "f2*y", "e2": "f2*(y-m)"}


@query(f"""{PRIOR}, r AS (SELECT a.crop, a.season_id, a.year, CASE WHEN a.crop = b.crop THEN 'same_crop' ELSE 'rotation' END AS relation, a.year - b.year AS gap, CAST(c.target AS DOUBLE) AS y, CAST(c.pred AS DOUBLE) AS m, CAST(q.target AS DOUBLE) AS p, CAST(q.pred AS DOUBLE) AS q
 FROM p JOIN c USING (season_id, cell_id) JOIN c q ON q.season_id = p.prev_season AND q.cell_id = p.prev_cell JOIN seasons a ON a.season_id = p.season_id JOIN seasons b ON b.season_id = p.prev_season),
 t AS (SELECT *, avg(y) OVER w ay, avg(m) OVER w am, avg(p) OVER w ap, avg(p - q) OVER w ar, stddev_pop(m) OVER w sm, stddev_pop(p) OVER w sp, stddev_pop(p - q) OVER w sr, covar_samp(p, q) OVER w cv, var_pop(q) OVER w vq FROM r WINDOW w AS (PARTITION BY season_id)),
 x AS (SELECT crop, season_id, year, relation, gap, y - ay AS y, m - am AS m, sm * (p - ap) / sp AS f1, sm * (p - q - ar) / sr AS f2, least(3, greatest(0, cv / greatest(vq, 1e-12))) AS slope FROM t),
 g AS (SELECT crop, year, {", ".join(f"sum({e}) AS {n}" for n, e in _SUMS.items())} FROM x GROUP BY 1, 2), o AS (SELECT crop, year, {", ".join(f"sum({n}) OVER (PARTITION BY crop) - {n} AS {n}" for n in _SUMS)}, count(*) OVER (PARTITION BY crop) AS years FROM g),
 v AS (SELECT crop, year, years > 1 AS fitted, y1 / f11 AS w1, (my * f11 - y1 * m1) / (mm * f11 - m1 * m1) AS w20, (y1 * mm - my * m1) / (mm * f11 - m1 * m1) AS w21, e2 / f22 AS w3, {_WEIGHTS[0]} AS w40, {_WEIGHTS[1]} AS w41, {_WEIGHTS[2]} AS w42 FROM o),
 s AS (SELECT crop, season_id, relation, gap, y, unnest([{{'method': 'M0', 'v': m}}, {{'method': 'M1', 'v': CASE WHEN fitted THEN w1 * f1 ELSE m END}}, {{'method': 'M2', 'v': CASE WHEN fitted THEN w20 * m + w21 * f1 ELSE m END}}, {{'method': 'M3', 'v': CASE WHEN fitted THEN m + w3 * f2 ELSE m END}},
 {{'method': 'M4', 'v': CASE WHEN fitted THEN w40 * m + w41 * f1 + w42 * f2 ELSE m END}}, {{'method': 'M5', 'v': slope * m}}]) AS z FROM x JOIN v USING (crop, year)),
 er AS (SELECT crop, season_id, relation, gap, z.method AS method, sum((z.v - y) * (z.v - y)) AS sse, sum(y * y) AS sst FROM s GROUP BY ALL), u AS (SELECT *, unnest(CASE WHEN gap = 1 THEN ['all', relation, 'previous_year'] ELSE ['all', relation] END) AS subset FROM er)
 SELECT crop, subset, method, count(*) AS seasons, round(1 - sum(sse) / sum(sst), 5) AS within_r2 FROM u GROUP BY 1, 2, 3""")
def b06_blends_of_prior_seasons(spark, d):
    """Six blends with the latest earlier season of the field, over all seasons, those of one crop, rotations, and priors of the year before."""
    c, s = placed(spark, d), V.seasons(spark, d)
    r = J.prior_cells(c, s, "farm_id").join(c.select("season_id", "cell_id", "target", "pred"), ["season_id", "cell_id"])
    r = r.join(c.select(F.col("season_id").alias("prev_season"), F.col("cell_id").alias("prev_cell"), F.col("target").alias("prior"), F.col("pred").alias("prior_pred")), ["prev_season", "prev_cell"])
    r = r.join(s.select("season_id", "crop", "year"), "season_id").join(s.select(F.col("season_id").alias("prev_season"), F.col("crop").alias("prev_crop"), F.col("year").alias("prev_year")), "prev_season")
    names = F.array(F.lit("all"), F.when(F.col("crop") == F.col("prev_crop"), "same_crop").otherwise("rotation"), F.when(F.col("year") - F.col("prev_year") == 1, "previous_year"))
    return V.rounded(B.prior_blends(r, "crop", "season_id", "year", F.array_compact(names)), 5)
