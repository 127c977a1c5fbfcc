"""How far held-out groups lie from the rest: out-of-fold logistic scores of every group and arm, fitted together.

All models (arm, group, fold) take their Newton steps at once: one pass over the rows gives the gradients and curvatures of
every model as additive sums, so the number of passes is that of the steps and doesn't grow with groups, folds or arms (beyond `TOGETHER`
groups, in blocks of as many). Rows that agree in group, fold, features and target are one row with their number, in all passes and scores. The driver solves systems of features + 1 unknowns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..util import cut
from .metrics import auroc

TOGETHER, STEPS, PENALTY = 200, 30, 0.01


class Models:
    """Coefficients [group, fold, intercept and features] of an arm, with what standardises a fold's training rows."""

    def __init__(self, columns: list[int], mean: np.ndarray, sd: np.ndarray, groups: int):
        self.columns, self.mean, self.sd = columns, mean, sd
        self.b = np.zeros((groups, len(mean), len(columns) + 1))

    def design(self, x: np.ndarray, fold: int) -> np.ndarray:
        z = (x[:, self.columns] - self.mean[fold]) / self.sd[fold]
        return np.concatenate([np.ones((len(z), 1)), z], 1)


def _probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _newton(rows: DataFrame, models: list[Models], groups: int, folds: int) -> None:
    """Fit all models; `rows` are (group number or -1, fold, x, how many)."""
    size = [len(m.columns) + 1 for m in models]
    shared_penalty = [np.diag([0.0, *[PENALTY] * (s - 1)]) for s in size]
    best = [np.full((groups, folds), np.inf) for _ in models]
    kept, step = [m.b.copy() for m in models], [np.zeros_like(m.b) for m in models]
    for _ in range(STEPS):
        shared = rows.sparkSession.sparkContext.broadcast(models)

        def sums(batches):
            known = shared.value
            held = [np.zeros((groups, folds, s * s + s + 2)) for s in size]
            for pdf in batches:
                x, g, f = np.stack(pdf["x"].to_numpy()) if len(pdf) else np.zeros((0, 1)), pdf["g"].to_numpy(), pdf["fold"].to_numpy()
                w = pdf["w"].to_numpy()[:, None].astype(float)
                for m, h in zip(known, held):
                    for k in range(folds):
                        use = f != k
                        if not use.any():
                            continue
                        z, y = m.design(x[use], k), (g[use, None] == np.arange(groups)).astype(float)
                        eta = z @ m.b[:, k].T
                        p, of = _probability(eta), w[use]
                        s = z.shape[1]
                        for j in range(groups):
                            h[j, k, : s * s] += ((z * (of[:, 0] * p[:, j] * (1 - p[:, j]))[:, None]).T @ z).ravel()
                        h[:, k, s * s : s * s + s] += (of * (y - p)).T @ z
                        h[:, k, -2] += (of * (np.logaddexp(0, eta) - y * eta)).sum(0)
                        h[:, k, -1] += of.sum()
            for a, h in enumerate(held):
                yield pd.DataFrame({"arm": a, "g": np.repeat(np.arange(groups), folds), "k": np.tile(np.arange(folds), groups), "v": list(h.reshape(groups * folds, -1))})

        parts = rows.mapInPandas(sums, "arm int, g int, k int, v array<double>").select("arm", "g", "k", F.posexplode("v").alias("i", "v"))
        total = [np.zeros((groups, folds, s * s + s + 2)) for s in size]
        for r in parts.groupBy("arm", "g", "k", "i").agg(F.sum("v").alias("v")).collect():
            total[r["arm"]][r["g"], r["k"], r["i"]] = r["v"]
        moved = 0.0
        for a, (m, t, s, ridge) in enumerate(zip(models, total, size, shared_penalty)):
            for j in range(groups):
                for k in range(folds):
                    n = max(1.0, t[j, k, -1])
                    loss = t[j, k, -2] / n + 0.5 * PENALTY * (m.b[j, k, 1:] ** 2).sum()
                    if loss > best[a][j, k] + 1e-12:  # too far: half the last step from where it was better
                        step[a][j, k] /= 2
                    else:
                        best[a][j, k], kept[a][j, k] = loss, m.b[j, k]
                        curve = t[j, k, : s * s].reshape(s, s) / n + ridge + 1e-10 * np.eye(s)
                        step[a][j, k] = np.linalg.solve(curve, t[j, k, s * s : s * s + s] / n - ridge @ m.b[j, k])
                    moved = max(moved, float(np.abs(step[a][j, k]).max()))
            m.b = kept[a] + step[a]
        shared.unpersist()
        if moved < 1e-9:
            return


def shift_scores(df: DataFrame, group: str, arms: dict[str, list[str]], target: str, folds: int = 5, key: Column | None = None) -> DataFrame:
    """(group, n, target_shift, auroc_<arm>): how well each group is told from the rest, and how far its target mean lies off in deviations of the rest.

    Every row is scored by models fitted without its fold (the hash of `key`, or of all features). Features are standardised by the training
    rows, with a ridge penalty of 0.01 a row. A group that is missing from, or fills, the training rows of a fold scores them all alike.
    """
    names = list(dict.fromkeys(c for cols in arms.values() for c in cols))
    values = F.array(*[F.col(c).cast("double") for c in names])
    hashed = F.xxhash64(*([key] if key is not None else names))
    rows = df.select(F.col(group).alias("__g"), F.col(target).cast("double").alias("y"), values.alias("x"), F.pmod(hashed, F.lit(folds)).cast("int").alias("fold")).filter(F.col("__g").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    rows = cut(rows.groupBy("__g", "y", "x", "fold").agg(F.count("*").alias("w")))
    groups = sorted(r["__g"] for r in rows.select("__g").distinct().collect())
    if not groups:
        kinds = dict(df.dtypes)
        return df.sparkSession.createDataFrame([], f"`{group}` {kinds[group]}, n long, target_shift double, " + ", ".join(f"auroc_{a} double" for a in arms))
    moments = rows.select("fold", "w", F.posexplode("x").alias("i", "v")).groupBy("fold", "i").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("v")).alias("s"), F.sum(F.col("w") * F.col("v") * F.col("v")).alias("ss"))
    n, s, ss = (np.zeros((folds, len(names))) for _ in range(3))
    for r in moments.collect():
        n[r["fold"], r["i"]], s[r["fold"], r["i"]], ss[r["fold"], r["i"]] = r["n"], r["s"], r["ss"]
    rest = lambda v: v.sum(0) - v
    mean = rest(s) / np.maximum(rest(n), 1)
    sd = np.sqrt(np.maximum(rest(ss) - rest(n) * mean**2, 0) / np.maximum(rest(n) - 1, 1))
    sd[sd <= 1e-12 * np.maximum(1, np.abs(mean))] = 1.0
    scored = None
    for at in range(0, len(groups), TOGETHER):
        own = groups[at : at + TOGETHER]
        table = df.sparkSession.createDataFrame([(g, i) for i, g in enumerate(own)], f"__g {dict(df.dtypes)[group]}, g int")
        some = rows.join(F.broadcast(table), "__g", "left").select(F.coalesce("g", F.lit(-1)).alias("g"), "fold", "x", "w")  # TOGETHER rows
        models = [Models([names.index(c) for c in cols], mean[:, [names.index(c) for c in cols]], sd[:, [names.index(c) for c in cols]], len(own)) for cols in arms.values()]
        _newton(some, models, len(own), folds)
        part = _scores(some, models, len(own), folds).join(F.broadcast(table), "g")
        scored = part if scored is None else scored.unionByName(part)
    told = auroc(scored, "s", "y", ["__g", "arm"], times="w")
    wide = told.groupBy("__g", "n").pivot("arm", list(range(len(arms)))).agg(F.first("auroc"))
    return wide.join(_target_shift(rows), "__g").select(F.col("__g").alias(group), "n", "target_shift", *[F.col(str(a)).alias(f"auroc_{name}") for a, name in enumerate(arms)])


def _scores(rows: DataFrame, models: list[Models], groups: int, folds: int) -> DataFrame:
    """(arm, g, y, s, w): each row's score by each group's model of its fold; a score a row, group and arm is what the AUROC of all groups reads."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for pdf in batches:
            for k in range(folds):
                part = pdf[pdf["fold"] == k]
                if len(part):
                    x, g = np.stack(part["x"].to_numpy()), part["g"].to_numpy()
                    for a, m in enumerate(shared.value):
                        s = _probability(m.design(x, k) @ m.b[:, k].T)
                        yield pd.DataFrame({"arm": a, "g": np.tile(np.arange(groups), len(part)), "y": (g[:, None] == np.arange(groups)).astype(np.int32).ravel(), "s": s.ravel(), "w": np.repeat(part["w"].to_numpy(), groups)})

    return rows.mapInPandas(run, "arm int, g int, y int, s double, w long")


def _target_shift(rows: DataFrame) -> DataFrame:
    """(group, target_shift) from sums of the groups, about the mean of all."""
    known = F.sum(F.when(F.col("y").isNotNull(), F.col("w")))
    middle = rows.agg(F.try_divide(F.sum(F.col("w") * F.col("y")), known).alias("__m"))
    e = F.col("y") - F.col("__m")
    g = rows.crossJoin(middle).groupBy("__g").agg(F.coalesce(known, F.lit(0)).alias("n"), F.sum(F.col("w") * e).alias("s"), F.sum(F.col("w") * e * e).alias("ss"))  # the mean is one row
    total = g.agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"), F.sum("ss").alias("tss"))
    x = g.crossJoin(total)
    n, s, ss = F.col("tn") - F.col("n"), F.col("ts") - F.col("s"), F.col("tss") - F.col("ss")
    sd = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(ss, n) - F.pow(F.try_divide(s, n), 2)))
    return x.select("__g", F.try_divide(F.try_divide("s", "n") - F.try_divide(s, n), sd).alias("target_shift"))
