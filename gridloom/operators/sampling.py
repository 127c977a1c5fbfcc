"""Deterministic sampling: hash uniforms instead of random state, so that a draw is the same on any cluster and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordered import in_order

#: Knuth's multiplier; products of ids below 2**31 stay within 64 bits.
KNUTH = 2654435761


def mixed(key: Column, seed: int = 0) -> Column:
    """An integer in [0, 2**32) from an integer key: two rounds of multiply and fold, the same in any engine with 64 bits."""
    x = (F.pmod(key, F.lit(1 << 31)) * KNUTH + seed * 40503) % (1 << 32)
    x = F.expr("0L") + x.bitwiseXOR(F.shiftright(x, 15))
    return (F.pmod(x, F.lit(1 << 31)) * KNUTH + 12345) % (1 << 32)


def uniform(key: Column, seed: int = 0) -> Column:
    """In (0, 1), by the key."""
    return (mixed(key, seed) + 0.5) / (1 << 32)


def mixed_sql(key: str, seed: int = 0) -> str:
    """The same as SQL, for oracles."""
    x = f"((({key}) % 2147483648 * {KNUTH} + {seed * 40503}) % 4294967296)"
    return f"((xor({x}, {x} >> 15) % 2147483648 * {KNUTH} + 12345) % 4294967296)"


def capped(df: DataFrame, by: list[str], key: Column, k: int, tie: list[str], seed: int = 0) -> DataFrame:
    """At most k rows of each group, those of the smallest hash."""
    w = W.partitionBy(*by).orderBy(mixed(key, seed), *tie)
    return df.withColumn("__i", F.row_number().over(w)).filter(F.col("__i") <= k).drop("__i")


def context_rows(df: DataFrame, by: list[str], key: Column, k: int, tie: list[str], seed: int = 0) -> DataFrame:
    """Exactly k rows of each group: hash order, repeated from the start only where the group is smaller."""
    w = W.partitionBy(*by)
    x = df.withColumns({"__i": F.row_number().over(w.orderBy(mixed(key, seed), *tie)) - 1, "__n": F.count("*").over(w)}).filter(F.col("__i") < k)
    times = F.ceil((F.lit(k) - F.col("__i")) / F.least(F.col("__n"), F.lit(k))).cast("int")
    return x.withColumn("draw", F.explode(F.sequence(F.lit(1), times))).drop("__i", "__n")


def balanced_draws(sizes: DataFrame, group: str, n: int, alpha: float = 0.5, seed: int = 0) -> DataFrame:
    """(draw, group): n draws of groups with probability proportional to size ** alpha.

    Groups become intervals of [0, 1); draws and intervals meet by the grid cells they touch, an equi-join.
    """
    grid = 1024
    p = in_order(sizes.select(group, F.pow(F.col("n").cast("double"), F.lit(alpha)).alias("__w")), [], [group], {"__run": F.col("__w")})
    p = p.select(group, ((F.col("__run") - F.col("__w")) / F.col("__run_total")).alias("lo"), (F.col("__run") / F.col("__run_total")).alias("hi"))
    p = p.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * grid).cast("int"), F.least(F.lit(grid - 1), F.floor(F.col("hi") * grid)).cast("int"))))
    d = sizes.sparkSession.range(n).select(F.col("id").alias("draw"), uniform(F.col("id"), seed).alias("u")).withColumn("cell", F.floor(F.col("u") * grid).cast("int"))
    return d.join(p, "cell").filter((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("draw", group)


def contiguous_block(draws: DataFrame, rows: DataFrame, group: str, order: list[str], length: int, seed: int = 1) -> DataFrame:
    """For each draw `length` consecutive rows of its group from a drawn place, cyclically."""
    r = in_order(rows, [group], order, {"__n": F.lit(1)}).withColumn("__i", F.col("__n") - 1).drop("__n", "__n_total")
    size = rows.groupBy(group).agg(F.count("*").alias("__m"))
    d = draws.join(size, group).withColumn("__start", F.floor(uniform(F.col("draw"), seed) * F.col("__m")))
    d = d.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(length - 1)))).withColumn("__i", (F.col("__start") + F.col("step")) % F.col("__m"))
    return d.join(r, [group, "__i"]).drop("__i", "__m", "__start")


def cluster_draws(anchors: DataFrame, cells: DataFrame, radius: int, m: int, season: str = "season_id", row: str = "grid_row", col: str = "grid_col", seed: int = 0) -> DataFrame:
    """Each anchor (draw, season, row, col) with up to m - 1 cells within the Chebyshev radius, by hash."""
    off = F.sequence(F.lit(-radius), F.lit(radius))
    a = anchors.withColumnsRenamed({row: "__r", col: "__c"}).withColumn("__dr", F.explode(off)).withColumn("__dc", F.explode(off))
    a = a.withColumns({row: F.col("__r") + F.col("__dr"), col: F.col("__c") + F.col("__dc")})
    x = a.join(cells.select(season, row, col), [season, row, col])
    own = (F.col("__dr") == 0) & (F.col("__dc") == 0)
    order = W.partitionBy("draw").orderBy(own.desc(), mixed(F.col(row) * 1024 + F.col(col) + F.col("draw") * 7, seed), row, col)
    return x.withColumn("__i", F.row_number().over(order)).filter(F.col("__i") <= m).select("draw", season, row, col)


def largest_remainder(df: DataFrame, by: list[str], key: str, weight: str, total: Column, floor: int = 1, out: str = "quota") -> DataFrame:
    """Integer shares of `total` in proportion to the weights, with a floor for positive weights while the total allows it.

    Leftover units go to the largest remainders, ties by key.
    """
    w = W.partitionBy(*by)
    live = F.col(weight) > 0
    x = df.withColumns({"__t": total.cast("long"), "__w": F.greatest(F.lit(0.0), F.coalesce(F.col(weight).cast("double"), F.lit(0.0)))})
    x = x.withColumns({"__live": F.count_if(live).over(w), "__sum": F.sum("__w").over(w)})
    x = x.withColumn("__f", F.when(live & (F.col("__t") > 0), F.least(F.lit(floor), F.floor(F.col("__t") / F.greatest(F.col("__live"), F.lit(1))))).otherwise(F.lit(0)).cast("long"))
    x = x.withColumn("__rest", F.greatest(F.lit(0), F.col("__t") - F.sum("__f").over(w)))
    x = x.withColumn("__share", F.when(F.col("__sum") > 0, F.col("__w") / F.col("__sum") * F.col("__rest")).otherwise(F.lit(0.0)))
    x = x.withColumn("__base", F.floor("__share").cast("long"))
    x = x.withColumn("__left", F.when(F.col("__sum") > 0, F.col("__rest") - F.sum("__base").over(w)).otherwise(F.lit(0)))
    rank = F.row_number().over(W.partitionBy(*by).orderBy((F.col("__share") - F.col("__base")).desc(), key))
    return x.withColumn(out, F.col("__f") + F.col("__base") + (rank <= F.col("__left")).cast("long")).drop("__t", "__w", "__live", "__sum", "__f", "__rest", "__share", "__base", "__left")


def year_quotas(df: DataFrame, n: str, years: list[int], offset: str) -> DataFrame:
    """`df` exploded to (year, quota): n split evenly, the extra units on the years from the offset on, cyclically."""
    k = len(years)
    x = df.select("*", F.posexplode(F.array(*map(F.lit, years))).alias("__y", "year"))
    extra = F.pmod(F.col("__y") - F.col(offset), F.lit(k)) < F.col(n) % k
    return x.withColumn("quota", F.expr(f"{n} div {k}") + extra.cast("long")).drop("__y")


def weighted_without_replacement(df: DataFrame, by: list[str], weight: str, key: Column, k: Column, tie: list[str], seed: int = 0) -> DataFrame:
    """k rows of each group with probability proportional to weight: the smallest -ln(u) / w."""
    e = F.when(F.col(weight) > 0, -F.log(uniform(key, seed)) / F.col(weight))
    x = df.withColumn("__e", e).filter("__e is not null")
    return x.withColumn("__i", F.row_number().over(W.partitionBy(*by).orderBy("__e", *tie))).filter(F.col("__i") <= k).drop("__e", "__i")


def select_clusters(candidates: DataFrame, by: list[str], quota: DataFrame, share: str, weight: str, key: str, taken: DataFrame | None = None, thresholds: tuple[float, ...] = (0.25, 0.10, 0.02), seed: int = 0) -> DataFrame:
    """Quota draws by weight among candidates above the highest share threshold that leaves enough of them.

    `quota` has a row per stratum with column quota; clusters in `taken` are out.
    """
    c = candidates if taken is None else candidates.join(taken.select(key), key, "left_anti")
    c = c.join(quota, by)
    w = W.partitionBy(*by)
    level = F.lit(thresholds[-1])
    for t in reversed(thresholds[:-1]):
        level = F.when(F.count_if(F.col(share) >= t).over(w) >= F.col("quota"), F.lit(t)).otherwise(level)
    c = c.withColumn("threshold", level).filter(F.col(share) >= F.col("threshold"))
    return weighted_without_replacement(c, by, weight, F.col(key), F.col("quota"), [key], seed)


def thinned(points: DataFrame, block: list[Column], key: str, keep: Column, seed: int = 0) -> DataFrame:
    """One point by hash of each block, among those to keep."""
    names = [f"__b{i}" for i in range(len(block))]
    x = points.filter(keep).withColumns(dict(zip(names, block)))
    w = W.partitionBy(*names).orderBy(mixed(F.col(key), seed), key)
    return x.withColumn("__i", F.row_number().over(w)).filter("__i = 1").drop("__i", *names)


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def observation_dropout(df: DataFrame, unit: Column, slot: Column, values: list[str], lowest: float = 0.5, seed: int = 0) -> DataFrame:
    """Each unit keeps its observations at a rate from U(lowest, 1); the same slots fall out in every value column."""
    rate = F.lit(lowest) + uniform(unit, seed) * (1 - lowest)
    kept = uniform(unit * 131 + slot, seed + 1) < rate
    return df.withColumns({v: F.when(kept, F.col(v)) for v in values})


def masked_observations(df: DataFrame, key: Column, ratio: float, value: str, seed: int = 0) -> DataFrame:
    hide = uniform(key, seed) < ratio
    return df.withColumns({"is_masked": hide & F.col(value).isNotNull(), value: F.when(~hide, F.col(value))})


def forecast_split(df: DataFrame, by: list[str], slot: str, value: str) -> DataFrame:
    """Hide the last valid slot of each series that has an earlier one: (rows without it, `target` on every row)."""
    w = W.partitionBy(*by)
    last = F.max(F.when(F.col(value).isNotNull(), F.col(slot))).over(w)
    n = F.count(value).over(w)
    x = df.withColumns({"__last": last, "__n": n}).filter("__n >= 2")
    return x.withColumn("target", F.max(F.when(F.col(slot) == F.col("__last"), F.col(value))).over(w)).filter(F.col(slot) < F.col("__last")).drop("__last", "__n")


def drop_stream(df: DataFrame, key: str, share: float, values: list[str]) -> DataFrame:
    """Null the values of a fixed share of rows: those with (key * Knuth) % 1000 below round(1000 share)."""
    hit = F.pmod(F.col(key) * KNUTH, F.lit(1000)) < round(share * 1000)
    return df.withColumns({v: F.when(~hit, F.col(v)) for v in values}).withColumn("dropped", hit)


def representative(df: DataFrame, by: list[str], score: str, key: str) -> DataFrame:
    """The median-rank row of each group."""
    w = W.partitionBy(*by)
    x = df.withColumns({"__i": F.row_number().over(w.orderBy(score, key)), "__n": F.count("*").over(w)})
    return x.filter(F.col("__i") == F.floor(F.col("__n") / 2) + 1).drop("__i", "__n")


def negatives(df: DataFrame, key: str, field: str, bucket: int, n: int, seed: int = 0) -> DataFrame:
    """(key, negative): up to n rows of other physical fields, from hash buckets of about `bucket` rows, never all pairs.

    A bucket's rows are one array that each of its rows looks through on the spot, so that no pair is shuffled or sorted.
    """
    total = df.count()
    b = (mixed(F.col(key), seed) % max(1, -(-total // bucket))).alias("__b")
    x = df.select(F.col(key), F.col(field), b)
    held = x.groupBy("__b").agg(F.collect_list(F.struct(F.col(key).alias("negative"), F.col(field).alias("f"))).alias("__held"))
    asking = x.groupBy("__b", key).agg(F.collect_list(field).alias("__own"))  # one row a key, however often it is there
    others = lambda f: F.filter("__held", lambda m: m["f"] != f)
    ranked = F.transform(F.flatten(F.transform("__own", others)), lambda m: F.struct(mixed(F.col(key) * 31 + m["negative"], seed).alias("h"), m["negative"].alias("negative")))
    found = F.array_compact(F.array(F.array_min(ranked))) if n == 1 else F.slice(F.array_sort(ranked), 1, n)
    return asking.join(held, "__b").select(key, F.explode(found).alias("__m")).select(key, "__m.negative")


def select_tiles(tiles: DataFrame, held_out: DataFrame, ground: str, by: list[str], key: Column, most: int, statistics: int, tie: list[str], seed: int = 0) -> DataFrame:
    """At most `most` training tiles of each group, by hash, none on ground that a held-out season uses; `for_statistics` marks the
    `statistics` first of them."""
    free = tiles.join(held_out.select(ground).distinct(), ground, "left_anti")
    w = W.partitionBy(*by).orderBy(mixed(key, seed), *tie)
    return free.withColumn("__i", F.row_number().over(w)).filter(F.col("__i") <= most).withColumn("for_statistics", F.col("__i") <= statistics).drop("__i")
