"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to `bits` bits by bounds of about equal row counts (numbers by approximate quantiles, strings by
the counts of their sorted values), the curve index of the cell orders the rows, and the order is cut into runs of equal row counts. Files written by shard then hold a
compact box of the metadata space, so that min/max statistics prune them on any of the dimensions.

Ranks need no global window: rows are range-partitioned on (curve index, id), so a hot cell with a third of all rows
is split by id; each partition numbers its own rows and a table of one row per partition supplies the offsets.
Only narrow columns are shuffled, never the texts.

Edge cases: null dimensions fall into cell 0; null texts have no bytes; repeated rows each get a slot; fewer rows
than shards leave shards empty; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ordered import in_order
from .common import cut, text_of


def curve_tables(dims: int) -> tuple[list[int], list[int]]:
    """(next state, digit) by state * 2**dims + cell, for the curve from Gray code steps with entry point e and direction d.

    A state is (e, d). A cell's position in its state is the Gray code inverse of the cell after the state's
    reflection and rotation; the child's state follows from the entry and direction of that position.
    """
    size = 1 << dims

    def turn(x: int, k: int) -> int:
        k %= dims
        return ((x >> k) | (x << (dims - k))) & (size - 1)

    def entry(i: int) -> int:
        return 0 if i == 0 else ((j := 2 * ((i - 1) // 2)) ^ (j >> 1))

    def direction(i: int) -> int:
        if i == 0:
            return 0
        x = i - 1 if i % 2 == 0 else i
        return ((~x & (x + 1)).bit_length() - 1) % dims

    states, todo, nxt, digit = {(0, 0): 0}, [(0, 0)], [], []
    while todo:
        e, d = todo.pop(0)
        for cell in range(size):
            gray, i = turn(cell ^ e, d + 1), 0
            while gray:
                i, gray = i ^ gray, gray >> 1
            child = (e ^ turn(entry(i), -(d + 1)), (d + direction(i) + 1) % dims)
            if child not in states:
                states[child] = len(states)
                todo.append(child)
            nxt.append(states[child])
            digit.append(i)
    return nxt, digit


def curve_index(dims: list[Column], bits: int) -> Column:
    """Hilbert index of integer cells in [0, 2**bits)."""
    n = len(dims)
    nxt, digit = curve_tables(n)
    levels = F.array(*[sum((F.shiftright(c, b).bitwiseAND(1) * (1 << k) for k, c in enumerate(dims)), F.lit(0)) for b in range(bits - 1, -1, -1)])
    follow, digits = F.array(*map(F.lit, nxt)), F.array(*map(F.lit, digit))
    start = F.struct(F.lit(0).alias("s"), F.lit(0).cast("long").alias("h"))
    step = lambda a, c: F.struct(F.get(follow, a["s"] * (1 << n) + c).alias("s"), (a["h"] * (1 << n) + F.get(digits, a["s"] * (1 << n) + c)).cast("long").alias("h"))
    return F.aggregate(levels, start, step)["h"]


#: Distinct strings of a dimension whose counts come to the driver; beyond, running counts over range partitions tell the bounds.
NAMES = 4096


def _count_below(c: Column):
    return lambda a, x: a + (c > x).cast("int")


def name_bounds(df: DataFrame, c: str, cells: int) -> list[str]:
    """At most cells - 1 strings, each the last of a run of sorted values, so that the runs hold about equal row counts.

    Every row counts. Of more than `NAMES` distinct values only those at which the running count of rows passes another share are collected.
    """
    counts = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).agg(F.count("*").alias("n"))
    rows = sorted((r["v"], r["n"]) for r in counts.limit(NAMES + 1).collect())
    if len(rows) > NAMES:
        share = lambda run: F.floor(run * cells / F.col("run_total"))
        passed = in_order(counts, [], ["v"], {"run": F.col("n")}).filter((share(F.col("run")) > share(F.col("run") - F.col("n"))) & (F.col("run") < F.col("run_total")))
        return sorted(r["v"] for r in passed.select("v").collect())  # at most cells - 1
    left, run, out = sum(n for _, n in rows), 0, []
    for v, n in rows[:-1]:
        run += n
        if len(rows) <= cells or run * (cells - len(out)) >= left:  # an equal share of what is left
            out.append(v)
            left, run = left - run, 0
        if len(out) == cells - 1:
            break
    return out


def quantised(df: DataFrame, dims: list[str], bits: int) -> list[Column]:
    """Cells of the dimensions: the number of bounds below the value, spread over all 2**bits cells; null is cell 0."""
    numeric = [c for c, t in df.dtypes if c in dims and t in ("int", "bigint", "double", "float", "smallint", "tinyint")]
    steps = [k / (1 << bits) for k in range(1, 1 << bits)]
    bounds = df.agg(*[F.percentile_approx(c, steps, 10_000).alias(c) for c in numeric]).first() if numeric else {}
    cells = []
    for c in dims:
        limits = sorted(set(bounds[c] or [])) if c in numeric else name_bounds(df, c, 1 << bits)
        if not limits:
            cells.append(F.lit(0))
            continue
        below = F.aggregate(F.array(*map(F.lit, limits)), F.lit(0), _count_below(F.col(c) if c in numeric else F.col(c).cast("string")))
        cells.append(F.coalesce(F.floor(below * ((1 << bits) / (len(limits) + 1))).cast("int"), F.lit(0)))
    return cells


def ranked(df: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """`df` with `rank` (0-based, by `order`) and `total`, without a single-partition window."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    local = local.withColumn("__p", F.shiftright("__id", 33)).withColumn("__i", F.col("__id").bitwiseAND((1 << 33) - 1))
    counts = local.groupBy("__p").agg(F.count("*").alias("__n"))  # a row per partition
    before = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(W.partitionBy()).alias("total"))
    return local.join(F.broadcast(offsets), "__p").withColumn("rank", F.col("__before") + F.col("__i")).drop("__id", "__p", "__i", "__n", "__before")


def shard(docs: DataFrame, n_shards: int = 40, dims: tuple[str, ...] = ("lang", "source", "n_chars"), bits: int = 5, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, curve, shard, slot: runs of the curve with row counts at most one apart."""
    t = text_of(text)
    index = curve_index(quantised(docs, list(dims), bits), bits)
    rows = docs.select(F.col(doc), (F.octet_length(t) + 16).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), index.alias("curve"))
    r = ranked(rows, ["curve", doc, "text_crc32"])
    r = r.withColumn("shard", F.expr(f"cast(rank * {n_shards} div total as int)"))
    first = F.expr(f"(shard * total + {n_shards} - 1) div {n_shards}")
    return r.select(doc, "size", "text_crc32", "curve", "shard", (F.col("rank") - first).cast("long").alias("slot"))


def digest(sharded: DataFrame, doc: str = "doc_id") -> DataFrame:
    return sharded.select(doc, "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
