"""Suffix-array deduplication: bytes covered by a 400-byte string that also starts anywhere else are removed.

A suffix array of every byte of a large corpus moves a hundred times its size, so the suffixes are sampled twice, both
times so that nothing is lost:

1. Sampled suffixes. Among the first `REACH` positions of a window the leftmost minimum of the hashed 16-byte grams is its anchor;
   it depends on the window's bytes alone, so equal windows have their anchors at the same offset (a difference cover by content
   instead of by residue). About two in `REACH` positions are anchors. Every window of `SPAN` bytes or more holds the `CORE` bytes from
   its anchor on; an anchor whose core occurs nowhere else joins no repeat and is left out. The core is the symbol of an anchor.
2. Order: the difference cover `rank_parts` ranks all suffixes of the symbol sequences: it sorts the triples at positions 1 and 2 modulo 3,
   names them by rank, recurses on the names until they are unique or stand for all symbols that a window of 400 bytes can hold (agreement
   beyond such a window decides about no byte), and merges the suffixes at positions 0 modulo 3 by two further sorts.
3. Adjacent prefixes: neighbours in this order that agree in their first m symbols are a run of depth m. A window of 400 bytes holds
   the cores of its anchor and of the following anchors that its own bytes choose (`reach_of`), so two windows hold equal cores if and only if their anchors
   stand in the same run of that depth. Nothing but runs tells cores apart from here on.
4. The other suffixes: the window starts between the anchors. As in a cover's merge, two of them are compared by the order of the sampled suffixes that they reach first, and by
   their bytes: only inside one run, of the depth that the window holds, are bytes compared. The windows of an anchor, taken together, are its context; contexts that occur
   twice in a block settle their windows at once, and the windows of the others (the ends of repeats) are merged one by one. This
   makes the result exact to the byte.

400 bytes are longer than many passages of 51 words. `n_shared` therefore counts beside the contract's bytes those of `CORE`-byte strings
at anchors that another document has too: every run of `SPAN` (311) bytes in two documents, some 51 words, holds one. Where a document
itself repeats such a string, at least one of its places counts.

Equal texts are one sequence and a text with a copy is removed whole (if it has 400 bytes), as each of its windows starts
elsewhere too. Texts are named by 64 bits; names that two different texts share (SHA-256) are replaced. Windows are compared by 96 bits
of XXH3-128. Equal windows are first matched inside each map task, which sends one witness of them, so a string that a third of all
documents have reaches a reducer once per map task.

Edge cases: null and empty texts have no bytes; texts under 400 bytes are kept; overlapping occurrences count, so a
periodic text removes itself; repeated rows are copies; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import discard, stored, sweep

LENGTH, REACH, GRAM, CORE = 400, 112, 16, 200
#: Windows of so many bytes hold the core of their anchor.
SPAN = REACH + CORE - 1
BLOCK = 1 << 19
#: Places that a map task matches among themselves before it sends them on.
FLUSH = 1 << 20
#: So many names of texts (8 bytes each) may be broadcast to filter a scan; beyond, the join does it alone.
FEW_TEXTS = 2_000_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_LOW = np.uint64(0xFFFFF)


def anchors(raw: bytes, length: int = SPAN, reach: int = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, last): each anchor with the run of window starts that it is the anchor of."""
    total = len(raw) - length + 1
    if total <= 0:
        return (np.zeros(0, np.int64),) * 3
    found = []
    for at in range(0, total, BLOCK):  # offsets fit the low 20 bits of a key
        starts = min(BLOCK, total - at)
        n = starts + reach - 1
        a, b = np.ndarray((n,), "<u8", raw, at, (1,)), np.ndarray((n,), "<u8", raw, at + 8, (1,))
        h = (a * _A) ^ (b * _B)
        h = (h ^ (h >> np.uint64(31))) * _A
        key = np.full(-(-n // reach) * reach, np.uint64(0xFFFFFFFFFFFFFFFF))
        key[:n] = ((h ^ (h >> np.uint64(29))) & ~_LOW) | np.arange(n, dtype=np.uint64)
        rows = key.reshape(-1, reach)
        left, right = np.minimum.accumulate(rows, 1).ravel(), np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
        found.append((np.minimum(right[:starts], left[reach - 1 : reach - 1 + starts]) & _LOW).astype(np.int64) + at)
    of = np.concatenate(found)
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    return of[first], first, np.append(first[1:], total) - 1


# --- difference cover ------------------------------------------------------------------------------------------------


def _numbered(df: DataFrame, order: list[str], flag: str, parts: int, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """The columns `names` of `df` with `place`, the number of rows before in `order`, and `flagged`, the sum of the flag (a count) over them; its stored table."""
    schema = ", ".join(f"{c} {t}" for c, t in df.select(names).dtypes)

    def number(batches):
        from pyspark import TaskContext

        part, at, seen = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            flags = b.column(flag).to_numpy(zero_copy_only=False).astype(np.int64)
            before = seen + np.cumsum(flags) - flags
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(at, at + b.num_rows)), pa.array(before)], [*names, "part", "place", "flagged"])
            at, seen = at + b.num_rows, seen + int(flags.sum())

    local = stored(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(number, schema + ", part int, place long, flagged long"))
    counts = local.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.col(flag).cast("long")).alias("m")).orderBy("part").collect()  # a row a partition
    offsets, rows, flags = [], 0, 0
    for c in counts:
        offsets.append((c.part, rows, flags))
        rows, flags = rows + c.n, flags + c.m
    small = df.sparkSession.createDataFrame(offsets, "part int, rows_before long, flags_before long")
    numbered = local.join(F.broadcast(small), "part").select(*names, (F.col("place") + F.col("rows_before")).alias("place"), (F.col("flagged") + F.col("flags_before")).alias("flagged"))
    return numbered, local


def _named(df: DataFrame, keys: list[str], parts: int) -> tuple[DataFrame, DataFrame, int]:
    """`df` with `place`, the number of rows before in the order of the keys, and `name`, that of the rows with smaller keys; its stored table; its rows.

    Rows of equal keys are divided over tasks by the last two columns of the order, so a name that many places have is in no single task.
    """
    order, names = [*keys, "seq", "i"], [c for c in df.columns if c not in keys]
    kept = [*names, *keys]
    schema = ", ".join(f"{c} {t}" for c, t in df.select(kept).dtypes)

    def number(batches):
        from pyspark import TaskContext

        part, at, start, last = TaskContext.get().partitionId(), 0, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in keys], 1)
            new = np.append(last is None or (x[0] != last).any(), (x[1:] != x[:-1]).any(1))
            place = np.arange(at, at + len(x))
            first = np.maximum.accumulate(np.where(new, place, start))
            inner = np.ones(len(x), bool)
            inner[[0, -1]] = False  # only a partition's first and last keys are asked for again
            ends = [pa.array(x[:, j], mask=inner) for j in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *ends, pa.array(np.full(len(x), part, np.int32)), pa.array(place), pa.array(first)], [*kept, "part", "place", "first"])
            at, start, last = at + len(x), int(first[-1]), x[-1]

    local = stored(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(number, schema + ", part int, place long, first long"))
    key = F.struct(*keys)
    ends = local.groupBy("part").agg(F.count("*").alias("n"), F.min_by(key, "place").alias("low"), F.max_by(key, "place").alias("top"), F.max("first").alias("first")).orderBy("part").collect()  # a row a partition
    small, rows, top, name = [], 0, None, 0
    for e in ends:
        carried = name if e["low"] == top else rows  # the last name of the partition before may go on
        small.append((e["part"], rows, carried))
        name = rows + e["first"] if e["first"] else carried
        rows, top = rows + e["n"], e["top"]
    small = df.sparkSession.createDataFrame(small, "part int, rows_before long, carried long")
    name = F.when(F.col("first") == 0, F.col("carried")).otherwise(F.col("first") + F.col("rows_before")).alias("name")
    return local.join(F.broadcast(small), "part").select(*names, (F.col("place") + F.col("rows_before")).alias("place"), name), local, rows


#: Symbols that a task of the cover sorts at least; symbols of a level that one task ranks to the end, so that the last levels are no jobs.
SHARE, REST = 20_000, 1 << 18


def ranked(seq: np.ndarray, i: np.ndarray, sym: np.ndarray, need: int) -> np.ndarray:
    """How many suffixes come before each, equal ones (in `need` symbols) counting none of one another: by doubling."""
    order = np.lexsort((i, seq))
    seq, rank = seq[order], np.unique(sym[order], return_inverse=True)[1].astype(np.int64)
    reach = 1
    while reach < need:
        ahead = np.full(len(seq), -1, np.int64)
        if reach < len(seq):
            ahead[:-reach] = np.where(seq[reach:] == seq[:-reach], rank[reach:], -1)
        by = np.lexsort((ahead, rank))
        new = np.append(False, (rank[by][1:] != rank[by][:-1]) | (ahead[by][1:] != ahead[by][:-1]))[: len(by)]
        if new.sum() == rank.max(initial=0):  # no name is divided any more
            break
        rank[by] = np.cumsum(new)
        reach *= 2
    out = np.empty(len(seq), np.int64)
    out[order] = np.searchsorted(np.sort(rank), rank)
    return out


def _ranked_rest(symbols: DataFrame) -> DataFrame:
    """The ranks of at most `REST` symbols, in one task."""

    def run(batches):
        t = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if t is not None:
            seq, i, sym, need = (t.column(c).to_numpy() for c in ("seq", "i", "sym", "need"))
            yield pa.RecordBatch.from_arrays([pa.array(seq), pa.array(i), pa.array(ranked(seq, i, sym, int(need.max(initial=0))))], ["seq", "i", "rank"])

    return stored(symbols.select("seq", F.col("i").cast("int"), "sym", "need").coalesce(1).mapInArrow(run, "seq long, i int, rank long"))


def _side_by_side(batches):
    """(seq, i, sym, s1, r, r1, r2) of rows (seq, i, sym, s1, r) in the order of seq, symbols without r and ranks without sym: the sums of the ranks at
    a symbol and at the next two, -1 where there are none. Whole sequences at a time."""
    held: list[pa.RecordBatch] = []

    def joined(t: pa.Table) -> pa.RecordBatch:
        symbol = t.column("sym").is_valid()
        x, y = t.filter(symbol), t.filter(pa.compute.invert(symbol))
        seq, i = (x.column(c).to_numpy() for c in ("seq", "i"))
        order = np.lexsort((i, seq))
        seq, i = seq[order], i[order]
        starts = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
        at = starts[np.searchsorted(seq[starts], y.column("seq").to_numpy())] + y.column("i").to_numpy()
        r, known = np.zeros(len(seq) + 2, np.int64), np.zeros(len(seq) + 2, bool)
        np.add.at(r, at, y.column("r").to_numpy())
        known[at] = True
        r[~known] = -1
        ranks = [r[: len(seq)], *(np.where(np.append(seq, [-1, -1])[k : len(seq) + k] == seq, r[k : len(seq) + k], -1) for k in (1, 2))]
        return pa.RecordBatch.from_arrays([pa.array(seq), pa.array(i), *(pa.array(x.column(c).to_numpy()[order]) for c in ("sym", "s1")), *map(pa.array, ranks)], ["seq", "i", "sym", "s1", "r", "r1", "r2"])

    for b in batches:
        if not b.num_rows:
            continue
        seq = b.column("seq").to_numpy()
        last = int(np.searchsorted(seq, seq[-1]))  # the last sequence may go on
        if last or (held and held[-1].column("seq")[-1].as_py() != seq[-1]):
            if whole := [x for x in (*held, b.slice(0, last)) if x.num_rows]:
                yield joined(pa.Table.from_batches(whole))
            held = []
        held.append(b.slice(last))
    if held:
        yield joined(pa.Table.from_batches(held))


def rank_parts(symbols: DataFrame, size: int | None = None) -> DataFrame:
    """(seq, i, rank): two rows or one for each suffix of the sequences (seq long, i from 0 without gaps, sym long >= 0); their sum is its rank.

    Ranks follow the order of the symbols; the end of a sequence comes before any symbol. Equal suffixes have ranks that ties
    broke. With a column `need`, suffixes that agree in so many symbols count as equal (it falls by one a symbol at most). The recursion goes on until
    names are unique, or stand for as many symbols as are needed, or are those of equal suffixes.
    """
    if "need" not in symbols.columns:
        symbols = symbols.withColumn("need", F.lit(1 << 30))
    size = symbols.count() if size is None else size
    if size <= REST:
        return _ranked_rest(symbols)
    if "s1" not in symbols.columns:
        order, end = W.partitionBy("seq").orderBy("i"), F.lit(-1)
        symbols = symbols.select("seq", "i", "sym", "need", F.coalesce(F.lead("sym").over(order), end).alias("s1"), F.coalesce(F.lead("sym", 2).over(order), end).alias("s2"))
        symbols = table = stored(symbols)
    else:
        table = None  # the caller's
    parts = min(int(symbols.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + size // SHARE)
    sample = symbols.filter("i % 3 <> 0").select("seq", "i", "sym", "s1", "s2", "need")
    names, names_table, size = _named(sample, ["sym", "s1", "s2"], parts)
    # a sequence of the recursion holds a third of the symbols of its kind, so the longest bounds the depth
    if names.filter("name < place and need > 3").limit(1).count() and sample.agg(F.max("i")).first()[0] > 2:
        deeper = names.select((F.col("seq") * 2 + F.col("i") % 3 - 1).alias("seq"), F.expr("i div 3").cast("int").alias("i"), F.col("name").alias("sym"), F.ceil(F.col("need") / 3).cast("int").alias("need"))
        below = rank_parts(deeper, size)
        ranks = below.select(F.expr("seq div 2").alias("seq"), (F.col("i") * 3 + F.col("seq") % 2 + 1).cast("int").alias("i"), F.col("rank").alias("r"))
    else:
        below = None
        ranks = names.select("seq", "i", F.col("name").alias("r"))
    # symbols and ranks of a sequence side by side: one shuffle gives each suffix its own rank and those of the next two
    both = symbols.select("seq", F.col("i").cast("int").alias("i"), "sym", "s1").unionByName(ranks, allowMissingColumns=True)
    own = both.repartition(parts, "seq").sortWithinPartitions("seq").mapInArrow(_side_by_side, "seq long, i int, sym long, s1 long, r long, r1 long, r2 long")
    own = settled_table(own)
    discard(*(x for x in (table, names_table, below) if x is not None))
    zero = (F.col("i") % 3 == 0).alias("zero")
    # a symbol with many equal suffixes is split over tasks by the last two columns; ties may come in any order
    # positions 0 and 1 meet by (symbol, rank of the next); positions 0 and 2 by (two symbols, rank of the one after)
    ones, ones_table = _numbered(own.filter("i % 3 <> 2").select("seq", "i", "sym", "r", "r1", zero), ["sym", "r1", "zero", "seq", "i"], "zero", parts, ["seq", "i", "r", "zero"])
    twos, twos_table = _numbered(own.filter("i % 3 <> 1").select("seq", "i", "sym", "r", "s1", "r2", zero), ["sym", "s1", "r2", "zero", "seq", "i"], "zero", parts, ["seq", "i", "r", "zero"])
    # r counts the sampled suffixes before a sampled one; those of the other kind before it come from the common sort
    first = ones.select("seq", "i", F.when(F.col("zero"), F.col("place")).otherwise(F.col("r") + F.col("flagged")).alias("rank"))
    second = twos.select("seq", "i", F.when(F.col("zero"), F.col("place") - F.col("flagged")).otherwise(F.col("r") + F.col("flagged")).alias("rank"))
    out = settled_table(first.unionByName(second))
    discard(own, ones_table, twos_table)
    return out


def suffix_ranks(symbols: DataFrame) -> DataFrame:
    """(seq, i, rank) of all suffixes of the sequences: see `rank_parts`."""
    return summed(rank_parts(symbols))


def summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy("seq", "i").agg(F.sum("rank").alias("rank"))


# --- repeats ---------------------------------------------------------------------------------------------------------



def settled_table(df: DataFrame) -> DataFrame:
    """A stored table, and the shuffle files that made it go at once: the steps together shuffle several times the input."""
    table = stored(df)
    del df
    sweep(table.sparkSession)
    return table


_HERE, _WITNESS, _DONE = 0, 1, 2
PLACES = {"h": np.uint64, "g": np.uint32, "k": np.int64, "p": np.uint32, "state": np.uint8}
PLACE_SCHEMA = "slice int, " + ", ".join(f"{c} binary" for c in PLACES)


def _distinct(batches):
    """(name, bytes) of the texts that this task meets for the first time."""
    seen: set[int] = set()
    for b in batches:
        for k, t in zip(b.column(0).to_pylist(), b.column(1)):
            if k not in seen:
                if len(seen) > 1 << 20:
                    seen.clear()
                seen.add(k)
                yield k, (t.as_py() or "").encode("utf-8", "surrogatepass")


def _packed(slices: np.ndarray, n: int, columns: list[np.ndarray], names: list[str]):
    """A row for each slice with the bytes of its part of the columns."""
    order = np.argsort(slices, kind="stable")
    bounds = np.searchsorted(slices[order], np.arange(n + 1))
    parts = [(s, order[a:b]) for s, (a, b) in enumerate(zip(bounds, bounds[1:])) if b > a]
    return pa.RecordBatch.from_arrays([pa.array([s for s, _ in parts], pa.int32()), *[pa.array([c[o].tobytes() for _, o in parts], pa.binary()) for c in columns]], ["slice", *names])


def _together(blocks: pa.Table, **kinds) -> list[np.ndarray]:
    return [np.concatenate([np.frombuffer(x.as_py(), t) for x in blocks.column(c)]) for c, t in kinds.items()]


def _slice(x: np.ndarray, n: int) -> np.ndarray:
    return (((x.view(np.uint64) * _A) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _hashed(strings, seeds) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 further bits of each string and its seed."""
    import xxhash

    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, strings, seeds)), np.uint64).reshape(-1, 2)
    return both[:, 1].copy(), (both[:, 0] >> np.uint64(32)).astype(np.uint32)


def _grouped(h, g, k, p, state):
    """The columns in the order of strings, without repeated rows; the first row of each string, and whether a row's string occurs twice:
    at two places, or because a witness says so."""
    order = np.lexsort((p, k, state, g, h))
    h, g, k, p, state = (x[order] for x in (h, g, k, p, state))
    other = np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1]))[: len(h)]
    new = other | np.append(True, (k[1:] != k[:-1]) | (p[1:] != p[:-1]) | (state[1:] != state[:-1]))[: len(h)]
    h, g, k, p, state, other = (x[new] for x in (h, g, k, p, state, other))
    of, first = np.cumsum(other) - 1, np.flatnonzero(other)
    if not len(h):
        return h, g, k, p, state, first, np.zeros(0, bool)
    apart = (k != k[first][of]) | (p != p[first][of]) | (state == _WITNESS)
    return h, g, k, p, state, first, (np.bincount(of, apart, len(first)) > 0)[of]


def _places(held: list[tuple], n: int) -> pa.RecordBatch:
    """Places (h, g, k, p) of a map task in slices: those matched here go to the slices of their texts, with a witness each."""
    columns = [np.concatenate(x) for x in zip(*held)]
    h, g, k, p, state, first, twice = _grouped(*columns, np.zeros(len(columns[0]), np.uint8))
    known = first[twice[first]]
    named = [np.append(np.where(twice, 0, x).astype(x.dtype), x[known]) for x in (h, g)]  # a matched place needs its string no more
    rows = named + [np.append(x, x[known]) for x in (k, p)] + [np.append(np.where(twice, np.uint8(_DONE), np.uint8(_HERE)), np.full(len(known), _WITNESS, np.uint8))]
    return _packed(np.where(rows[4] == _DONE, _slice(rows[2], n), _slice(rows[0], n)), n, rows, list(PLACES))


def _repeated(places: DataFrame, n: int, name: str) -> DataFrame:
    """(k, name array<int>): a row for each text with its sorted places whose string occurs twice."""

    def choose(blocks: pa.Table) -> pa.Table:
        h, g, k, p, state = _together(blocks, **PLACES)
        done, rest = state == _DONE, state != _DONE
        _, _, k1, p1, s1, _, twice = _grouped(*(x[rest] for x in (h, g, k, p, state)))
        hit = twice & (s1 == _HERE)
        k, p = np.append(k[done], k1[hit]), np.append(p[done], p1[hit])
        return pa.Table.from_batches([_packed(_slice(k, n), n, [k, p], ["k", "p"])])

    def gather(blocks: pa.Table) -> pa.Table:
        k, p = _together(blocks, k=np.int64, p=np.uint32)
        order = np.lexsort((p, k))
        k, p = k[order], p[order].astype(np.int32)
        new = np.append(True, (k[1:] != k[:-1]) | (p[1:] != p[:-1]))[: len(k)]  # copies of a text count once
        k, p = k[new], p[new]
        names, first = np.unique(k, return_index=True)
        return pa.table({"k": pa.array(names), name: pa.ListArray.from_arrays(pa.array(np.append(first, len(k)).astype(np.int32)), pa.array(p))})

    chosen = places.groupBy("slice").applyInArrow(choose, "slice int, k binary, p binary")
    return chosen.groupBy("slice").applyInArrow(gather, f"k long, {name} array<int>")


def kept_anchors(texts: DataFrame, n: int) -> DataFrame:
    """(k, at array<int>): the anchors of a text whose core occurs at another anchor too."""

    def emit(batches):
        held, size = [], 0
        for k, raw in _distinct(batches):
            at, _, _ = anchors(raw)
            if len(at):
                h, _ = _hashed((raw[p : p + CORE] for p in at.tolist()), repeat(1))  # 64 bits do: a clash only keeps an anchor too many
                held.append((h, np.zeros(len(at), np.uint32), np.full(len(at), k, np.int64), at.astype(np.uint32)))
                size += len(at)
            if size > FLUSH:
                yield _places(held, n)
                held, size = [], 0
        if held:
            yield _places(held, n)

    return _repeated(texts.mapInArrow(emit, PLACE_SCHEMA), n, "at")


def reach_of(every: np.ndarray, first: np.ndarray, start: np.ndarray, own: np.ndarray, length: int) -> np.ndarray:
    """How many anchors, the own one (an index into `every`) first, have a window of `SPAN` bytes in the window of `length` bytes at each start.

    Equal windows have these anchors at the same offsets, whatever comes before and after them.
    """
    return np.searchsorted(first, start + (length - SPAN), "right") - own


def symbols_of(kept: DataFrame, length: int) -> DataFrame:
    """(seq, i, sym, s1, s2, need, k, p, full, syms): per kept anchor its core's name and the next two, its place in a run of neighbours, the hash of `length` bytes
    and the names of the `need` cores that a window of this anchor can hold."""
    kinds = {"seq": pa.int64(), "i": pa.int32(), "sym": pa.int64(), "s1": pa.int64(), "s2": pa.int64(), "need": pa.int32(), "k": pa.int64(), "p": pa.int32(), "full": pa.int64(), "syms": pa.list_(pa.int64())}

    def run(batches):
        import xxhash
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 34
        for b in batches:
            out: dict[str, list] = {c: [] for c in kinds}
            for k, text, at in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                every, first, _ = anchors(raw)
                mine = np.array(at.as_py(), np.int64)
                own = np.searchsorted(every, mine)
                new = np.append(True, np.diff(own) != 1)
                starts = np.flatnonzero(new)
                of = np.cumsum(new) - 1
                left = np.append(starts[1:], len(mine))[of] - np.arange(len(mine))  # symbols from here to the end of the run
                sym = np.array([xxhash.xxh3_64_intdigest(raw[p : p + CORE], 2) >> 1 for p in mine.tolist()], np.int64)
                need = np.minimum(left, reach_of(every, first, mine, own, length))
                out["seq"].append(number + of)
                number += len(starts)
                out["i"].append(np.arange(len(mine)) - starts[of])
                out["k"].append(np.full(len(mine), k, np.int64))
                out["p"].append(mine)
                out["sym"].append(sym)
                for c, ahead in (("s1", 1), ("s2", 2)):
                    out[c].append(np.where(left > ahead, np.append(sym[ahead:], [-1] * ahead)[: len(sym)], -1))
                out["need"].append(need)
                out["syms"].append(sym[np.repeat(np.arange(len(mine)), need) + np.arange(need.sum()) - np.repeat(np.cumsum(need) - need, need)])
                out["full"].append(np.array([xxhash.xxh3_64_intdigest(raw[p : p + length], 1) >> 1 if p + length <= len(raw) else -1 for p in mine.tolist()], np.int64))
            v = {c: np.concatenate(x) if x else np.zeros(0, np.int64) for c, x in out.items()}
            v["syms"] = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(v["need"])), pa.int32()), pa.array(v["syms"], pa.int64()))
            yield pa.RecordBatch.from_arrays([v[c] if c == "syms" else pa.array(v[c], t) for c, t in kinds.items()], list(kinds))

    return kept.select("k", "text", "at").mapInArrow(run, "seq long, i int, sym long, s1 long, s2 long, need int, k long, p int, full long, syms array<long>")


def _shared_prefix(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, values: np.ndarray) -> np.ndarray:
    """How many names the lists at a and b (starts in `values`, lengths na and nb) have in common before the first that differs."""
    out, going, most = np.zeros(len(a), np.int64), np.arange(len(a)), np.minimum(na, nb)
    for m in range(int(most.max(initial=0))):
        going = going[most[going] > m]
        going = going[values[a[going] + m] == values[b[going] + m]]
        out[going] = m + 1
    return out


def adjacent(symbols: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """(k, anchors array<struct<p, runs, covers, shared>>): neighbours in the order of the suffixes (without ranks, of the lists of names) that agree in m names are a run of depth m, `runs` names an anchor's
    runs of depth 1, 2, and so on by the place of their first row; an anchor covers `length` bytes where a neighbour shares them, and is shared where a neighbour
    of the same first name is of another text."""
    spark = symbols.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["syms" if ranks is None else "rank", "k", "p"]
    rows = symbols if ranks is None else symbols.select("seq", "i", "syms", "full", "k", "p").join(ranks, ["seq", "i"])
    rows = rows.select(*dict.fromkeys([*order, "full", "syms"]))

    def compare(batches):
        from pyspark import TaskContext

        part, at, past, hit = TaskContext.get().partitionId(), 0, None, (False, False)
        begun = np.zeros(0, np.int64)  # where the last row's runs began, by depth
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b] if past is None else [past, b]).combine_chunks()
            full, k, syms = t.column("full").to_numpy(), t.column("k").to_numpy(), t.column("syms").chunk(0)
            start, size, values = syms.offsets.to_numpy()[:-1], np.diff(syms.offsets.to_numpy()), syms.values.to_numpy()
            common = _shared_prefix(start[:-1], size[:-1], start[1:], size[1:], values)
            same, apart = (common > 0) & (full[1:] == full[:-1]) & (full[1:] >= 0), (common > 0) & (k[1:] != k[:-1])
            covers, shared = (np.append(h, x) | np.append(x, False) for h, x in zip(hit, (same, apart)))
            place = np.arange(at, at + len(k))
            bounds = np.append(0, np.cumsum(size))
            runs = np.empty(bounds[-1], np.int64)
            common, depths = np.append(-1, common), []
            for m in range(int(size.max())):
                own = np.where(common > m, 0, place)
                own[0] = begun[m] if m < len(begun) else place[0]
                own = np.maximum.accumulate(own)
                with_m = size > m
                runs[bounds[:-1][with_m] + m] = own[with_m]
                depths.append(own[-1])
            begun = np.array(depths[: size[-1]], np.int64)
            columns = {c: t.column(c) for c in ("k", "p", "syms")} | {"covers": pa.array(covers), "shared": pa.array(shared), "runs": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(runs)), "place": pa.array(place), "part": pa.array(np.full(len(k), part, np.int32))}
            yield from pa.table(columns).slice(0, len(k) - 1).combine_chunks().to_batches()
            past, at, hit, last = t.slice(len(k) - 1).combine_chunks().to_batches()[0], at + len(k) - 1, (bool(covers[-1]), bool(shared[-1])), pa.table(columns).slice(len(k) - 1)
        if past is not None:
            yield from last.combine_chunks().to_batches()

    table = settled_table(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(compare, "k long, p int, syms array<long>, covers boolean, shared boolean, runs array<long>, place long, part int"))
    end = F.struct("k", "syms", "runs")
    ends = table.groupBy("part").agg(F.count("*").alias("n"), F.min_by(end, "place").alias("low"), F.max_by(end, "place").alias("top")).orderBy("part").collect()  # a row a partition
    small, offset, top, begun = [], 0, None, []  # begun: where the runs of the partition's last row began, by depth
    for e in ends:
        m = 0
        while top is not None and m < min(len(top["syms"]), len(e["low"]["syms"])) and top["syms"][m] == e["low"]["syms"][m]:
            m += 1
        apart = m > 0 and top["k"] != e["low"]["k"]
        if small and apart:
            small[-1] = (*small[-1][:-1], True)
        carried = begun[:m]
        small.append((e["part"], offset, carried, e["n"] - 1, apart, False))
        begun = [x + offset if x else (carried[j] if j < m else offset) for j, x in enumerate(e["top"]["runs"])]
        offset, top = offset + e["n"], e["top"]
    small = F.broadcast(spark.createDataFrame(small, "part int, offset long, carried array<long>, last long, low_shared boolean, top_shared boolean"))  # a row a partition
    edge = ((F.col("place") == 0) & F.col("low_shared")) | ((F.col("place") == F.col("last")) & F.col("top_shared"))
    runs = F.expr("transform(runs, (x, m) -> if(x > 0, x + offset, coalesce(get(carried, m), offset)))").alias("runs")
    anchor = F.struct("p", runs, "covers", (F.col("shared") | edge).alias("shared")).alias("anchor")
    found = settled_table(table.join(small, "part").select("k", anchor).groupBy("k").agg(F.array_sort(F.collect_list("anchor")).alias("anchors")))
    discard(table)
    return found


def spans(starts: np.ndarray, length: int) -> np.ndarray:
    """Sorted starts of windows as merged [begin, end) rows."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    new = np.append(True, starts[1:] > starts[:-1] + length)
    first = np.flatnonzero(new)
    return np.stack([starts[first], np.append(starts[first[1:] - 1], starts[-1]) + length], 1)


def contexts(blocks: DataFrame, length: int) -> DataFrame:
    """(block, context, k, lo, hi, open) of (k, text, anchors): per anchor the range of its windows and the name of their bytes; open unless
    the covers include all of them.

    Bytes are named by their hash within the deepest run whose cores they hold. Windows hold some 289 bytes from their anchor on, so blocks are runs
    divided by these. A window with an anchor beyond the runs is nowhere else.
    """
    fields = {"block": pa.int64(), "context": pa.int64(), "k": pa.int64(), "lo": pa.int32(), "hi": pa.int32(), "open": pa.bool_()}
    more = length - REACH + 1

    def run(batches):
        import xxhash

        digest = lambda x, run: xxhash.xxh3_64_intdigest(x, run) - (1 << 63)
        for b in batches:
            out: list[list] = [[] for _ in fields]
            for k, text, found in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                every, first, last = anchors(raw)
                p, covers, runs, of, size = _runs_of(found, every)
                f, z = first[of], np.minimum(last[of], len(raw) - length)
                beyond = np.append(first, len(raw) + length)[of + size]  # the anchor after the runs stands in windows from here less `length - SPAN` on
                z = np.minimum(z, beyond - (length - SPAN) - 1)
                u = spans(p[covers].astype(np.int64), length)
                inside = np.zeros(len(p), bool)
                if len(u):
                    j = np.maximum(np.searchsorted(u[:, 0], f, "right") - 1, 0)
                    inside = (u[j, 0] <= f) & (z + length <= u[j, 1])
                ok = np.flatnonzero(f <= z)
                p, of, f, z, at = p[ok], of[ok], f[ok], z[ok], (np.cumsum(size) - size)[ok] - 1
                low, deep = np.maximum(1, reach_of(every, first, p - (REACH - 1), of, length)), reach_of(every, first, z, of, length)
                divided = np.array([digest(raw[x : x + more], r) for x, r in zip(p.tolist(), runs[at + low].tolist())], np.int64)
                names = np.array([digest(raw[x : y + length], r) for x, y, r in zip(f.tolist(), z.tolist(), runs[at + deep].tolist())], np.int64)
                for column, v in zip(out, (divided, names, np.full(len(ok), k, np.int64), f, z + 1, ~inside[ok])):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v) if v else [], t) for v, t in zip(out, fields.values())], list(fields))

    return blocks.select("k", "text", "anchors").mapInArrow(run, "block long, context long, k long, lo int, hi int, open boolean")


def _runs_of(found: pa.Scalar, every: np.ndarray) -> tuple[np.ndarray, ...]:
    """(p, covers, runs one after another, index of p in `every`, number of runs) of the anchors of a text."""
    p, covers = (found.values.field(c).to_numpy(zero_copy_only=False) for c in ("p", "covers"))
    runs = found.values.field("runs")
    return p.astype(np.int64), covers, runs.flatten().to_numpy(), np.searchsorted(every, p), runs.value_lengths().to_numpy().astype(np.int64)


def resolve(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(k, lo, hi) of the windows that their contexts settle, and of those whose own bytes decide.

    A block takes part where a window of it is open and it has different contexts; of a context the anchors of one text are enough.
    """
    key = ["block", "context"]
    each = settled_table(rows.groupBy(*key).agg(F.count("*").alias("n"), F.max("open").alias("open"), F.min("k").alias("low")))
    asked = each.groupBy("block").agg(F.max("open").alias("open"), F.count("*").alias("m")).filter("open and m > 1").select("block")
    settled = rows.filter("open").join(each.filter("n > 1").select(*key), key).select("k", "lo", "hi")
    merge = rows.join(each.join(asked, "block").select(*key, "low"), key).filter("k = low").select("k", "lo", "hi")
    return settled, merge


def merged(windows: DataFrame, length: int, n: int) -> DataFrame:
    """(k, more): the windows of (k, text, anchors, windows array<struct<lo,hi>>) that occur at another start of the deepest run whose cores a window holds."""
    def emit(batches):
        held, size = [], 0
        for b in batches:
            for k, text, found, w in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3)):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                lo, hi = (w.values.field(c).to_numpy(zero_copy_only=False) for c in ("lo", "hi"))
                at = np.unique(np.concatenate([np.arange(x, y) for x, y in zip(lo, hi)]))
                every, first, last = anchors(raw)
                p, _, runs, _, count = _runs_of(found, every)
                of = np.searchsorted(last, at)
                deep, start = reach_of(every, first, at, of, length), (np.cumsum(count) - count)[np.searchsorted(p, every[of])]
                held.append((*_hashed((raw[x : x + length] for x in at.tolist()), runs[start + deep - 1].tolist()), np.full(len(at), k, np.int64), at.astype(np.uint32)))
                size += len(at)
                if size > FLUSH:
                    yield _places(held, n)
                    held, size = [], 0
        if held:
            yield _places(held, n)

    return _repeated(windows.mapInArrow(emit, PLACE_SCHEMA), n, "more")


def named_texts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`rows` with k, the name of the text, and (k, copies) of the names that several rows have.

    A name is a 64-bit hash; where two texts share it, both are named by their SHA-256. Such names are few: n rows have about
    n * n / 2 ** 65, some hundreds at 1e11 rows.
    """
    rows = rows.withColumn("k", F.xxhash64("text"))
    names = settled_table(rows.groupBy("k").agg(F.count("*").alias("n"), F.min(F.sha2("text", 256)).alias("low"), F.max(F.sha2("text", 256)).alias("high")).filter("n > 1"))
    shared = names.filter("low <> high").select("k", F.lit(True).alias("shared"))
    if shared.limit(1).count() == 0:
        return rows, names.select("k", F.col("n").alias("copies"))
    other = F.conv(F.substring(F.sha2("text", 256), 1, 15), 16, 10).cast("long")
    rows = rows.join(F.broadcast(shared), "k", "left").withColumn("k", F.when(F.col("shared"), other).otherwise(F.col("k"))).drop("shared")
    return rows, rows.groupBy("k").agg(F.count("*").alias("copies")).filter("copies > 1")


def remove_repeats(docs: DataFrame, length: int = LENGTH, order: str = "suffix", n_slices: int | None = None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared of every row."""
    if length < SPAN:
        raise ValueError(f"length is at least {SPAN}")
    n = n_slices or 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, copies = named_texts(docs.select(F.col(doc).alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")))
    texts = rows.filter(F.octet_length("text") >= SPAN).select("k", "text")
    at = settled_table(kept_anchors(texts, n))
    # the texts with kept anchors, each once; where their names are few, the others are left out before any shuffle
    few = at.count() <= FEW_TEXTS
    wanted = texts.join(F.broadcast(at.select("k")), "k", "left_semi") if few else texts
    held = settled_table(wanted.groupBy("k").agg(F.first("text").alias("text")).join(at, "k"))
    discard(at)
    names = symbols_of(held, length)
    symbols = settled_table(names if order == "suffix" else names.select("k", "p", "full", "syms"))
    parts = rank_parts(symbols.select("seq", "i", "sym", "s1", "s2", "need")) if order == "suffix" else None
    blocks = adjacent(symbols, summed(parts) if parts else None)
    discard(symbols, *([parts] if parts else []))
    around = settled_table(contexts(held.join(blocks, "k").select("k", "text", "anchors"), length))
    settled, merge = resolve(around)
    todo = merge.groupBy("k").agg(F.collect_list(F.struct("lo", "hi")).alias("windows"))
    more = merged(held.select("k", "text").join(blocks, "k").join(todo, "k").select("k", "text", "anchors", "windows"), length, n)
    settled = settled.groupBy("k").agg(F.collect_list(F.struct("lo", "hi")).alias("settled"))
    places = lambda c: F.expr(f"transform(filter(anchors, x -> x.{c}), x -> x.p)").alias(c)
    covers = blocks.select("k", places("covers"), places("shared")).filter("size(covers) > 0 or size(shared) > 0")
    found = settled_table(covers.join(more, "k", "full_outer").join(settled, "k", "full_outer"))
    discard(held, blocks, around)
    joined = rows.join(found, "k", "left").join(copies, "k", "left").select("doc", "text", "covers", "more", "shared", "settled", F.col("copies").isNotNull().alias("copied"))
    kind = dict(docs.dtypes)[doc]

    def finish(batches):
        for b in batches:
            out = []
            for text, covers, more, shared, runs, copied in zip(*b.columns[1:]):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                copied = copied.as_py()
                u = spans(np.array(shared.as_py() or [], np.int64), CORE)
                n_shared = len(raw) if copied and len(raw) >= SPAN else int((u[:, 1] - u[:, 0]).sum())
                if copied and len(raw) >= length:
                    out.append((len(raw), len(raw), 1, hashlib.sha256(b"").hexdigest(), n_shared))
                    continue
                starts = [np.array(x.as_py() or [], np.int64) for x in (covers, more)] + [np.arange(r["lo"], r["hi"]) for r in runs.as_py() or []]
                u = spans(np.unique(np.concatenate(starts)), length)
                left, done = hashlib.sha256(), 0
                for a, z in u.tolist():
                    left.update(raw[done:a])
                    done = z
                left.update(raw[done:])
                out.append((len(raw), int((u[:, 1] - u[:, 0]).sum()), len(u), left.hexdigest(), n_shared))
            c = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.int64()) for x in c[:3]], pa.array(c[3], pa.string()), pa.array(c[4], pa.int64())], ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared"])

    return joined.mapInArrow(finish, f"doc {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long").withColumnRenamed("doc", doc)
