"""Language model scoring with a log-frequency Bloom filter.

Tokens are lowered runs of non-blank bytes plus one end per text, named by 64-bit hashes. The model is a bigram model
with Witten-Bell weights over a unigram model; its counts live in one Bloom filter of quantised counts. An n-gram whose
count has level q is entered with the suffixes 1..q, so a count is read by probing 1, 2, ... until a probe fails.

    P(w | h) = (c(h w) + u(h) P(w)) / a(h),   a(h) = c(h) + T(h),   u(h) = T(h)

Every counted bigram is entered, those seen once with level 1, which stands for exactly one. The entries of a history are
a(h) and the ratio a(h) / u(h); both are two at least, so their levels count from there, and the ratio's lowest needs no entry.

Counting, over all training rows: a map counts n-grams of its partition and packs them by hash slice into binary blocks;
one task per slice merges sorted blocks, so a frequent n-gram reaches a reducer once per map task. The slice of a key picks
its segment of the filter, and the same task sets the segment's bits: nothing else is merged. Segments are sized by their
entries; all of them are broadcast together up to `MAX_FILTER` bytes, and beyond that in several passes of whole segments
over the texts, each adding the levels it knows. A pass ends in a table and its broadcast is destroyed before the next one, so that a
worker holds one part of the filter at a time. A slice stands for `SLICE` bytes of text, so slices grow in number and not in size; the
passes grow in number with the corpus.

Histories have their token's whole 64 bits. The bigrams of a history share its slice, but those of hot histories (tokens of more than 1 in
`HOT` in a share of the texts, found beforehand; at most as many) are dealt by their own hash; the sums of a hot history over the
slices come to the driver, a row each, and travel beside the filter. Which histories count as hot changes no score but by false hits.

The exact unigram base score takes the counts of the `HEAD` most frequent tokens from a broadcast table (bounded) and joins
the occurrences of all others by slice with the exact counts. All data between tasks are binary blocks of numpy arrays.

Edge cases: null and empty texts are just an end; null ids are training rows; repeated rows count and score each; without
training rows N and V are 0, the base of a token is log10(0.5 / 0.5) = 0 and the model says the same.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, stored

HEAD, MAX_FILTER, BITS_PER_ENTRY, PROBES = 1 << 20, 192 << 20, 12, 5
#: Tokens that a map task counts at once, some 100 bytes of memory each.
FLUSH = 1 << 20
#: Bytes of text for which there is a slice; its reducer holds the distinct n-grams of as much text, some 50 bytes each.
SLICE = 32 << 20
#: Quantisation steps: counts, a(h), and the ratio a(h) / u(h), which is near one for most histories.
STEP, MIDDLE, FINE = 2.0, 2.0**0.5, 2.0**0.25
#: Texts that a task scores at once.
TEXTS = 1024
#: A history with more than one in so many tokens is spread over slices; so there are at most as many.
HOT = 4096
HIGH, LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
END, BEGIN = np.uint64(0x6A09E667F3BCC909), np.uint64(0xBB67AE8584CAA73B)
_MULT = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = base
        out = np.cumprod(out, dtype=np.uint64)
    return out


_STEP = 1 << 16
_B = 0x9E3779B97F4A7C55
_B_INVERSE = pow(_B, -1, 1 << 64)


def token_hashes(raw: bytes) -> np.ndarray:
    """The hashes of a text's tokens, without its end."""
    if not raw:
        return np.zeros(0, np.uint64)
    b = np.frombuffer(raw.translate(_LOWER), np.uint8)
    word = np.empty(len(b) + 2, bool)
    word[0] = word[-1] = False
    word[1:-1] = ~_BLANK[b]
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTES[b] * _power(len(b)), out=total[1:], dtype=np.uint64)
    sums = (total[ends] - total[starts]) * _inverse(len(b))[starts]
    return mix(sums ^ ((ends - starts).astype(np.uint64) * _MULT))


_POWER, _INVERSE = _powers(_B, 1), _powers(_B_INVERSE, 1)


def _power(n: int) -> np.ndarray:
    global _POWER
    if len(_POWER) < n:
        _POWER = _powers(_B, max(n, _STEP))
    return _POWER[:n]


def _inverse(n: int) -> np.ndarray:
    global _INVERSE
    if len(_INVERSE) < n:
        _INVERSE = _powers(_B_INVERSE, max(n, _STEP))
    return _INVERSE[:n]


def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all tokens with their ends, and how many each text has."""
    each = [token_hashes((t or "").encode("utf-8", "surrogatepass")) for t in texts]
    sizes = np.array([len(x) + 1 for x in each], np.int64)
    return np.concatenate([y for x in each for y in (x, [END])]).astype(np.uint64) if each else np.zeros(0, np.uint64), sizes


def histories(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(sizes) - sizes] = BEGIN
    return before


def bigrams(tokens: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Keys whose upper half is the history's, which puts a history's bigrams into its slice; the lower half is of both tokens."""
    low = mix(before * np.uint64(31) + tokens) >> np.uint64(32)
    return (before & HIGH) | low


def among(x: np.ndarray, few: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each of x is among the sorted few, where)."""
    place = np.minimum(np.searchsorted(few, x), max(0, len(few) - 1))
    return (few[place] == x if len(few) else np.zeros(len(x), bool)), place


def bigram_slices(keys: np.ndarray, before: np.ndarray, hot: np.ndarray, n: int) -> np.ndarray:
    """The slice of a bigram: its history's, or for a hot history one by its own hash."""
    return np.where(among(before, hot)[0], slices_of(mix(keys), n), slices_of(keys, n)).astype(np.int64)


def slices_of(keys: np.ndarray, n: int) -> np.ndarray:
    """By the upper half only: a history, its bigrams and its entries share a slice."""
    return ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def counted(keys: list[np.ndarray], counts: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys with their counts."""
    k = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    if counts is None:
        return np.unique(k, return_counts=True)
    order = np.argsort(k, kind="stable")
    k, c = k[order], np.concatenate(counts)[order] if counts else np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def counted_pairs(keys: list[np.ndarray], lows: list[np.ndarray], counts: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct sorted bigram keys, the lower halves of their histories, and their counts."""
    k, low = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((keys, np.uint64), (lows, np.uint32)))
    order = np.argsort(k, kind="stable")
    k, low = k[order], low[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    c = np.diff(np.append(first, len(k))) if counts is None else np.add.reduceat(np.concatenate(counts)[order], first) if len(k) else np.zeros(0, np.int64)
    return k[first], low[first], c


def level(c: np.ndarray, step: float) -> np.ndarray:
    """1 + floor(log_step c) for c >= 1."""
    return 1 + np.floor(np.log(np.maximum(c, 1)) / math.log(step) + 1e-9).astype(np.int64)


def value(q: np.ndarray, step: float) -> np.ndarray:
    """The geometric middle of a level; level 1 of counts by factors of two is 1 to 2, taken as 1.2 where most are 1."""
    return step ** (q - 1.0) * (step**0.5 if step < 2 else 1.2)


KINDS = {"unigram": 0x1B873593, "bigram": 0xCC9E2D51, "a": 0x85EBCA6B, "ratio": 0xC2B2AE35}


def salt(kind: str, q: int) -> np.uint64:
    return np.uint64(KINDS[kind] * (q + 1) * 0x9E3779B97F4A7C15 % (1 << 64))


class Segment:
    """A plain Bloom filter over (key, kind, level), as it is built; `Filter` probes it."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def positions(keys: np.ndarray, kind: str, q: int, size: int):
        h = mix(keys + salt(kind, q))
        a, b = h >> np.uint64(32), (h & np.uint64(0xFFFFFFFF)) | np.uint64(1)
        for k in range(PROBES):
            yield (((a + np.uint64(k) * b) & np.uint64(0xFFFFFFFF)) * np.uint64(size)) >> np.uint64(32)

    @classmethod
    def of(cls, entries: list[tuple[np.ndarray, str, np.ndarray]]) -> "Segment":
        """From (keys, kind, levels)."""
        n = int(sum(q.sum() for _, _, q in entries))
        size = max(64, (n * BITS_PER_ENTRY + 63) // 64 * 64)
        on = np.zeros(size, bool)
        for keys, kind, q in entries:
            for j in range(1, int(q.max(initial=0)) + 1):
                for p in cls.positions(keys[q >= j], kind, j, size):
                    on[p] = True
        return cls(np.packbits(on))


class Filter:
    """Segments laid out one after another, so that one vector operation probes all slices."""

    def __init__(self, segments: dict[int, bytes], n: int):
        self._lay({s: len(raw) for s, raw in segments.items()}, b"".join(segments[s] for s in sorted(segments)), n)

    @classmethod
    def laid(cls, sizes: dict[int, int], raw: bytes, n: int) -> "Filter":
        """Over segments of these sizes that lie end to end already; `raw` isn't copied."""
        out = cls.__new__(cls)
        out._lay(sizes, raw, n)
        return out

    def _lay(self, lengths: dict[int, int], raw: bytes, n: int) -> None:
        sizes = np.zeros(n, np.uint64)
        for s, size in lengths.items():
            sizes[s] = size * 8
        self.size, self.n = sizes, n
        self.start = np.cumsum(sizes) - sizes
        self.bits = np.frombuffer(raw, np.uint8)

    def levels(self, keys: np.ndarray, kind: str, slices: np.ndarray | None = None) -> np.ndarray:
        """Probes 1, 2, ... until each key fails."""
        s = slices_of(keys, self.n) if slices is None else slices
        q, left, j = np.zeros(len(keys), np.uint8), np.flatnonzero(self.size[s] > 0), 1
        keys, size, start = keys[left], self.size[s[left]], self.start[s[left]]
        low = np.uint64(0xFFFFFFFF)
        while len(left) and j < 250:
            h = mix(keys + salt(kind, j))
            b = (h & low) | np.uint64(1)
            a = h >> np.uint64(32)
            on = None  # those that no probe has missed yet
            for _ in range(PROBES):
                at = a if on is None else a[on]
                p = (start if on is None else start[on]) + (((at & low) * (size if on is None else size[on])) >> np.uint64(32))
                hit = (self.bits[p >> np.uint64(3)] << (p & np.uint64(7)).astype(np.uint8)) & np.uint8(128) != 0
                on = np.flatnonzero(hit) if on is None else on[hit]
                a += b
            left, keys, size, start = left[on], keys[on], size[on], start[on]
            q[left] = j
            j += 1
        return q


def is_held_out(doc: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc).cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))


def hot_histories(texts: DataFrame, share: int = 64) -> np.ndarray:
    """Sorted tokens of more than 1 in `HOT` in one in `share` of the texts (all of a small table), and the begin. They decide where bigrams are dealt, not what is counted."""
    some = texts.toDF("text").filter(F.pmod(F.xxhash64("text"), F.lit(share)) == 0)

    def run(batches):
        held, n = [], 0
        for b in batches:
            t, _ = tokens_of(b.column(0).to_pylist())
            k, c = np.unique(t, return_counts=True)
            n += len(t)
            often = c * (2 * HOT) > len(t)  # a token of more than 1 in HOT is often in the larger part of them
            held.append((k[often], c[often]))
        k, c = counted([x for x, _ in held], [x for _, x in held])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(k.view(np.int64), 0)), pa.array(np.append(c, 0)), pa.array(np.append(np.zeros(len(k), np.int64), n))], ["k", "c", "n"])

    found = some.mapInArrow(run, "k long, c long, n long").groupBy("k").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
    n = found.agg(F.sum("n")).first()[0] or 0
    hot = [r["k"] for r in found.filter(F.col("c") * HOT > F.lit(n)).select("k").collect()] if n else []  # HOT rows at most
    return np.unique(np.append(np.array(hot, np.int64).view(np.uint64), BEGIN))


BLOCK = "kind int, slice int, keys binary, lows binary, counts binary"


def count_ngrams(texts: DataFrame, n_slices: int, hot: np.ndarray | None = None) -> DataFrame:
    """Blocks (kind 1: unigrams, 2: bigrams with the lower halves of their histories) of the counts of each map task; `texts` has one column."""
    hot = np.array([BEGIN]) if hot is None else hot

    def block(kind, slices, k, low, c):
        order = np.argsort(slices, kind="stable")
        k, c = k[order], c[order].astype(np.uint32)
        low = low[order] if low is not None else None
        bounds = np.searchsorted(slices[order], np.arange(n_slices + 1))
        rows = [(kind, s, k[a:b].tobytes(), low[a:b].tobytes() if low is not None else None, c[a:b].tobytes()) for s, (a, b) in enumerate(zip(bounds, bounds[1:])) if b > a]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["kind", "slice", "keys", "lows", "counts"])

    def flush(held: dict[int, list[np.ndarray]]):
        k, c = counted(held.pop(1))
        yield block(1, slices_of(k, n_slices).astype(np.int64), k, None, c)
        k, low, c = counted_pairs(held.pop(2), held.pop(3))  # the uncounted keys go before the blocks are made
        yield block(2, bigram_slices(k, (k & HIGH) | low, hot, n_slices), k, low, c)

    def run(batches):
        held, n = {1: [], 2: [], 3: []}, 0
        for b in batches:
            for at in range(0, b.num_rows, 256):
                t, sizes = tokens_of(b.column(0).slice(at, 256).to_pylist())
                before = histories(t, sizes)
                held[1].append(t), held[2].append(bigrams(t, before)), held[3].append((before & LOW).astype(np.uint32))
                n += len(t)
                if n > FLUSH:
                    yield from flush(held)
                    held, n = {1: [], 2: [], 3: []}, 0
        if n:
            yield from flush(held)

    return texts.mapInArrow(run, BLOCK)


def _blocks(frame: pd.DataFrame, kind: int) -> list[list[np.ndarray]]:
    part = frame[frame["kind"] == kind]
    return [[np.frombuffer(x, t) for x in part[c]] for c, t in (("keys", np.uint64), ("lows", np.uint32), ("counts", np.uint32)) if kind == 2 or c != "lows"]


def history_levels(a: np.ndarray, types: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Levels of a(h), and of a(h) / T(h) less its lowest."""
    return level(a / 2, MIDDLE), level(a / types / 2, FINE) - 1


MODEL = "slice int, keys binary, counts binary, n long, v long, segment binary, histogram array<long>, hot array<struct<k: long, a: long, types: long>>"


def build(blocks: DataFrame, hot: np.ndarray | None = None) -> DataFrame:
    """One row a slice: exact unigram counts (keys, counts), totals, the slice's filter segment, and its part of the hot histories."""
    hot = np.array([BEGIN]) if hot is None else hot

    def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        k, c = _blocks(frame, 1)
        words, count = counted(k, [x.astype(np.int64) for x in c])
        k, low, c = _blocks(frame, 2)
        pairs, low, times = counted_pairs(k, low, [x.astype(np.int64) for x in c])
        entries, shared = [(words, "unigram", level(count, STEP))], []
        if len(pairs):
            entries.append((pairs, "bigram", level(times, STEP)))
            names, of = np.unique((pairs & HIGH) | low, return_inverse=True)
            types = np.bincount(of)
            a = np.bincount(of, times).astype(np.int64) + types
            spread, _ = among(names, hot)
            shared = [{"k": int(x), "a": int(y), "types": int(z)} for x, y, z in zip(names[spread].view(np.int64), a[spread], types[spread])]
            qa, qr = history_levels(a[~spread], types[~spread])
            entries += [(names[~spread], "a", qa), (names[~spread], "ratio", qr)]
        return pd.DataFrame({"slice": [key[0]], "keys": [words.tobytes()], "counts": [count.astype(np.int64).tobytes()], "n": [int(count.sum())], "v": [len(words)], "segment": [Segment.of(entries).bits.tobytes()], "histogram": [np.bincount(level(count, FINE), minlength=250).tolist()], "hot": [shared]})

    return blocks.groupBy("slice").applyInPandas(merge, MODEL)


def hot_table(model: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted hot histories, level of a, level of the ratio) from the sums over all slices: `HOT` rows at most."""
    sums = model.select(F.explode("hot").alias("h")).groupBy("h.k").agg(F.sum("h.a").alias("a"), F.sum("h.types").alias("types")).collect()
    k = np.array([r["k"] for r in sums], np.int64).view(np.uint64)
    order = np.argsort(k)
    qa, qr = history_levels(np.array([r["a"] for r in sums], np.float64)[order], np.array([r["types"] for r in sums], np.float64)[order])
    return k[order], qa, qr


def head_table(model: DataFrame, head: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens with their counts: those of the levels that fit into `head` entries."""
    sums = model.select(F.posexplode("histogram").alias("q", "n")).groupBy("q").agg(F.sum("n").alias("n")).collect()  # 250 rows
    left, least = head, 250
    for q, n in sorted(((r.q, r.n) for r in sums), reverse=True):
        if n > left:
            break
        left, least = left - n, q

    def pick(batches):
        for b in batches:
            for k, c in zip(b.column(0), b.column(1)):
                k, c = np.frombuffer(k.as_py(), np.uint64), np.frombuffer(c.as_py(), np.int64)
                ok = level(c, FINE) >= least
                yield pa.RecordBatch.from_arrays([pa.array([k[ok].tobytes()], pa.binary()), pa.array([c[ok].tobytes()], pa.binary())], ["k", "c"])

    rows = model.select("keys", "counts").mapInArrow(pick, "k binary, c binary").collect()  # `head` entries at most
    keys, counts = np.concatenate([np.frombuffer(r.k, np.uint64) for r in rows] or [np.zeros(0, np.uint64)]), np.concatenate([np.frombuffer(r.c, np.int64) for r in rows] or [np.zeros(0, np.int64)])
    order = np.argsort(keys)
    return keys[order], counts[order]


def passes(sizes: dict[int, int], most: int) -> list[list[int]]:
    """Slices in groups of at most `most` bytes of filter; a larger segment is a pass of its own."""
    out: list[list[int]] = [[]]
    room = most
    for s, size in sorted(sizes.items()):
        if size > room and out[-1]:
            out.append([])
            room = most
        out[-1].append(s)
        room -= size
    return out


def score(docs: DataFrame, n_slices: int | None = None, head: int = HEAD, max_filter: int = MAX_FILTER, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    if n_slices is None:
        raw = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text).cast("string"))), F.lit(0))).first()[0]
        n_slices = max(16, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(raw / SLICE))
    rows = docs.select(F.col(doc).alias("doc"), is_held_out(doc).alias("held"), F.col(text).cast("string").alias("text"))
    training = rows.filter("not held").select("text")
    hot = hot_histories(training)
    model = cut(build(count_ngrams(training, n_slices, hot), hot))
    facts = model.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    total, kinds = int(facts.n), int(facts.v)
    sizes = {r["slice"]: r["size"] for r in model.select("slice", F.octet_length("segment").alias("size")).collect()}  # a row a slice
    groups = passes(sizes, max_filter)
    keys, counts = head_table(model, head)
    table = spark.sparkContext.broadcast((keys, counts, *hot_table(model), hot))
    floor = total + 0.5 * (kinds + 1)
    kind = dict(docs.dtypes)[doc]

    def segments(group: list[int]):
        """The sizes of a pass's segments, and a broadcast of them end to end: the driver and a worker hold them once.

        They come to the driver partition by partition, max_filter bytes at most.
        """
        lengths = {s: sizes[s] for s in sorted(group)}
        start = dict(zip(lengths, itertools.accumulate(lengths.values(), initial=0)))
        raw = bytearray(sum(lengths.values()))
        if group:
            for s, segment in model.filter(F.col("slice").isin(group)).select("slice", "segment").toLocalIterator():
                raw[start[s] : start[s] + lengths[s]] = segment
        return lengths, spark.sparkContext.broadcast({"segments": raw})

    def known_levels(f: Filter, t: np.ndarray, h: np.ndarray):
        _, _, spread, spread_a, spread_ratio, dealt = table.value
        words, word = np.unique(t, return_inverse=True)  # frequent ones have many levels to probe: once each
        names, name = np.unique(h, return_inverse=True)
        one, a, ratio = f.levels(words, "unigram")[word], f.levels(names, "a"), f.levels(names, "ratio")
        known, place = among(names, spread)
        a[known], ratio[known] = spread_a[place[known]], spread_ratio[place[known]]
        a, ratio = a[name], ratio[name]
        # a bigram has a history, in the same segment or a hot one, and a known word, maybe in another pass
        two, may = np.zeros(len(t), np.uint8), np.flatnonzero((a > 0) & ((one > 0) | (f.size[slices_of(t, f.n)] == 0)))
        keys = bigrams(t[may], h[may])
        two[may] = f.levels(keys, "bigram", bigram_slices(keys, h[may], dealt, f.n))
        return one, two, a, ratio

    def adder(lengths, shared):
        """A pass before the last: levels found in its segments are added to those that came along."""

        def run(batches):
            f = Filter.laid(lengths, shared.value["segments"], n_slices)
            for b in batches:
                texts, old = b.column(b.schema.get_field_index("text")), b.column(b.schema.get_field_index("levels"))
                new = []
                for at in range(0, b.num_rows, TEXTS):
                    t, sizes = tokens_of(texts.slice(at, TEXTS).to_pylist())
                    q, end = np.stack(known_levels(f, t, histories(t, sizes))), np.cumsum(sizes)
                    if old.null_count == 0:
                        q = np.maximum(q, np.concatenate([np.frombuffer(x.as_py(), np.uint8).reshape(4, -1) for x in old.slice(at, TEXTS)], 1))
                    new += [q[:, z - n : z].tobytes() for z, n in zip(end, sizes)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(new, pa.binary())], b.schema.names)

        return run

    def scorer(lengths, shared):
        def run(batches):
            f = Filter.laid(lengths, shared.value["segments"], n_slices)
            keys, counts = table.value[:2]
            for b in batches:
                for at in range(0, b.num_rows, TEXTS):
                    yield from rated(b.slice(at, TEXTS), f, keys, counts)

        return run

    def rated(b, f, keys, counts):
        names = b.schema.names
        uid = b.column(names.index("uid")).to_numpy(zero_copy_only=False)
        t, sizes = tokens_of(b.column(names.index("text")).to_pylist())
        starts = np.cumsum(sizes) - sizes
        h = histories(t, sizes)
        q = known_levels(f, t, h)
        if "levels" in names:
            old = [np.frombuffer(x.as_py(), np.uint8).reshape(4, -1) for x in b.column(names.index("levels"))]
            q = tuple(np.maximum(x, y) for x, y in zip(q, np.concatenate(old, 1)))
        one, two, qa, qr = (x.astype(np.float64) for x in q)
        single = (np.where(one > 0, value(one, STEP), 0.0) + 0.5) / floor
        two = np.where(one > 0, two, 0.0)
        pair = np.where(two > 1, value(two, STEP), np.minimum(two, 1.0))
        known = qa > 0
        # a quantised a is no less than the evidence at hand
        a = np.where(known, np.maximum(2 * value(qa, MIDDLE), pair), 1.0)
        u = np.where(known, a / (2 * value(qr + 1, FINE)), 1.0)
        p = np.where(known, (np.minimum(pair, a) + u * single) / (a + np.maximum(0, u + np.minimum(pair, a) - a)), single)
        model_score = np.add.reduceat(np.log10(np.minimum(p, 1.0)), starts)
        words, word = np.unique(t, return_inverse=True)
        place = np.minimum(np.searchsorted(keys, words), max(0, len(keys) - 1))[word]
        inside = keys[place] == t if len(keys) else np.zeros(len(t), bool)
        base = np.where(inside, np.log10((counts[place] if len(keys) else 0) + 0.5) - math.log10(floor), 0.0)
        yield pa.RecordBatch.from_arrays(
            [b.column(names.index("doc")), b.column(names.index("held")), pa.array(uid), pa.array(sizes), pa.array(np.add.reduceat(inside.astype(np.int64), starts)), pa.array(np.add.reduceat(base, starts)), pa.array(model_score), pa.nulls(len(uid), pa.int32()), pa.nulls(len(uid), pa.binary()), pa.nulls(len(uid), pa.binary())],
            ["doc", "held", "uid", "n_tokens", "n_known", "base", "score", "slice", "keys", "uids"],
        )
        rest = np.flatnonzero(~inside)
        if len(rest):
            owner = np.repeat(uid, sizes)[rest]
            s = slices_of(t[rest], n_slices).astype(np.int64)
            order = np.argsort(s, kind="stable")
            bounds = np.searchsorted(s[order], np.arange(n_slices + 1))
            parts = [(i, order[a:z]) for i, (a, z) in enumerate(zip(bounds, bounds[1:])) if z > a]
            m = len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(m, b.column(names.index("doc")).type), pa.nulls(m, pa.bool_()), *[pa.nulls(m, x) for x in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], pa.array([i for i, _ in parts], pa.int32()), pa.array([t[rest][o].tobytes() for _, o in parts], pa.binary()), pa.array([owner[o].tobytes() for _, o in parts], pa.binary())],
                ["doc", "held", "uid", "n_tokens", "n_known", "base", "score", "slice", "keys", "uids"],
            )

    work = rows.withColumn("uid", F.monotonically_increasing_id())
    if len(groups) > 1:
        work = work.withColumn("levels", F.lit(None).cast("binary"))
        for g in groups[:-1]:
            (lengths, shared), before = segments(g), work
            work = stored(before.mapInArrow(adder(lengths, shared), f"doc {kind}, held boolean, text string, uid long, levels binary"))
            shared.destroy()
            discard(before)
    scored = cut(work.mapInArrow(scorer(*segments(groups[-1])), f"doc {kind}, held boolean, uid long, n_tokens long, n_known long, base double, score double, slice int, keys binary, uids binary"))

    def look_up(key: tuple, rest: pd.DataFrame, exact: pd.DataFrame) -> pd.DataFrame:
        k = np.frombuffer(exact["keys"].iloc[0], np.uint64) if len(exact) else np.zeros(0, np.uint64)
        c = np.frombuffer(exact["counts"].iloc[0], np.int64) if len(exact) else np.zeros(0, np.int64)
        out = []
        for keys, uids in zip(rest["keys"], rest["uids"]):
            t, u = np.frombuffer(keys, np.uint64), np.frombuffer(uids, np.int64)
            place = np.minimum(np.searchsorted(k, t), max(0, len(k) - 1))
            n = np.where(k[place] == t, c[place], 0) if len(k) else np.zeros(len(t), np.int64)
            who, inverse = np.unique(u, return_inverse=True)
            out.append(pd.DataFrame({"uid": who, "more": np.bincount(inverse, np.log10(n + 0.5) - math.log10(floor)), "found": np.bincount(inverse, n > 0).astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"uid": np.zeros(0, np.int64), "more": np.zeros(0), "found": np.zeros(0, np.int64)})

    tail = scored.filter("slice is not null").select("slice", "keys", "uids")
    rest = tail.groupBy("slice").cogroup(model.select("slice", "keys", "counts").groupBy("slice")).applyInPandas(look_up, "uid long, more double, found long")
    rest = rest.groupBy("uid").agg(F.sum("more").alias("more"), F.sum("found").alias("found"))
    out = scored.filter("slice is null").join(rest, "uid", "left")
    return out.select(
        F.col("doc").alias(doc), F.col("held").alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )
