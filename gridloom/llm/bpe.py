"""Byte-level BPE encoding and decoding with padded numpy matrices.

A text is split by the tokenizer's pattern; each piece is encoded on its own. Pieces that a worker has not met lately are
bucketed by length into padded matrices of token ids. Every round finds in all rows of a matrix the leftmost pair of
minimum rank, merges it, closes the gap, and looks up the two new pairs in an open-addressing hash table of pairs; rows
without a mergeable pair leave the matrix. Pieces longer than the widest bucket are merged in the same order
with a heap, which stays near-linear where a matrix would be quadratic.

The work is one map over Arrow batches: no shuffle. Memory is bounded by the cache (`CACHE` pieces), by groups of about
`GROUP` characters and, for very long texts, by blocks of pieces. Null texts are empty and have no tokens.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CACHE, GROUP, LONG_TEXT, WIDEST = 200_000, 1 << 20, 1 << 20, 256
NONE = np.iinfo(np.int64).max


class PairTable:
    """Open addressing over keys left * 2**32 + right."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(8, int(len(keys) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int64)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[todo[free]]  # one of those that meet in a slot stays
            put = self.keys[slot] == keys[todo]
            self.values[slot[put]] = values[todo[put]]
            todo, slot = todo[~put], (slot[~put] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where there is none or a side is padding (-1)."""
        keys = (left << 32) | (right & 0xFFFFFFFF)
        out, slot = np.full(keys.shape, NONE, np.int64), self._slot(keys)
        found = self.keys[slot]
        hit = found == keys
        out[hit] = self.values[slot[hit]]
        rest = np.flatnonzero(~hit & (found != -1))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = self.values[slot[rest[hit]]]
            rest = rest[~hit & (found != -1)]
        out[(left < 0) | (right < 0)] = NONE
        return out


class Codec:
    """Ranks of a vocabulary with its pair table; `pattern` splits texts into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.text_of = [str(i) for i in range(len(self.bytes_of))]
        self.first = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        left, right, rank = [], [], []
        for token, i in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(i)
        self.pairs = PairTable((np.array(left, np.int64) << 32) | np.array(right, np.int64), np.array(rank, np.int64))
        self.pair_rank = dict(zip(zip(left, right), rank))
        self.cache: dict[str, tuple[int, ...]] = {}

    def merged(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each piece."""
        out: list[tuple[int, ...]] = [()] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            if (whole := self.ranks.get(p)) is not None:
                out[k] = (whole,)
            elif len(p) > WIDEST:
                out[k] = self._heap(p)
            else:
                buckets.setdefault(max(4, 1 << (len(p) - 1).bit_length()), []).append(k)
        for width, members in buckets.items():
            rows = max(1, (1 << 20) // width)
            for at in range(0, len(members), rows):
                part = members[at : at + rows]
                for k, ids in zip(part, self._matrix([pieces[k] for k in part], width)):
                    out[k] = ids
        return out

    def _matrix(self, pieces: list[bytes], width: int) -> list[tuple[int, ...]]:
        n = len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        length = np.array([len(p) for p in pieces])
        ids = np.where(np.arange(width) < length[:, None], self.first[raw], -1)
        rank = np.full((n, width), NONE, np.int64)
        rank[:, :-1] = self.pairs.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        out: list[tuple[int, ...]] = [()] * n
        names, column = np.arange(n), np.arange(width)
        while len(names):
            at = rank.argmin(axis=1)  # the leftmost of equal ranks
            row = np.arange(len(names))
            best = rank[row, at]
            if (done := best == NONE).any():
                for k in np.flatnonzero(done):
                    out[names[k]] = tuple(ids[k, : length[k]].tolist())
                keep = ~done
                names, ids, rank, length, at, best = names[keep], ids[keep], rank[keep], length[keep], at[keep], best[keep]
                row = np.arange(len(names))
                if not len(names):
                    break
            source = np.minimum(column + (column > at[:, None]), width - 1)
            ids, rank = np.take_along_axis(ids, source, 1), np.take_along_axis(rank, source, 1)
            length = length - 1
            ids[row, at] = best
            ids[row, length] = -1
            rank[row, length] = NONE
            right = np.minimum(at + 1, width - 1)
            rank[row, at] = np.where(at + 1 < length, self.pairs.get(best, ids[row, right]), NONE)
            has = at > 0
            rank[row[has], at[has] - 1] = self.pairs.get(ids[row[has], at[has] - 1], best[has])
        return out

    def _heap(self, piece: bytes) -> tuple[int, ...]:
        ids = self.first[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.pair_rank.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (x := get((r, ids[after[j]]))) is not None:
                    heapq.heappush(heap, (x, i, r, ids[after[j]]))
            if (h := before[i]) >= 0 and (x := get((ids[h], r))) is not None:
                heapq.heappush(heap, (x, h, ids[h], r))
        return tuple(x for x in ids if x >= 0)

    def _learn(self, pieces) -> None:
        new = [p for p in dict.fromkeys(pieces) if p not in self.cache]
        if len(self.cache) + len(new) > CACHE:
            self.cache = {}
            new = list(dict.fromkeys(pieces))
        self.cache.update(zip(new, self.merged([p.encode() for p in new])))

    def encode(self, texts: list[str]) -> Iterator[Iterator[list[int]]]:
        """For each text its ids, in blocks."""
        group: list[list[str]] = []
        size = 0
        for t in texts:
            if len(t) > LONG_TEXT:
                yield from self._encoded(group)
                group, size = [], 0
                yield self._blocks(t)
                continue
            group.append(self.pattern.findall(t))
            size += len(t)
            if size > GROUP:
                yield from self._encoded(group)
                group, size = [], 0
        yield from self._encoded(group)

    def _encoded(self, group: list[list[str]]):
        self._learn([*chain.from_iterable(group)])
        for pieces in group:
            yield iter([list(chain.from_iterable(map(self.cache.__getitem__, pieces)))])

    def _blocks(self, t: str):
        matches = (m[0] for m in self.pattern.finditer(t))
        while block := list(islice(matches, CACHE // 2)):
            self._learn(block)
            yield list(chain.from_iterable(map(self.cache.__getitem__, block)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_CODECS: dict[str, Codec] = {}


def _codec(name: str, shared, pattern: str) -> Codec:
    """One codec per worker process and vocabulary."""
    if name not in _CODECS:
        _CODECS[name] = Codec(shared.value, pattern)
    return _CODECS[name]


def _share(spark: SparkSession, path: str, pattern: str):
    """The ranks of a vocabulary (bounded: checked) as a broadcast, and a name for them."""
    ranks = load_ranks(path)
    if len(ranks) > 2_000_000:
        raise ValueError(f"{path}: {len(ranks)} ranks are more than a vocabulary has")
    name = hashlib.sha256(repr((len(ranks), sorted(ranks)[:100], pattern, path)).encode()).hexdigest()
    return spark.sparkContext.broadcast(ranks), name


def encode(docs: DataFrame, path: str, pattern: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids array<int>."""
    shared, name = _share(docs.sparkSession, path, pattern)
    kind = dict(docs.dtypes)[doc]

    def run(batches):
        codec = _codec(name, shared, pattern)
        for b in batches:
            ids = [[x for block in blocks for x in block] for blocks in codec.encode([t or "" for t in b.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc", "ids"])

    return docs.select(doc, text).mapInArrow(run, f"doc {kind}, ids array<int>").withColumnRenamed("doc", doc)


def decode(encoded: DataFrame, path: str, pattern: str, doc: str = "doc_id") -> DataFrame:
    """doc_id, bytes: the bytes of the ids, which need not be valid UTF-8."""
    shared, name = _share(encoded.sparkSession, path, pattern)
    kind = dict(encoded.dtypes)[doc]

    def run(batches):
        codec = _codec(name, shared, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codec.decode(x or []) for x in b.column(1).to_pylist()], pa.binary())], ["doc", "bytes"])

    return encoded.select(doc, "ids").mapInArrow(run, f"doc {kind}, bytes binary").withColumnRenamed("doc", doc)


def round_trip(docs: DataFrame, path: str, pattern: str, doc: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids): encodes every text and decodes its ids, in one pass."""
    shared, name = _share(docs.sparkSession, path, pattern)
    kind = dict(docs.dtypes)[doc]

    def run(batches):
        codec = _codec(name, shared, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                rows = []
                for blocks in codec.encode([t or "" for t in part.column(1).to_pylist()]):
                    n, said, back, every = 0, hashlib.sha256(), hashlib.sha256(), []
                    for ids in blocks:
                        if ids:
                            said.update((("," if n else "") + ",".join(map(codec.text_of.__getitem__, ids))).encode())
                            back.update(codec.decode(ids))
                            n += len(ids)
                            if keep_ids:
                                every.extend(ids)
                    rows.append((n, said.hexdigest(), back.hexdigest(), every))
                columns = list(zip(*rows)) or [()] * 4
                out = {"doc": part.column(0), "n_tokens": pa.array(columns[0], pa.int64()), "ids_sha256": pa.array(columns[1], pa.string()), "decoded_sha256": pa.array(columns[2], pa.string())}
                if keep_ids:
                    out["ids"] = pa.array(columns[3], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    schema = f"doc {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select(doc, text).mapInArrow(run, schema).withColumnRenamed("doc", doc)
