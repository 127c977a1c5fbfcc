"""SimHash near-duplicates over vantage-point trees.

Words are maximal runs of bytes other than blank and tab to carriage return, with A-Z lowered; a shingle is `k`
consecutive words joined by blanks (all words where there are fewer). A bit of the 64-bit fingerprint is set where over
half of the shingles' XXH64 hashes (seed 42) have it; no words give zero. Fingerprints link at `radius` differing bits or fewer.

Only distinct fingerprints are compared. A vantage-point tree is built on the driver from a bounded, documented sample
of them (`SAMPLE`, the smallest by hash): every node has a vantage point and rings of distances to it. By the triangle
inequality two linked fingerprints lie in rings whose distances differ by `radius` at most, so each fingerprint goes into
the ring of its own distance d and into every further ring that begins by d + radius: any linked pair meets in a leaf.
The tree only partitions; its shape can't change the result. Leaves are compared exactly by XOR and bit count: small ones in blocks, of large
ones the pairs that agree in one of `radius` + 1 bands of bits, as every linked pair does; a leaf expected to be large is dealt into pairs of chunks, so no task holds all of it. A task
returns a spanning forest of its links, not the pairs, and connected components join the forests.

Links by the Jaccard similarity of shingles (`set_links`, the pipeline's stage) take the same way with longer fingerprints: at
similarity 0.8 a bit differs with probability 0.15 (0.19 for the smallest sets), so fingerprints of `WORDS` * 64 bits link at `WIDE`
differing bits or fewer, `FIRST` at most of them in the first word; a pair at 0.8 is missed with a probability of 0.0002 or less. At such
a radius no fingerprint prunes as a vantage point, but the empty set does: its rings are those of the set's size, and linked
sets differ in their size's logarithm by log(1 / least) at most. Leaves are compared in the order of sizes, each block with the sizes it can link to.

Edge cases: null and empty texts have fingerprint zero and link like any other; repeated rows and equal texts share a
fingerprint; a null id never names a component while another is there; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near_copies
from .bloom_lm import mix
from .common import cut, text_of
from .graph import components

SAMPLE, LEAF, RINGS, DEPTH = 8192, 1 << 17, 4, 12
#: Leaves of single fingerprints may be so many times as large: a ring is visited by most of its neighbours, so each level of the tree doubles the rows.
MORE = 8
#: In a task: so few are compared in blocks, more by their bands.
FEW = 2048
#: Fingerprints of sets: words of 64 bits, differing bits of a link in the first word and in all, rings around the empty set, rows of a block of comparisons, tasks at most.
WORDS, FIRST, WIDE, SIZE_RINGS, BLOCK, TASKS = 4, 24, 72, 32, 256, 20_000
_TURN = np.random.default_rng(11).integers(1, 1 << 63, WORDS, np.uint64)


def fingerprint_of(text: str | None, k: int = 4) -> int:
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - k + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(k, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    set_bits = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)])), np.uint64)
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, k: int = 4, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (signed 64 bits)."""
    kind = dict(docs.dtypes)[doc]

    def run(batches):
        for b in batches:
            fps = [fingerprint_of(t.as_py(), k) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc", "fp"])

    return docs.select(doc, F.col(text).cast("string")).mapInArrow(run, f"doc {kind}, fp long").withColumnRenamed("doc", doc)


def set_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """`WORDS` words of a set of 64-bit hashes; a bit is set where over half of its members have it."""
    set_bits = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(hashes), 255):  # so many fit the sums of a byte
        words = mix(hashes[at : at + 255, None] ^ _TURN)
        set_bits += np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(set_bits * 2 > len(hashes), bitorder="little").view(np.uint64)


def distance(fps: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Differing bits, of fingerprints of one word or a row of words each."""
    d = np.bitwise_count(fps ^ point).astype(np.int64)
    return d if d.ndim == 1 else d.sum(1)


def log_size(n: np.ndarray) -> np.ndarray:
    """The distance of a set to the empty set; sets without members link with one another only."""
    return np.log(np.maximum(n, 0.5))


def rings(d: np.ndarray, bounds: np.ndarray, radius: int):
    """(who goes into it, which of these as visitors) for each ring; ring r begins at bounds[r - 1] and ends before bounds[r].

    Everyone visits the rings that begin within `radius` beyond the own distance. Of a linked pair the nearer one visits
    the ring of the farther one, so two visitors need not be compared: they meet where the farther of them is at home.
    """
    low, high = np.searchsorted(bounds, d, "right"), np.searchsorted(bounds, d + radius, "right")
    for r in range(len(bounds) + 1):
        inside = np.flatnonzero((low <= r) & (r <= high))
        yield inside, low[inside] < r


def ring_bounds(d: np.ndarray) -> np.ndarray:
    return np.unique(np.quantile(d, np.arange(1, RINGS) / RINGS).astype(np.int64) + 1)


class Tree:
    """Nodes as (vantage point, ring bounds, children); a leaf has a number and how many chunks it is dealt into."""

    def __init__(self, sample: np.ndarray, total: int, radius: int):
        self.radius, self.scale, self.most = radius, total / max(1, len(sample)), min(MORE * LEAF, max(LEAF, total // 6))
        self.chunks: list[int] = []
        self.root = self._grow(sample, 0, np.random.default_rng(7))

    def _grow(self, members: np.ndarray, depth: int, rng):
        if len(members) * self.scale > self.most and depth < DEPTH and len(members) > 64:
            point = members[rng.integers(len(members))]
            d = distance(members, point)
            bounds = ring_bounds(d)
            parts = [members[m] for m, _ in rings(d, bounds, self.radius)]
            if max(map(len, parts)) < 0.9 * len(members):
                return point, bounds, [self._grow(p, depth + 1, rng) for p in parts]
        self.chunks.append(max(1, int(np.ceil(len(members) * self.scale / self.most))))
        return len(self.chunks) - 1

    def leaves(self, fps: np.ndarray, node=None):
        """(leaf, members) for every leaf that any of the fingerprints goes to."""
        node = self.root if node is None else node
        if isinstance(node, int):
            if len(fps):
                yield node, fps
            return
        point, bounds, children = node
        for (inside, _), child in zip(rings(distance(fps, point), bounds, self.radius), children):
            if len(inside):
                yield from self.leaves(fps[inside], child)


class SetTree(Tree):
    """A tree whose first vantage point is the empty set; points are the rows of (node, size, words...)."""

    def __init__(self, sample: np.ndarray, total: int, least: float):
        self.reach = np.log(1 / least) + 1e-9
        d = log_size(sample[:, 1])
        self.bounds = np.unique(np.quantile(d, np.arange(1, SIZE_RINGS) / SIZE_RINGS)) if len(d) else d
        self.radius, self.scale, self.most, self.chunks = WIDE, total / max(1, len(sample)), LEAF, []
        rng = np.random.default_rng(7)
        self.children = [self._grow(sample[m, 2:], 1, rng) for m, _ in rings(d, self.bounds, self.reach)]

    def leaves(self, points: np.ndarray):
        """(leaf, indices of members, whether each only visits the ring of sizes)."""
        for (inside, visitor), child in zip(rings(log_size(points[:, 1]), self.bounds, self.reach), self.children):
            for leaf, of in self._below(points[:, 2:], inside, child):
                yield leaf, of, visitor[np.searchsorted(inside, of)]

    def _below(self, words: np.ndarray, of: np.ndarray, node):
        if isinstance(node, int):
            if len(of):
                yield node, of
            return
        point, bounds, children = node
        for (inside, _), child in zip(rings(distance(words[of], point), bounds, self.radius), children):
            yield from self._below(words, of[inside], child)


class Forest:
    """Union by smallest index over the fingerprints of a task."""

    def __init__(self, nodes: np.ndarray, radius: int):
        self.nodes, self.radius, self.root = nodes, radius, np.arange(len(nodes))

    def unite(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.root[i], self.root[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            if not len(i):
                return
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up

    def compare(self, left: np.ndarray, right: np.ndarray | None) -> None:
        """All pairs between two index arrays, or within one, in blocks."""
        other = left if right is None else right
        low, mine = self.nodes[other].astype(np.uint32), self.nodes[left].astype(np.uint32)
        for at in range(0, len(left), 256):
            first = at + 1 if right is None else 0
            i, j = np.nonzero(np.bitwise_count(mine[at : at + 256, None] ^ low[None, first:]) <= self.radius)
            i, j = left[i + at], other[j + first]
            near = np.bitwise_count(self.nodes[i] ^ self.nodes[j]) <= self.radius
            self.unite(i[near], j[near])

    def within(self, of: np.ndarray, chunk: np.ndarray | None = None) -> None:
        """All pairs of the indices, or those of different chunks: in blocks, or where they are many those that agree in a band.

        The bits are cut into one band more than may differ, so every linked pair agrees in one of them; pairs of a band are met by shifting its order.
        """
        if len(of) <= FEW:
            self.compare(of, None)
            return
        cuts = np.linspace(0, 64, self.radius + 2).astype(np.uint64)
        for low, high in zip(cuts[:-1], cuts[1:]):
            key = (self.nodes[of] >> low) & ((np.uint64(1) << (high - low)) - np.uint64(1))
            order = np.argsort(key, kind="stable")
            key, mine = key[order], of[order]
            fps, other = self.nodes[mine], None if chunk is None else chunk[mine]
            at, away = np.arange(len(mine) - 1), 1
            while len(at := at[at < len(mine) - away]):
                at = at[key[at] == key[at + away]]
                near = at if other is None else at[other[at] != other[at + away]]
                near = near[np.bitwise_count(fps[near] ^ fps[near + away]) <= self.radius]
                self.unite(mine[near], mine[near + away])
                away += 1

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        moved = np.flatnonzero(self.root != np.arange(len(self.nodes)))
        return self.nodes[moved], self.nodes[self.root[moved]]


class SetForest(Forest):
    """Links of sets that are in the order of their sizes."""

    def __init__(self, nodes: np.ndarray, sizes: np.ndarray, words: np.ndarray, least: float):
        super().__init__(nodes, WIDE)
        self.sizes, self.words, self.least = sizes, words, least

    def compare(self, left: np.ndarray, right: np.ndarray) -> None:
        """Each of the sorted indices `left` with those of `right` that come before it and are large enough."""
        head, size = self.words[right, 0].copy(), self.sizes[right]
        for at in range(0, len(left), BLOCK):
            mine = left[at : at + BLOCK]
            low, high = np.searchsorted(size, self.least * self.sizes[mine[0]] - 1e-6), np.searchsorted(right, mine[-1])
            for x in range(low, high, 4096):
                i, j = np.nonzero(np.bitwise_count(self.words[mine, 0][:, None] ^ head[x : min(high, x + 4096)]) <= FIRST)
                i, j = mine[i], right[j + x]
                near = distance(self.words[i], self.words[j]) <= self.radius
                self.unite(i[near], j[near])


def set_links(prints: DataFrame, least: float) -> DataFrame:
    """(a, b): a spanning forest of the links between the fingerprints of sets, rows (node, n, w0, w1, ...) of longs, each node once."""
    columns = ["node", "n", *(f"w{j}" for j in range(WORDS))]
    picked = prints.orderBy(F.xxhash64("node")).limit(SAMPLE).select(columns).collect()
    tree = SetTree(np.array([tuple(r) for r in picked], np.int64).reshape(-1, len(columns)).view(np.uint64), prints.count(), least)
    fields = ["leaf", "cell", "chunk", "visitor", *columns]

    def deal(batches):
        for b in batches:
            if not b.num_rows:
                continue
            points = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], 1).view(np.uint64)
            for leaf, of, visitor in tree.leaves(points):
                c = tree.chunks[leaf]
                chunk = ((points[of, 0] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % c
                rows = [pa.array(points[of, j].view(np.int64)) for j in range(len(columns))]
                for other in range(c):
                    cell = np.minimum(chunk, other) * c + np.maximum(chunk, other)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(of), leaf, np.int64)), pa.array(cell), pa.array(chunk), pa.array(visitor), *rows], fields)

    def compare(table: pa.Table) -> pa.Table:
        sizes, chunk, visitor = (table.column(c).to_numpy() for c in ("n", "chunk", "visitor"))
        order = np.lexsort((~visitor, sizes))  # of one size, visitors come before those at home
        chunk, home = chunk[order], ~visitor[order]
        forest = SetForest(table.column("node").to_numpy()[order], sizes[order], np.stack([table.column(c).to_numpy()[order] for c in columns[2:]], 1).view(np.uint64), least)
        cell, c = table.column("cell")[0].as_py(), tree.chunks[table.column("leaf")[0].as_py()]
        of = np.arange(len(order))
        if cell // c == cell % c:
            forest.compare(of[home], of)
        else:
            one = chunk == cell % c
            forest.compare(of[home & one], of[~one])
            forest.compare(of[home & ~one], of[one])
        a, b = forest.links()
        return pa.table({"a": a, "b": b})

    dealt = prints.select(columns).mapInArrow(deal, "leaf long, cell long, chunk long, visitor boolean, " + ", ".join(f"{c} long" for c in columns))
    # cells are few bytes and much work, so their number, not their size, makes the tasks
    dealt = dealt.repartition(min(TASKS, max(1, sum(c * (c + 1) // 2 for c in tree.chunks))), "leaf", "cell")
    return dealt.groupBy("leaf", "cell").applyInArrow(compare, "a long, b long")


def links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b): a spanning forest of the links between distinct fingerprints `fp`."""
    n = distinct.count()
    sample = np.array([r[0] for r in distinct.orderBy(F.xxhash64("fp")).limit(SAMPLE).select("fp").collect()], np.int64).view(np.uint64)
    tree = Tree(sample, n, radius)

    def deal(batches):
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for leaf, members in tree.leaves(fps):
                c = tree.chunks[leaf]
                chunk = ((members * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % c
                for other in range(c):
                    cell = np.minimum(chunk, other) * c + np.maximum(chunk, other)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(members), leaf, np.int64)), pa.array(cell), pa.array(chunk), pa.array(members.view(np.int64))], ["leaf", "cell", "chunk", "fp"])

    def compare(table: pa.Table) -> pa.Table:
        fps, chunk = (table.column(c).to_numpy() for c in ("fp", "chunk"))
        order = np.argsort(fps.view(np.uint64))
        forest, chunk = Forest(fps.view(np.uint64)[order], radius), chunk[order]
        cell, c = table.column("cell")[0].as_py(), tree.chunks[table.column("leaf")[0].as_py()]
        forest.within(np.arange(len(order)), None if cell // c == cell % c else chunk)
        a, b = forest.links()
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = distinct.select("fp").mapInArrow(deal, "leaf long, cell long, chunk long, fp long")
    # cells are few bytes and much work, so their number, not their size, makes the tasks
    dealt = dealt.repartition(min(TASKS, max(1, sum(c * (c + 1) // 2 for c in tree.chunks))), "leaf", "cell")
    return dealt.groupBy("leaf", "cell").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 4, k: int = 4, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, component_id: the smallest id among the rows whose fingerprints are reachable by links."""
    prints = cut(fingerprints(docs, k, doc, text))
    distinct = cut(prints.groupBy("fp").agg(F.min(doc).alias("low")))
    root = components(links(distinct, radius))
    linked = distinct.join(root, distinct["fp"] == root["node"]).select("fp", "low", "root")  # no single fingerprint meets a root
    name = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    named = linked.select("fp", "root").join(name, "root").select("fp", "component_id")
    found = prints.join(named, "fp", "left").join(distinct, "fp")
    return found.select(doc, "fp", F.when(F.col("component_id").isNull(), F.col("low")).otherwise(F.col("component_id")).alias("component_id"))


def digest(found: DataFrame, doc: str = "doc_id") -> DataFrame:
    return found.select(doc, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, radius: int = 4, k: int = 4, least: float | None = None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component: that of its smallest id, and among different texts of this id that of the smallest hash.

    With `least` texts link by the Jaccard similarity of their shingles: the tree over long fingerprints (`set_links`) proposes, `near_copies` verifies.
    """
    if least is not None:
        return near_copies.deduplicated(docs, least, k, doc, text)
    name = near_copies.text_name(docs, text)
    x = docs.select(F.struct(F.col(doc).alias("doc"), name.alias("node")).alias("row"), text_of(text).alias("text"))
    prints = cut(fingerprints(x, k, "row").select("row.doc", "row.node", "fp"))
    distinct = cut(prints.select("fp").distinct())
    root = components(links(distinct, radius)).withColumnRenamed("node", "fp")
    return near_copies.first_of_each(docs, prints.select("doc", "node", "fp").join(root, "fp", "left").select("doc", "node", F.coalesce("root", "fp").alias("root")), doc, name)
