"""Near copies by the Jaccard similarity of word shingles, for the pipeline.

Words are those of `bloom_lm` (maximal runs of bytes other than blank and tab to carriage return, A-Z lowered); a shingle
is `k` consecutive words, or all words where there are fewer. Two texts link where the sets of their shingles' 64-bit
hashes have a Jaccard similarity of `least` or more; texts without words link with one another.

Candidates come from operator 7: the long fingerprints of the sets go through its vantage-point tree (`simhash_vp.set_links`), whose links
join texts to groups. Every candidate is verified by its exact similarity; links are never taken from the fingerprints alone. First each
text of a group is compared with the group's smallest text (its hub); the texts of a hub are dealt into chunks of about `CHUNK`, each with
a copy of the hub's text, so that a hot group is spread over all tasks and moves each text once. Only groups whose texts are then still in
different components are looked at further: of up to `PAIRS` texts all pairs of different components; of more, the texts in the order of
their components are cut into chunks, and each pair of chunks that isn't of one component alone is verified together, where a text that has
joined a component isn't compared with the rest of it. So nothing holds more than two chunks.

A text is named by 64 bits. Names that different texts share (told by 64 further bits) are replaced; n rows have about n * n / 2 ** 65 of
them, and beyond `SHARED` all names are of SHA-256.

Edge cases: null texts are empty; equal texts are one node; a null id never names a component while another is there; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import in_order
from . import simhash_vp
from .bloom_lm import mix, token_hashes
from .common import cut, discard, fresh, stored, text_of
from .graph import components

PAIRS, CHUNK, SHARED = 16, 64, 1000
#: Bits of a bitmap of names: for each name, and at most (32 MB).
BITS, MOST = 8, 1 << 28


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    w = token_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(w):
        return w
    n, k = max(1, len(w) - k + 1), min(k, len(w))
    h = mix(w[:n] + np.uint64(k))
    for j in range(1, k):
        h = mix(h * np.uint64(31) + w[j : n + j])
    return np.unique(h)


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    if not len(a) or not len(b):
        return len(a) == len(b)
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both)


def forest(nodes: list[int], sets: list[np.ndarray], least: float):
    """(a, b) links that span the components of a group; a text joins each component at its first similar member."""
    parts: list[list[int]] = []
    for i in range(len(nodes)):
        joined, rest = [i], []
        for p in parts:
            if (hit := next((j for j in p if similar(sets[i], sets[j], least)), None)) is None:
                rest.append(p)
            else:
                yield nodes[i], nodes[hit]
                joined = p + joined
        parts = [*rest, joined]


def links(docs: DataFrame, least: float, k: int) -> DataFrame:
    """(a, b): links that span the components; `docs` has node and text."""

    def sign(batches):
        for b in batches:
            sets = [shingles(t.as_py(), k) for t in b.column(1)]
            words = np.array([simhash_vp.set_fingerprint(s) for s in sets], np.uint64).view(np.int64).reshape(-1, simhash_vp.WORDS)
            columns = [b.column(0), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(words[:, j]) for j in range(simhash_vp.WORDS))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "n", *(f"w{j}" for j in range(simhash_vp.WORDS))])

    signed = docs.mapInArrow(sign, "node long, n long, " + ", ".join(f"w{j} long" for j in range(simhash_vp.WORDS)))
    signed = stored(signed.dropDuplicates(["node"]))
    shared = stored(components(simhash_vp.set_links(signed, least)).select(F.col("root").alias("key"), "node"))
    discard(signed)
    star = stored(shared.filter("node <> key").select(F.col("key").alias("hub"), "node"))

    def verify(batches):
        at, nodes, sets, out = None, [], [], []
        for b in batches:
            for g, node, text in zip(*(c.to_pylist() for c in b.columns)):
                if g != at:
                    out.extend(forest(nodes, sets, least))
                    at, nodes, sets = g, [], []
                nodes.append(node), sets.append(shingles(text, k))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])
            out = []
        out.extend(forest(nodes, sets, least))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    def with_hub(batches):
        """Links of the rows of a group with its first one."""
        at, hub, held = None, None, None
        for b in batches:
            out = []
            for g, later, node, text in zip(*(c.to_pylist() for c in b.columns)):
                if g != at:
                    at, hub, held = g, node, shingles(text, k)
                elif similar(held, shingles(text, k), least):
                    out.append((hub, node))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    nodes = stored(shared.select("node"))
    texts = stored(marked(docs, nodes, "node", "hit").filter("hit").dropDuplicates(["node"]).join(nodes, "node", "left_semi").select("node", "text"))

    def verified(groups: DataFrame, how=verify) -> DataFrame:
        """The links within groups (group, later, node)."""
        rows = groups.join(texts, "node").select("group", "later", "node", "text").repartition("group").sortWithinPartitions("group", "later")
        return (rows if how is with_hub else rows.drop("later")).mapInArrow(how, "a long, b long")

    hub_chunks = star.groupBy("hub").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    name = F.xxhash64("hub", "chunk").alias("group")
    members = star.join(hub_chunks, "hub").select("hub", "node", F.pmod(F.xxhash64("node"), "chunks").alias("chunk")).select(name, F.lit(True).alias("later"), "node")
    heads = hub_chunks.select("hub", F.explode(F.sequence(F.lit(0), F.col("chunks").cast("long") - 1)).alias("chunk")).select(name, F.lit(False).alias("later"), F.col("hub").alias("node"))
    first = stored(verified(members.unionByName(heads), with_hub))
    placed = shared.select("key", "node").join(components(first), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    sums = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"h{i}") for i in (1, 2)]
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), *sums).filter("low <> high")
    mixed = mixed.groupBy("n", "h1", "h2").agg(F.min("key").alias("key"))  # keys of the same texts count once
    lists = stored(placed.join(mixed.select("key", "n"), "key").select("key", "n", "node", "root"))
    few = lists.filter(F.col("n") <= PAIRS).groupBy("key").agg(F.sort_array(F.collect_set(F.struct("node", "root"))).alias("nodes")).select("nodes")
    pair = "flatten(transform(sequence(1, size(nodes) - 1), i -> transform(filter(slice(nodes, i + 1, size(nodes)), y -> y.root <> nodes[i - 1].root), y -> array(nodes[i - 1].node, y.node))))"
    pairs = few.select(F.explode(F.expr(pair)).alias("nodes")).distinct()
    pairs = pairs.join(star.select(F.array("hub", "node").alias("nodes")), "nodes", "left_anti")  # those were compared
    groups = pairs.select(F.xxhash64("nodes").alias("group"), F.explode("nodes").alias("node")).unionByName(chunk_pairs(lists.filter(F.col("n") > PAIRS)))
    second = stored(verified(groups.select("group", F.lit(True).alias("later"), "node")))
    discard(shared, star, lists, nodes, texts)
    return first.unionByName(second)


def chunk_pairs(lists: DataFrame) -> DataFrame:
    """(group, node): the texts of long lists (key, node, root) in groups of two chunks, so that any two of different roots meet in one."""
    if lists.isEmpty():
        return lists.select(F.col("key").alias("group"), "node")
    placed = in_order(lists.select("key", "node", "root"), ["key"], ["root", "node"], {"at": F.lit(1)})
    placed = cut(placed.select("key", "node", "root", F.floor((F.col("at") - 1) / CHUNK).alias("chunk")))
    chunks = placed.groupBy("key", "chunk").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    other = chunks.select("key", F.col("chunk").alias("c"), F.col("low").alias("l"), F.col("high").alias("h"))
    alone = (F.col("low") == F.col("h")) & (F.col("high") == F.col("l"))  # sorted by root: both of one root
    met = chunks.join(other, "key").filter((F.col("chunk") <= F.col("c")) & ~alone)
    met = met.select("key", F.explode(F.array_distinct(F.array("chunk", "c"))).alias("chunk"), F.xxhash64("key", "chunk", "c").alias("group"))
    return met.join(placed, ["key", "chunk"]).select("group", "node")


def text_name(docs: DataFrame, text: str) -> Column:
    """A column that names texts by 64 bits, no two different texts of `docs` alike."""
    t = text_of(text)
    name, second = F.xxhash64(t), F.xxhash64(t, F.lit(1))
    twice = docs.select(name.alias("k"), second.alias("o")).groupBy("k").agg(F.min("o").alias("low"), F.max("o").alias("high")).filter("low <> high").select("k").limit(SHARED + 1).collect()
    long = F.conv(F.substring(F.sha2(t.cast("binary"), 256), 1, 15), 16, 10).cast("long")
    if len(twice) > SHARED:
        return long
    return F.when(name.isin([r["k"] for r in twice]), long).otherwise(name) if twice else name


def marked(docs: DataFrame, nodes: DataFrame, node: str, hit: str) -> DataFrame:
    """`docs` with a column `hit` that is true where `node` (64 bits of a hash) is one of `nodes`, and at a few other rows.

    The names are broadcast as a bitmap of `BITS` bits or more a name, `MOST` bits at most; of more names than that all rows are true.
    What is true must be joined with the names; the rest of the rows needs no shuffle.
    """
    bits = 1 << max(15, (BITS * nodes.count()).bit_length())
    if bits > MOST:
        return docs.withColumn(hit, F.lit(True))
    bucket, bitmap = fresh(docs, "bucket"), fresh(docs, "bitmap")
    place = F.pmod(F.col(node), F.lit(bits)) + 1
    at = F.bitmap_bit_position(place)
    maps = nodes.select(F.bitmap_bucket_number(F.pmod(F.col("node"), F.lit(bits)) + 1).alias(bucket), F.bitmap_bit_position(F.pmod(F.col("node"), F.lit(bits)) + 1).alias("at"))
    maps = maps.groupBy(bucket).agg(F.bitmap_construct_agg("at").alias(bitmap))
    byte = F.conv(F.hex(F.substring(F.col(bitmap), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.pmod(F.floor(byte / F.pow(F.lit(2), at % 8)), F.lit(2)) == 1
    joined = docs.withColumn(bucket, F.bitmap_bucket_number(place)).join(F.broadcast(maps), bucket, "left")
    return joined.select(*docs.columns, F.coalesce(bit, F.lit(False)).alias(hit))


def grouped(docs: DataFrame, least: float, k: int, doc: str, text: str, name: Column) -> DataFrame:
    """(doc, node, root): each row's id and the name of its text, and the component of the text."""
    x = docs.select(F.col(doc).alias("doc"), text_of(text).alias("text"), name.alias("node"))
    root = components(links(x.select("node", "text"), least, k))
    return x.select("doc", "node").join(root, "node", "left").select("doc", "node", F.coalesce("root", "node").alias("root"))


def near_copies(docs: DataFrame, least: float = 0.8, k: int = 5, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, component_id: the smallest id among the rows whose texts are reachable by links."""
    rows = cut(grouped(docs, least, k, doc, text, text_name(docs, text)))
    return rows.join(rows.groupBy("root").agg(F.min("doc").alias("component_id")), "root").select(F.col("doc").alias(doc), "component_id")


def first_of_each(docs: DataFrame, rows: DataFrame, doc: str, name: Column) -> DataFrame:
    """The row of `docs` with the smallest id of each root of `rows` (doc, node, root), whose node is the column `name` of `docs`. A null id counts as the largest; different texts
    of one id are told apart by their names; rows that repeat id and text give one. Rows that are alone in their component stay where they are."""
    rows = stored(rows)
    one = rows.groupBy("root").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "node")).alias("x"))
    several = one.filter("n > 1")
    touched = stored(rows.select("root", "node").distinct().join(several.select("root"), "root", "left_semi").select("node"))
    names = [fresh(docs, n) for n in ("kept_none", "kept_id", "kept_node", "hit")]

    def key(none, d, node):
        return [none.alias(names[0]), F.coalesce(d.cast("string"), F.lit("")).alias(names[1]), node.alias(names[2])]

    kept = one.select(*key(F.col("x.none"), F.col("x.doc"), F.col("x.node")))
    named = marked(docs.select("*", *key(F.col(doc).isNull(), F.col(doc), name)), touched, names[2], names[3])
    alone = named.filter(~F.col(names[3]))
    # Repeats are merged before the join, so a hot row reaches it once a task; both use one partitioning.
    first = named.filter(names[3]).dropDuplicates(names[:3]).join(kept, names[:3], "left_semi")
    return alone.unionByName(first).select(*docs.columns)


def deduplicated(docs: DataFrame, least: float = 0.8, k: int = 5, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component: that of its smallest id, and among different texts of this id that of the smallest hash."""
    name = text_name(docs, text)
    return first_of_each(docs, grouped(docs, least, k, doc, text, name), doc, name)
