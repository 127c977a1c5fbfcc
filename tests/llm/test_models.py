"""Operators with Python inside tasks, against brute force, public libraries or held-out rows."""

import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import bpe, quality_fm, simhash_vp
from gridloom.llm.common import read

SF = "/root/testdata/sf0.001"
P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_multi_50k.tiktoken")


def pairs(df):
    return [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


def test_bpe_like_the_library(spark, odd):
    import tiktoken

    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
    for d in (read(spark, SF, "documents"), odd):
        want = sorted((i, len(x := e.encode_ordinary(t or "")), brute.sha(",".join(map(str, x))), brute.sha(t or "")) for i, t in pairs(d))
        assert sorted(tuple(r) for r in bpe.round_trip(d, PATH, P.PATTERN).collect()) == want
    ids = bpe.encode(odd, PATH, P.PATTERN)
    assert {r.doc_id: r.ids for r in ids.collect()} == {i: e.encode_ordinary(t or "") for i, t in pairs(odd)}
    assert {r.doc_id: bytes(r.bytes).decode() for r in bpe.decode(ids, PATH, P.PATTERN).collect()} == {i: t or "" for i, t in pairs(odd)}
    assert bpe.round_trip(odd.limit(0), PATH, P.PATTERN).count() == 0


def test_bpe_long_pieces_and_texts(monkeypatch):
    import random

    import tiktoken

    ranks = bpe.load_ranks(PATH)
    e, codec = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.Codec(ranks, P.PATTERN)
    monkeypatch.setattr(bpe, "LONG_TEXT", 1000)
    monkeypatch.setattr(bpe, "CACHE", 50)
    r = random.Random(1)
    texts = ["".join(r.choice("etaoinshr ") for _ in range(n)) for n in (3, 900, 5000)] + ["ab" * 4000, " " * 700, "thein" * 90]
    assert [[x for b in blocks for x in b] for blocks in codec.encode(texts)] == [e.encode_ordinary(t) for t in texts]


def test_simhash(spark, odd):
    for d in (read(spark, "/root/testdata/sf0.01", "documents"), odd):
        got = sorted(tuple(r) for r in simhash_vp.digest(simhash_vp.near_duplicates(d)).collect())
        assert got == sorted(brute.simhash(pairs(d)))
    assert simhash_vp.near_duplicates(odd.limit(0)).count() == 0
    kept = simhash_vp.deduplicated(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {c for _, _, c in brute.simhash(pairs(odd))}


def test_vantage_point_tree_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash_vp, "LEAF", 1000)
    monkeypatch.setattr(simhash_vp, "FEW", 100)
    rng = np.random.default_rng(1)
    far = rng.integers(0, 1 << 63, 3000, np.uint64)
    near = far[:500].copy()
    for _ in range(4):
        near ^= np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)
    hub = far[0] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))
    fps = np.unique(np.concatenate([far, near, hub]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    tree = simhash_vp.Tree(fps[:2000], len(fps), 4)
    assert len(tree.chunks) > 4
    root = {r.node: r.root for r in simhash_vp.components(simhash_vp.links(df)).collect()}
    i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None]) <= 4, 1))
    assert len(i) > 500 and all(root[int(fps[a].view(np.int64))] == root[int(fps[b].view(np.int64))] for a, b in zip(i, j))
    want = set(i) | set(j)
    assert len(root) == len(want)


def test_quality_held_out(spark, odd):
    docs, labels = (read(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality_fm.classify(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    known = [(got[r.doc_id], r.quality) for r in labels.collect()]
    right = [r.predicted == q for r, q in known if r.held_out]
    assert len(right) > 500 and np.mean(right) > 0.95
    machine = quality_fm.Machine().fit([], np.zeros(0))
    assert {r.score for r in quality_fm.score(odd, machine).collect()} == {0.5}
    assert quality_fm.classify(odd, labels.limit(0)).count() == odd.count() and quality_fm.classify(odd.limit(0), labels).count() == 0
    assert quality_fm.accepted(odd, labels.limit(0)).columns == odd.columns


def test_machine_identity():
    m = quality_fm.Machine(1)
    m.v = np.random.default_rng(2).normal(0, 1, m.v.shape).astype(np.float32)
    idx, x = quality_fm.features("The quick brown fox|| 12 THE")
    pair = sum(float(m.v[i] @ m.v[j]) * x[a] * x[b] for a, i in enumerate(idx) for b, j in enumerate(idx) if a < b)
    assert m.parts(idx, x, np.array([0]))[0][0] == pytest.approx(pair, rel=1e-3)


def test_schema_keeps_extra_columns(odd):
    out = quality_fm.score(odd.withColumn("z", F.array(F.lit(1))), quality_fm.Machine().fit([], np.zeros(0)))
    assert out.columns[-2:] == ["z", "score"] and out.count() == odd.count()
