"""Suffix-array deduplication and its difference cover against brute force."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from gridloom.llm import suffix_dedup as sd
from gridloom.llm.common import read


def pairs(df):
    return [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


def test_suffix_ranks(spark):
    r = random.Random(1)
    texts = {k: [r.randrange(3) for _ in range(n)] for k, n in enumerate((1, 2, 3, 4, 5, 40, 41, 42, 100))}
    texts[50] = texts[51] = [1, 1, 1, 1, 1, 1, 1]
    texts[52], texts[53] = [2] * 60, [2] * 61 + [0]
    rows = [(k, i, s) for k, t in texts.items() for i, s in enumerate(t)]
    ranks = {(x.seq, x.i): x["rank"] for x in sd.suffix_ranks(spark.createDataFrame(rows, "seq long, i int, sym long")).collect()}
    assert len(ranks) == len(rows)
    named = sorted((texts[k][i:], ranks[k, i]) for k, i, _ in rows)
    for (a, x), (b, y) in zip(named, named[1:]):
        assert a == b or max(z for c, z in named if c == a) < min(z for c, z in named if c == b)


def test_removal(spark, odd):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgé") for _ in range(r.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(n) for n in (60, 100, 160, 300)]
    docs = [text(r.randrange(1, 200)) for _ in range(40)]
    for _ in range(60):
        p, d = r.choice(passages), r.randrange(len(docs))
        a = r.randrange(len(p) // 2)
        docs[d] = docs[d][: r.randrange(1 + len(docs[d]))] + p[a : a + r.randrange(200, 900)] + text(3) + docs[d][r.randrange(1 + len(docs[d])) :]
    docs += ["ab" * 700, "z" * 399, "z" * 400, "z" * 900, docs[3], docs[3], docs[5] + "!", None, ""]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = sorted(tuple(x) for x in sd.remove_repeats(df).collect())
    assert [g[:5] for g in got] == sorted(brute.repeats(enumerate(docs), 400)) and sum(g[2] > 0 for g in got) > 20
    assert {g[0]: g[5] > 0 for g in got} == brute.shared(enumerate(docs), sd.CORE, sd.REACH, sd.anchors) and any(g[5] and not g[2] for g in got)
    small = [(r_.doc_id, (r_.text or "")[:3000]) for r_ in odd.collect()]
    df = spark.createDataFrame(small, "doc_id long, text string")
    got = sorted(tuple(x) for x in sd.remove_repeats(df).collect())
    assert [g[:5] for g in got] == sorted(brute.repeats(small, 400)) and {g[0]: g[5] > 0 for g in got} == brute.shared(small, sd.CORE, sd.REACH, sd.anchors)
    assert sd.remove_repeats(df.limit(0)).count() == 0


def test_on_documents(spark):
    d = read(spark, "/root/testdata/sf0.001", "documents")
    got = sorted(tuple(x) for x in sd.remove_repeats(d).collect())
    assert [g[:5] for g in got] == sorted(brute.repeats(pairs(d), 400)) and {g[0]: g[5] > 0 for g in got} == brute.shared(pairs(d), sd.CORE, sd.REACH, sd.anchors)


def test_the_difference_cover_gives_the_same_rows(spark):
    """Both orders bring equal cores together, and nothing else of an order decides about a row."""
    d = read(spark, "/root/testdata/sf0.001", "documents")
    assert sorted(map(tuple, sd.remove_repeats(d, order="suffix").collect())) == sorted(map(tuple, sd.remove_repeats(d).collect()))


def test_nothing_is_found_without_blocks(spark, monkeypatch):
    d = read(spark, "/root/testdata/sf0.001", "documents").dropDuplicates(["text"])
    assert sum(r.n_removed > 0 for r in sd.remove_repeats(d).collect()) > 10
    adjacent = sd.adjacent
    monkeypatch.setattr(sd, "adjacent", lambda *a: adjacent(*a).limit(0))
    assert not any(r.n_removed or r.n_shared for r in sd.remove_repeats(d).collect())


def test_witnesses_stand_for_the_places_of_a_task(spark, monkeypatch):
    """Tiny flushes, so that equal strings meet as places, witnesses and both."""
    monkeypatch.setattr(sd, "FLUSH", 40)
    d = read(spark, "/root/testdata/sf0.001", "documents")
    got = sorted(tuple(x)[:5] for x in sd.remove_repeats(d.repartition(7)).collect())
    assert got == sorted(brute.repeats(pairs(d), 400))


def test_two_texts_of_one_name(spark, monkeypatch):
    d = spark.createDataFrame([(k, f"{k % 3} " + "word " * 100) for k in range(6)], "doc_id long, text string")
    texts = d.select(F.col("doc_id").alias("doc"), "text")
    monkeypatch.setattr(sd.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    rows, copies = sd.named_texts(texts)
    assert len({r.k for r in rows.collect()}) == 3 and sorted(r.copies for r in copies.collect()) == [2, 2, 2]
