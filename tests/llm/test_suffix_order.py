"""Operator 4's rows come through the order of the suffixes that the difference cover gives."""

import random

import brute
import numpy as np
import pytest

from gridloom.llm import suffix_dedup as sd
from gridloom.llm.common import read


def symbols(spark):
    r = random.Random(2)
    texts = {k: [r.randrange(2) for _ in range(n)] for k, n in enumerate((1, 2, 3, 4, 5, 10, 11))}
    texts[20], texts[21] = [1] * 9, [1] * 9
    return texts, spark.createDataFrame([(k, i, s, 4) for k, t in texts.items() for i, s in enumerate(t)], "seq long, i int, sym long, need int")


@pytest.mark.parametrize("rest", [0, 1 << 18])
def test_suffixes_are_ranked_as_far_as_needed(spark, monkeypatch, rest):
    """Over all levels as jobs, and with the last ones in a task: those that agree in four symbols stand together, in the order of these."""
    monkeypatch.setattr(sd, "REST", rest)
    texts, df = symbols(spark)
    got = sorted((r["rank"], r.seq, r.i) for r in sd.suffix_ranks(df).collect())
    assert len(got) == sum(map(len, texts.values()))
    told = [texts[k][i : i + 4] for _, k, i in got]
    assert told == sorted(told)
    whole = sorted((r["rank"], r.seq, r.i) for r in sd.suffix_ranks(df.drop("need")).collect())
    told = [texts[k][i:] for _, k, i in whole]
    assert told == sorted(told)


def test_windows_reach_the_same_anchors_in_any_surroundings():
    rng = np.random.default_rng(5)
    draw = lambda n: bytes(rng.integers(97, 103, n, dtype=np.uint8))
    for _ in range(30):
        inner, names = draw(400), []
        for raw in (inner, draw(int(rng.integers(0, 300))) + inner, draw(90) + inner + draw(int(rng.integers(0, 300)))):
            at = raw.index(inner)
            every, first, last = sd.anchors(raw)
            own = np.searchsorted(last, [at])
            n = sd.reach_of(every, first, np.array([at]), own, 400)[0]
            names.append((every[own[0] : own[0] + n] - at).tolist())
        assert names[0] == names[1] == names[2] and names[0][-1] + sd.CORE <= 400


def test_the_cover_gives_the_rows_over_several_levels(spark, monkeypatch):
    monkeypatch.setattr(sd, "REST", 1000)
    d = read(spark, "/root/testdata/sf0.001", "documents")
    want = sorted(brute.repeats([(r[0], r[1]) for r in d.select("doc_id", "text").collect()], 400))
    assert sorted(tuple(x)[:5] for x in sd.remove_repeats(d).collect()) == want


def test_the_order_decides(spark, monkeypatch):
    """One passage that goes on in two ways: the cover and the lists of names give the rows of brute force; ranked by the cores' hashes, repeats are lost."""
    r = random.Random(8)
    draw = lambda n: "".join(r.choices("abcdefghij", k=n))
    passage, ends = draw(300), [draw(300), draw(300)]
    docs = [(k, draw(50) + passage + ends[k % 2] + draw(50)) for k in range(24)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    run = lambda **more: sorted(tuple(x)[:5] for x in sd.remove_repeats(df, **more).collect())
    want = sorted(brute.repeats(docs, 400))
    assert run() == run(order="names") == want and all(x[2] >= 600 for x in want)
    monkeypatch.setattr(sd, "rank_parts", lambda s: s.select("seq", "i", s["sym"].alias("rank")))
    assert sum(x[2] for x in run()) < sum(x[2] for x in want)
