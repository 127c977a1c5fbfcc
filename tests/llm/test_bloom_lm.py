"""The Bloom filter language model: exact base score, bounded errors of the filter, better than the base where text repeats."""

import brute
import numpy as np
import pytest

from gridloom.llm import bloom_lm as lm
from gridloom.llm.common import read


def pairs(df):
    return [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize(("head", "most", "slices"), [(1 << 20, 256 << 20, None), (50, 100_000, 64)])
def test_scores(spark, odd, head, most, slices):
    for d in (read(spark, "/root/testdata/sf0.01", "documents"), odd):
        rows = lm.score(d, slices, head, most).collect()
        want = sorted(brute.unigram(pairs(d)))
        got = sorted(tuple(r)[:6] for r in rows)
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9)
        assert all(r.score <= 0 for r in rows)
    assert lm.score(odd.limit(0)).count() == 0


def test_passes_do_not_change_the_scores(spark):
    d = read(spark, "/root/testdata/sf0.001", "documents")
    one = {r.doc_id: r.score for r in lm.score(d, 64).collect()}
    assert len(lm.passes({k: 900 for k in range(16)}, 2000)) == 8 and lm.passes({0: 10, 1: 5000, 2: 10}, 2000) == [[0], [1], [2]] and lm.passes({}, 9) == [[]]
    assert {r.doc_id: r.score for r in lm.score(d, 64, max_filter=20_000).collect()} == pytest.approx(one)


def test_model_beats_the_base(spark):
    rows = lm.score(read(spark, "/root/testdata/sf0.1", "documents")).collect()
    for held in (True, False):
        some = [r for r in rows if r.held_out == held]
        n = sum(r.n_tokens for r in some)
        assert sum(r.score for r in some) / n > sum(r.base_score for r in some) / n


def test_filter_levels():
    rng = np.random.default_rng(1)
    keys, other = rng.integers(0, 1 << 63, 20_000, np.uint64), rng.integers(0, 1 << 63, 20_000, np.uint64)
    q = rng.integers(1, 6, len(keys))
    s = lm.slices_of(keys, 4)
    f = lm.Filter({int(k): lm.Segment.of([(keys[s == k], "unigram", q[s == k])]).bits.tobytes() for k in np.unique(s)}, 4)
    got = f.levels(keys, "unigram")
    assert (got >= q).all() and (got > q).mean() < 0.02 and (f.levels(other, "unigram") > 0).mean() < 0.02


def test_token_hashes_are_of_the_words():
    a, b = lm.token_hashes("Abc  déf\tabc　x".encode()), lm.token_hashes("zz abc".encode())
    assert len(a) == 3 and a[0] == b[1] and len(set(a[:2].tolist())) == 2 and lm.token_hashes(b" \n").size == 0


def test_one_part_of_the_filter_at_a_time(spark, monkeypatch):
    from pyspark import Broadcast, SparkContext

    alive, most = set(), []
    make, end = SparkContext.broadcast, Broadcast.destroy

    def broadcast(self, value):
        b = make(self, value)
        if isinstance(value, dict):  # segments by slice
            alive.add(id(b))
            most.append((len(alive), sum(map(len, value.values()))))
        return b

    def destroy(self, *a):
        alive.discard(id(self))
        return end(self, *a)

    monkeypatch.setattr(SparkContext, "broadcast", broadcast)
    monkeypatch.setattr(Broadcast, "destroy", destroy)
    lm.score(read(spark, "/root/testdata/sf0.001", "documents"), 64, max_filter=20_000).count()
    assert len(most) >= 8 and all(n == 1 and size <= 20_000 for n, size in most)


def test_score_is_near_an_exact_model(spark):
    """Witten-Bell bigrams with exact counts: the quantised score differs by less than 0.06 a token in the mean, 0.2 at most."""
    import math
    import re
    from collections import Counter

    docs = pairs(read(spark, "/root/testdata/sf0.01", "documents"))
    got = {r.doc_id: r for r in lm.score(read(spark, "/root/testdata/sf0.01", "documents")).collect()}
    tokens = {d: [*re.findall(r"[^\x20\x09-\x0D]+", brute.lower(t or "")), None] for d, t in docs}
    one, two, after = Counter(), Counter(), Counter()
    for d, w in tokens.items():
        if not got[d].held_out:
            one.update(w)
            two.update(zip(["<", *w[:-1]], w))
    for h, _ in two:
        after[h] += 1
    seen = Counter()
    for (h, _), n in two.items():
        seen[h] += n
    floor = sum(one.values()) + 0.5 * (len(one) + 1)
    wrong = []
    for d, w in tokens.items():
        total = 0.0
        for h, x in zip(["<", *w[:-1]], w):
            p = (one[x] + 0.5) / floor
            total += math.log10((two[h, x] + after[h] * p) / (seen[h] + after[h]) if seen[h] else p)
        wrong.append(abs(total - got[d].score) / len(w))
    print("error a token", np.mean(wrong), np.max(wrong))
    assert np.mean(wrong) < 0.06 and np.max(wrong) < 0.2
