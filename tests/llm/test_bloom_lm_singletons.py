"""The filter holds every counted bigram: scores lie near those of exact Witten-Bell counts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import bloom_lm as lm
from gridloom.llm.common import read


def exact(docs):
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    texts = [(d, [None, *re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), ""]) for d, t in docs]
    train = [w for d, w in texts if not held(d)]
    one, two = Counter(x for w in train for x in w[1:]), Counter(p for w in train for p in zip(w, w[1:]))
    c, types = Counter(), Counter(h for h, _ in two)
    for (h, _), n in two.items():
        c[h] += n
    floor = sum(one.values()) + 0.5 * (len(one) + 1)
    single = lambda x: (one[x] + 0.5) / floor
    p = lambda h, x: (two[h, x] + types[h] * single(x)) / (c[h] + types[h]) if h in types else single(x)
    return {d: (sum(math.log10(p(h, x)) for h, x in zip(w, w[1:])), len(w) - 1) for d, w in texts}


@pytest.mark.parametrize("most", [256 << 20, 40_000])
def test_scores_are_near_exact_counts(spark, most):
    d = read(spark, "/root/testdata/sf0.001", "documents")
    want = exact([(r.doc_id, r.text) for r in d.collect()])
    got = {r.doc_id: r.score for r in lm.score(d, 64, max_filter=most).collect()}
    off = np.array([abs(got[i] - s) / n for i, (s, n) in want.items() if n > 20])
    assert off.mean() < 0.05 and off.max() < 0.2


def test_every_bigram_is_entered(spark):
    d = read(spark, "/root/testdata/sf0.001", "documents")
    texts = [r.text for r in d.collect()]
    hot = np.unique(lm.tokens_of(["the of and in"])[0][:-1])
    model = lm.build(lm.count_ngrams(d.select("text"), 16, hot), hot).collect()
    f = lm.Filter({r["slice"]: bytes(r["segment"]) for r in model}, 16)
    t, sizes = lm.tokens_of(texts)
    h = lm.histories(t, sizes)
    keys, first, times = np.unique(lm.bigrams(t, h), return_index=True, return_counts=True)
    assert (times == 1).any() and (f.levels(keys, "bigram", lm.bigram_slices(keys, h[first], hot, 16)) >= lm.level(times, lm.STEP)).all()
    spread = {int(x["k"]) & ((1 << 64) - 1) for r in model for x in r["hot"]}
    assert len(spread) > 2 and spread <= set(hot.tolist()) and sum(len(r["hot"]) for r in model) > 2 * len(spread)
    assert (f.levels(np.setdiff1d(h, hot), "a") > 0).all()


def test_hot_histories_change_no_score(spark, monkeypatch):
    """Nearly every history is hot, or none but the begin: the same levels, in other slices."""
    d = read(spark, "/root/testdata/sf0.01", "documents")
    scores = []
    for often in (4096, 1):
        monkeypatch.setattr(lm, "HOT", often)
        scores.append({r.doc_id: (r.score, r.n_tokens) for r in lm.score(d, 64).collect()})
    off = [abs(s - scores[1][i][0]) / n for i, (s, n) in scores[0].items()]
    assert np.mean(off) < 4e-3 and max(off) < 0.1  # false hits of the filter fall elsewhere
    monkeypatch.setattr(lm, "HOT", 4096)
    assert 5 < len(lm.hot_histories(d.select("text"), 1)) <= 4097 and lm.hot_histories(d.select("text").limit(0)).tolist() == [int(lm.BEGIN)]


def test_histories_that_share_their_upper_half(spark, monkeypatch):
    """Tokens whose hashes agree in their upper halves keep their own successors."""
    own = lm.token_hashes
    few = {int(own(w.encode())[0]): k for k, w in enumerate(("left", "right"))}

    def clashing(raw):
        h = own(raw)
        return np.array([(np.uint64(0x1234567 << 32) | np.uint64(few[int(x)] + 5)) if int(x) in few else x for x in h], np.uint64)

    monkeypatch.setattr(lm, "token_hashes", clashing)
    t, sizes = lm.tokens_of(["left a", "left a", "left b", "right c"] * 2)
    h = lm.histories(t, sizes)
    k, low, c = lm.counted_pairs([lm.bigrams(t, h)], [(h & lm.LOW).astype(np.uint32)])
    names, types = np.unique((k & lm.HIGH) | low, return_counts=True)
    n = dict(zip(names.tolist(), types.tolist()))
    assert n[(0x1234567 << 32) | 5] == 2 and n[(0x1234567 << 32) | 6] == 1
