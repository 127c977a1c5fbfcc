"""Line labelling: plain rules against regular expressions, the field against enumeration and differences, kept texts against labels."""

import itertools
import re
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import line_crf as L

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)"""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    n = Counter(windows)
    at = {k + j for k, w in enumerate(windows) if n[w] > 1 for j in range(3)}
    seen, copies = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            copies += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), copies, len(at)


TEXTS = ["", " \n\t\n", "a b c a b c", "a b\nc a\nb c\n\na b", "x|y #\x0b*\x0c$ \r\n%&<> é\n\n\nx|y #", "Ed " * 50 + "\n" + "é ü\n" * 9, "\n\n\nlast", "one word here \U0001f600", "a\r\nb\r\na\r\n"]


@pytest.mark.parametrize("block", [3, 1 << 20])
def test_rules_by_regular_expressions(odd, monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK", block)
    for t in TEXTS + [r["text"] or "" for r in odd.collect() if block > 3 or len(r["text"] or "") < 999]:
        bins, chars, base = L.measured(t.encode())
        assert base == plain(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert chars.tolist() == [sum(map(len, WORD.findall(x))) for x in lines] and bins.shape == (len(lines), len(L.MEASURES))
        assert not len(bins) or bins.max() < L.BINS


def test_many_kinds_of_words_make_the_same_windows():
    ids = np.array([0, 1, 2, 3, 0, 1, 2, 4, 4, 4, 4])
    assert (L.in_repeats(ids, 5) == L.in_repeats(ids, 1 << 22)).all() and L.in_repeats(ids, 5).tolist() == [True] * 3 + [False] + [True] * 7


def drawn_field(seed):
    rng, f = np.random.default_rng(seed), L.Field()
    f.w, f.t, f.s = rng.normal(size=f.w.shape), rng.normal(size=(2, 2)), rng.normal(size=2)
    return rng, f


def path_score(f, bins, y):
    e = f.emissions(bins)
    return f.s[y[0]] + sum(e[k] * v for k, v in enumerate(y)) + sum(f.t[a, b] for a, b in zip(y, y[1:]))


@pytest.mark.parametrize("seed", range(6))
def test_decoding_and_likelihood_by_enumeration(seed):
    rng, f = drawn_field(seed)
    sequences = [(rng.integers(0, L.BINS, (n, len(L.MEASURES))), rng.integers(0, 2, n)) for n in (1, 2, 5, 8)]
    total = 0.0
    for bins, y in sequences:
        paths = {p: path_score(f, bins, p) for p in itertools.product((0, 1), repeat=len(y))}
        assert tuple(f.decode(bins).astype(int)) == max(paths, key=paths.get)
        total += paths[tuple(y)] - np.log(np.sum(np.exp(list(paths.values()))))
    groups = L.padded(sequences)
    value, dw, dt, ds = f.likelihood(groups)
    assert value == pytest.approx(total)
    for name, grad in (("w", dw), ("t", dt), ("s", ds)):
        for at in itertools.islice(np.ndindex(grad.shape), 12):
            x = getattr(f, name)
            x[at] += 1e-5
            high = f.likelihood(groups)[0]
            x[at] -= 2e-5
            low = f.likelihood(groups)[0]
            x[at] += 1e-5
            assert grad[at] == pytest.approx((high - low) / 2e-5, abs=1e-4)


def test_texts_of_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = labels.join(docs, "doc_id").select("doc_id", "text", "quality")
    rows = L.judge(known.select("doc_id", "text"), labels).join(labels, "doc_id").filter(L.held_out() & ~L.F.col("base_failed")).collect()
    assert len(rows) > 300 and sum(r["kept"] == bool(r["quality"]) for r in rows) > 0.97 * len(rows)
    assert sum(r["kept"] for r in rows if r["quality"]) > 0.98 * sum(r["quality"] for r in rows)


def test_content_lines_and_clashing_columns(spark, odd):
    f = L.Field()
    f.w[L.MEASURES.index("symbols") * L.BINS + 1 : (L.MEASURES.index("symbols") + 1) * L.BINS] = -5.0  # any symbol is boilerplate
    f.s[1] = 1.0
    docs = spark.createDataFrame([(1, "good line\n| # |\n\nmore of it", 9), (1, "good line\n| # |\n\nmore of it", 9), (None, None, 9)], "doc_id long, text string, n_words int")
    rows = L.labelled(docs, f, content=True).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["content"], r["n_lines"], r["n_content_lines"], r["n_words"]) for r in rows] == [(None, "", 0, 0, 0)] + [(1, "good line\nmore of it", 3, 2, 8)] * 2
    assert len(L.labelled(odd, f).columns) == len(odd.columns) + 8 and L.labelled(odd, f).count() == odd.count()


def test_without_labels_only_rules_decide(spark, odd):
    for quality in (None, 0, 1):
        labels = spark.createDataFrame([(k, quality) for k in range(12)], "doc_id long, quality int")
        rows = L.judge(odd, labels).collect()
        assert len(rows) == 13 and all(r["kept"] == (not r["base_failed"]) for r in rows)
    assert L.judge(odd.limit(0), labels).collect() == []
