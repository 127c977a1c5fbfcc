"""Fill-in-middle: the skip list against running sums, the operator against a plain rewriting."""

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import fim


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=600))
def test_every_rank_is_reached_exactly(widths):
    nodes, run = fim.SkipList(np.array(widths, np.int64)), np.concatenate([[0], np.cumsum(widths)]).astype(int)
    assert [nodes.before(k) for k in range(len(widths) + 1)] == run.tolist()


def test_lanes_thin_out_and_carry_both_widths():
    widths = np.arange(1, 20_001)
    lanes = fim.SkipList(widths).lanes
    assert len(lanes) > 4
    for units, points, _ in lanes:
        at = np.cumsum(units)
        assert (np.cumsum(points) == np.cumsum(widths)[at - 1]).all()
    for low, high in zip(lanes, lanes[1:]):
        assert len(high[0]) < 0.5 * len(low[0])


def test_widths_are_those_of_the_pattern():
    for t in ("", "\n", "a", "a\n", "\n\nb", "é\n\U0001f600x\n\r\n y"):
        assert fim.line_widths(t).tolist() == [len(x) for x in re.findall(r"[^\n]*\n|[^\n]+", t)]


def plain(text, doc):
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, h = len(lines), hashlib.sha256(f"7:{doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or re.search("<[PSM]>", text):
        return n, "plain", None, None, text
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_against_a_plain_rewriting(spark, odd):
    more = spark.createDataFrame([(100 + k, t) for k, t in enumerate(["a <P> b\nc", "<S", "<S>\n", "x<\n<S\n>M>\n", "\n\n\n", "a\nb\nc\nd", "<\n" * 40, "<P\n" * 30, None])] + [(None, "a\nb\n")], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(more)
    out = fim.transform(docs)
    got = out.withColumn("back", fim.restored(out["output"], out["form"])).collect()
    texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    assert len(got) == len(texts)
    want = sorted(str((d, *plain(t, "" if d is None else d), t)) for d, t in texts)
    assert sorted(str(tuple(r)) for r in got) == want
    assert {"plain", "psm", "spm"} == {r["form"] for r in got}


def test_rates(spark, odd):
    assert {r["form"] for r in fim.transform(odd, rate=0).collect()} == {"plain"}
    assert {r["form"] for r in fim.transform(odd, spm=0).collect()} <= {"plain", "psm"}
    assert fim.digest(fim.transform(odd.limit(0))).collect() == []
