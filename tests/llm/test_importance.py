"""Importance resampling: scores against plain Python, the draw against a full sort, brackets that miss."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridloom.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest=1):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return [" ".join(words[k : k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)], len(words)


def plain(docs, target, longest=1, cells=10_000):
    where = lambda f: zlib.crc32(f.encode()) % cells
    s, t = (Counter(where(f) for x in texts for f in features(x, longest)[0]) for texts in ([d[1] for d in docs], target))
    ns, nt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ns + cells) / ((s[b] + 1) * (nt + cells))))
    out = []
    for doc, text in docs:
        found, words = features(text, longest)
        weight = sum(gain(where(f)) for f in found)
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append((doc, words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] if r[0] is not None else -1))
    return out, able


@pytest.mark.parametrize("longest", [1, 2])
def test_against_plain_python(spark, odd, longest):
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(50 + k, "The Cat é sat " * (k % 9 + 1)) for k in range(60)] + [(None, "on the mat " * 9)], "doc_id long, text string"))
    target = spark.createDataFrame([("the CAT sat on the mat",), (None,), ("",)], "text string")
    want, able = plain([tuple(r) for r in docs.collect()], ["the cat sat on the mat"], longest)
    got = importance.resample(docs, target, longest=longest).collect()
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"])) for r in got)
    drawn = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, len(able) * 10 // 100 + 1))
    assert [(r["doc_id"], r["score"]) for r in drawn] == [(r[0], r[4]) for r in able[: len(drawn)]]


@pytest.mark.parametrize("sketch", [2, 10, 10_000])
def test_draw_is_a_full_sort(spark, sketch):
    """Many ties, also of whole rows; a coarse sketch gives brackets that must be widened or hold everything."""
    rows = spark.range(4000).select((F.col("id") % 1500).alias("doc_id"), F.lit(30).alias("n_words"), F.lit(30).alias("n_features"), F.col("id").alias("weight"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.pmod(F.xxhash64("id"), F.lit(40))).alias("score"))
    rows = rows.unionByName(rows.filter("doc_id < 50")).unionByName(rows.limit(30).withColumn("n_words", F.lit(19)))
    for part in (0, 1, 10, 55, 100):
        got = importance.drawn(rows, part, 100, sketch=sketch)
        assert got.count() == rows.count()
        able = sorted((-r["score"], r["doc_id"], r["weight"]) for r in rows.filter("n_words >= 20").collect())
        drawn = sorted((r["rank"], -r["score"], r["doc_id"], r["weight"]) for r in got.filter("rank is not null").collect())
        assert [r[0] for r in drawn] == list(range(1, len(able) * part // 100 + 1))
        assert [r[1:] for r in drawn] == able[: len(drawn)]
        assert got.filter("rank is not null and n_words < 20").isEmpty()


def test_a_bracket_that_misses_is_widened(spark, monkeypatch):
    rows = spark.range(10_000).select(F.col("id").alias("score"))
    assert importance.bracket(rows, 10, 100)[0] == 1000
    seen = []
    true = F.percentile_approx

    def off(col, ends, accuracy):  # a sketch that answers far too low until it is asked for all
        seen.append(ends)
        return true(col, [e / 2 if 0 < e < 1 else e for e in ends], accuracy)

    monkeypatch.setattr(importance.F, "percentile_approx", off)
    k, low, high, above = importance.bracket(rows, 10, 100)
    assert len(seen) > 1 and low <= 9000 <= high and above == 9999 - high and above < k == 1000


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, none).collect() == []
    few = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    assert [(r["rank"], r["n_features"]) for r in importance.resample(few, none).orderBy("doc_id").collect()] == [(None, 3), (None, 0)]
