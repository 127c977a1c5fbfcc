"""The native operators against plain Python, on the small tables and on odd rows."""

import re

import brute
import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import chat, decontaminate, hilbert, pii, queries, spotsigs
from gridloom.llm.common import read

SF = "/root/testdata/sf0.001"


def pairs(df):
    return [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def docs(spark):
    return read(spark, SF, "documents")


def test_decontamination(spark, docs, odd):
    items = spark.createDataFrame([(1, "cat sat on the mat and the dog sat on the log"), (2, "The the"), (3, None), (10, "sat on the mat and the dog sat on the log near"), (4, "---")], "item_id long, text string")
    for d, b in ((docs, read(spark, SF, "benchmark")), (odd, items)):
        want = sorted(brute.decontaminate(pairs(d), [tuple(r) for r in b.collect()]))
        for most in (200_000, 0):
            got = sorted(tuple(r) for r in decontaminate.digest(decontaminate.find(d, b, max_heads=most)).collect())
            assert got == want
    assert any(w[2] for w in want)


def test_clean(spark, odd):
    items = spark.createDataFrame([(1, "cat sat on the mat and the dog sat on the log")], "item_id long, text string")
    kept = {r.doc_id for r in decontaminate.clean(odd, items).collect()}
    assert kept == {r.doc_id for r in odd.collect()} - {3, 10, 20}
    out = {r.doc_id: r.text for r in decontaminate.clean(odd, items, "span").collect()}
    assert out[3] == "The  near the old red barn." and out[10] == "The  near the old red barn. Again the cat sat."
    assert len(out) == odd.count() and out[0] is None and out[11] == "1.2.3.4.5.6.7.8 000000012.1.1.1 12--34"
    assert decontaminate.clean(odd, items.limit(0)).count() == odd.count() and decontaminate.find(odd.limit(0), items).count() == 0


def test_pii(docs, odd):
    for d in (docs, odd):
        rows = pii.digest(pii.find(d)).collect()
        assert sorted((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows) == sorted(brute.private(pairs(d)))
    assert "iban:" in next(r.spans for r in rows if r.doc_id == 6)
    out = {r.doc_id: r.text for r in pii.redact(odd).collect()}
    assert out[6].startswith("call [PHONE] or mail [EMAIL][EMAIL], card [CARD], ip 10.0.0.256 and [IP]") and out[6].endswith("[IBAN]")
    assert out[0] is None and out[3].startswith("The cat") and pii.redact(odd).columns == odd.columns and pii.redact(odd.limit(0)).count() == 0


def test_chat(spark):
    for rows in (read(spark, SF, "conversations"), spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", "a\\b<|im_end|>\n[INST]\\[INST]<s>"), (1, 2, None, "x"), (2, 0, "assistant", ""), (2, 0, "assistant", "")], "conv_id long, turn long, role string, text string")):
        rows = chat.with_probe(rows)
        got = sorted(tuple(r)[:5] for r in chat.digest(chat.render(chat.fold(chat.events_of(rows)))).collect())
        assert got == sorted(brute.chats([tuple(r) for r in rows.collect()]))


def test_chat_events(spark):
    e = [(1, 1, 1, "open", "user", "hel"), (1, 1, 2, "delta", None, "lo"), (1, 2, 3, "open", "assistant", ""), (1, 2, 4, "delta", None, "bad"), (1, 3, 5, "open", "user", "why"), (1, 2, 6, "regenerate", None, None), (1, 2, 7, "delta", None, "good"), (1, 4, 8, "open", "user", "ok"), (1, 4, 9, "edit", None, "fine"), (1, 4, 10, "delta", None, "!")]
    got = chat.fold(spark.createDataFrame(e, "conv long, msg long, seq long, kind string, role string, text string")).orderBy("msg").collect()
    assert [(r.msg, r.role, r.text) for r in got] == [(1, "user", "hello"), (2, "assistant", "good"), (4, "user", "fine!")]


def test_chat_query_has_every_kind_and_orders_ties(spark, tmp_path):
    """The logs of the query hold edits and regenerations, and rows of one turn and role stand in the order of their texts."""
    texts = ["same", "zeta", "alpha", "", "émile", "same", None, "b|<|im_end|>", "a\\b"]
    rows = spark.createDataFrame([(c, t, role, x) for c in range(6) for t in range(3) for role in ("user", "assistant", None) for x in texts], "conv_id long, turn long, role string, text string")
    rows.write.parquet(f"{tmp_path}/conversations.parquet")
    kinds = {r.kind for r in chat.events_of(rows).select("kind").distinct().collect()}
    assert kinds == {"open", "delta", "edit", "regenerate"}
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    rel = con.execute(queries.ORACLE["op9_chat_format"])
    names = [c[0] for c in rel.description]
    assert sorted(rel.fetchall()) == sorted(tuple(r[c] for c in names) for r in chat.query(spark, str(tmp_path)).collect())


def test_hilbert(spark, docs, odd):
    for d, n in ((docs, 40), (odd, 40), (odd, 5)):
        rows = hilbert.shard(d, n).collect()
        assert sorted((r.doc_id, r["size"], r.text_crc32) for r in rows) == sorted(brute.sizes(pairs(d)))
        by = {}
        for r in rows:
            by.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in by.values()) and all(0 <= s < n for s in by)
        assert max(map(len, by.values())) - min(len(by.get(s, [])) for s in range(n)) <= 1
    assert hilbert.shard(docs.limit(0)).count() == 0


def test_files_are_skipped_on_every_dimension(spark, tmp_path):
    """Files written by shard: of 40, few have statistics that admit a value of any one dimension."""
    import pyarrow.parquet as pq

    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    d.join(hilbert.shard(d).select("doc_id", "shard"), "doc_id").repartition(40, "shard").write.partitionBy("shard").parquet(f"{tmp_path}/out")
    files = {p: pq.ParquetFile(p).metadata for p in (tmp_path / "out").rglob("*.parquet")}
    assert len(files) == 40

    def admitted(column, v):
        hit = 0
        for m in files.values():
            at = [m.schema.names.index(column)]
            stats = [m.row_group(g).column(at[0]).statistics for g in range(m.num_row_groups)]
            hit += any(s.min <= v <= s.max for s in stats)
        return hit

    values = {c: [r[0] for r in d.select(c).distinct().collect() if r[0] is not None] for c in ("lang", "source")}
    mean = {c: np.mean([admitted(c, v) for v in vs]) for c, vs in values.items()}
    chars = d.approxQuantile("n_chars", [0.1, 0.5, 0.9], 0.0)
    mean["n_chars"] = np.mean([admitted("n_chars", v) for v in chars])
    print("files of 40 that admit a value", mean)
    assert mean["source"] < 20 and mean["lang"] < 32 and mean["n_chars"] < 20


def test_name_bounds(spark):
    d = spark.createDataFrame([(w,) for w in ["a"] * 50 + ["b"] * 10 + ["c"] * 10 + ["d"] * 10 + ["e"] * 20] + [(None,)], "s string")
    assert hilbert.name_bounds(d, "s", 8) == ["a", "b", "c", "d"] and hilbert.name_bounds(d, "s", 3) == ["a", "d"] and hilbert.name_bounds(d.limit(0), "s", 4) == []


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2)])
def test_curve_is_continuous(spark, dims, bits):
    cells = spark.range(1 << dims * bits).select(*[(F.shiftright("id", bits * k).bitwiseAND((1 << bits) - 1)).cast("int").alias(f"d{k}") for k in range(dims)])
    path = cells.withColumn("h", hilbert.curve_index([F.col(f"d{k}") for k in range(dims)], bits)).orderBy("h").collect()
    assert [r.h for r in path] == list(range(1 << dims * bits))
    assert all(sum(abs(a[k] - b[k]) for k in range(dims)) == 1 for a, b in zip(path, path[1:]))


def test_spotsigs(spark, docs, odd):
    for d in (docs, odd):
        rows = spotsigs.digest(spotsigs.compare_edited(d)).collect()
        assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == sorted(brute.edited(pairs(d)))
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    print_of = {r.doc_id: r.fingerprint for r in rows}
    assert print_of[3] == print_of[20] and print_of[0] == print_of[1] != print_of[3]
    assert spotsigs.compare_edited(docs.limit(0)).count() == 0


def plain_signatures(text):
    """Chains of content words after each anchor, hashed one word upon the other."""
    known = set(spotsigs.ANCHORS)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lower(text))
    out = set()
    for i, w in enumerate(words):
        if w in known:
            chain = [x for x in words[i + 1 :] if x not in known][: spotsigs.CHAIN]
            if len(chain) == spotsigs.CHAIN:
                h = 42
                for x in (w, *chain):
                    h = xxhash.xxh64_intdigest(x.encode(), h)
                out.add(h)
    return out or {xxhash.xxh64_intdigest(text.encode(), 42)}


def test_spotsigs_fingerprints_and_likeness(spark, docs, odd):
    for d in (docs, odd):
        texts = sorted(((i, t or "") for i, t in pairs(d)), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        want = []
        for k, (i, t) in enumerate(texts):
            after = texts[(k + 1) % len(texts)][1]
            half = len(t) // 2
            sets = [plain_signatures(x) for x in (t, t[: len(t) - half] + after[:half], after)]
            signed = [sorted(s - (1 << 64) if s >> 63 else s for s in x) for x in sets[:2]]
            like = [len(sets[0] & x) / len(sets[0] | x) for x in sets[1:]]
            want.append((i, *[" ".join(f"{s % (1 << 64):016x}" for s in x) for x in signed], *like))
        got = [(r.doc_id, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in spotsigs.digest(spotsigs.compare_edited(d)).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_spotsigs_pairs(spark):
    base = [f"w{k}" if k % 3 else "the" for k in range(300)]
    near = [*base[:150], "zz", *base[151:]]
    texts = [" ".join(base), " ".join(near), " ".join(base), " ".join(f"v{k}" if k % 3 else "of" for k in range(300)), "", None]
    member, links = spotsigs.near_duplicates(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"), 0.8)
    assert {(r.doc_id, r["class"]) for r in member.collect()} == {(0, 0), (1, 1), (2, 0), (3, 3), (4, 4), (5, 4)}
    assert {(r.a, r.b) for r in links.collect()} == {(0, 1)}


@pytest.mark.parametrize("chunk", [256, 3])
def test_spotsigs_near_duplicates_are_those_of_all_pairs(spark, monkeypatch, chunk):
    """Links of every pair of classes against the plain likeness of all pairs, with hot signatures over many cells."""
    monkeypatch.setattr(spotsigs, "CHUNK", chunk)
    words = [f"w{k}" for k in range(120)]
    near = [(10_000 + n, "the " + " and ".join("x" if k == n else w for k, w in enumerate(words))) for n in range(0, 120, 6)]
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    member, links = spotsigs.near_duplicates(d, 0.8)
    classes = {r.doc_id: r["class"] for r in member.collect()}
    sigs = {r.doc_id: frozenset(r.sigs) for r in spotsigs.fingerprint(d).collect()}
    assert all(classes[i] == min(j for j in sigs if sigs[j] == s) for i, s in list(sigs.items())[::25])
    own = sorted({c: sigs[c] for c in set(classes.values())}.items())
    want = set()
    for k, (a, x) in enumerate(own):
        for b, y in own[k + 1 :]:
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and (both := len(x & y)) >= 0.8 * (len(x) + len(y) - both):
                want.add((a, b))
    got = {(r.a, r.b): r.likeness for r in links.collect()}
    assert set(got) == want and len(want) > 100


def test_bounds_of_many_strings_count_every_row(spark, monkeypatch):
    monkeypatch.setattr(hilbert, "NAMES", 10)
    # one value holds half of the rows; among a sample of ten others it may be missing
    rows = [(f"v{k:03d}",) for k in range(100) for _ in range(100 if k == 37 else 1)] + [(None,)]
    n = {}
    for (v,) in rows[:-1]:
        n[v] = n.get(v, 0) + 1
    run, want, total = 0, [], len(rows) - 1
    for v in sorted(n):
        before, run = run, run + n[v]
        if run * 8 // total > before * 8 // total and run < total:
            want.append(v)
    assert hilbert.name_bounds(spark.createDataFrame(rows, "s string"), "s", 8) == want and "v037" in want
