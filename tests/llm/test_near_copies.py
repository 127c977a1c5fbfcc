"""The pipeline's near-duplicate stage against a brute-force Jaccard join on five-word shingles."""

import re

from gridloom.llm.common import read


def components(docs, k=5, least=0.8):
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if min(len(a), len(b)) < least * max(len(a), len(b)):
                continue
            both = len(a & b)
            if both >= least * (len(a) + len(b) - both):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        low[find(i)] = min(d, low.get(find(i), d))
    return set(low.values())


def test_stage_finds_edited_copies(spark, odd, monkeypatch):
    import corpus_pipeline
    from gridloom.llm import near_copies

    words = [f"w{i}" for i in range(300)]
    edited = [(100 + n, " ".join("x" if i % 100 == n else w for i, w in enumerate(words)), "en", "s", 1, *["x"] * (len(odd.columns) - 5)) for n in range(30)]
    small = odd.unionByName(odd.sparkSession.createDataFrame(edited, odd.schema))
    for d in (read(spark, "/root/testdata/sf0.01", "documents"), small):
        for most in (near_copies.PAIRS, 1):
            monkeypatch.setattr(near_copies, "PAIRS", most)
            monkeypatch.setattr(near_copies, "CHUNK", 4 * most)
            monkeypatch.setattr(near_copies, "MOST", 1 << 28 if most > 1 else 1)
            out = corpus_pipeline.near_duplicates(spark, d, "")
            assert out.columns == d.columns
            assert {r.doc_id for r in out.collect()} == components([(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()])
    assert corpus_pipeline.near_duplicates(spark, odd.limit(0), "").count() == 0


def test_different_texts_of_one_id_both_stay(spark):
    from gridloom.llm import simhash_vp

    words = [" ".join(f"{x}{i}" for i in range(60)) for x in "abc"]
    d = spark.createDataFrame([(1, words[0]), (1, words[1]), (2, words[0]), (None, words[2]), (None, words[1]), (1, words[0])], "doc_id long, text string")
    for least in (None, 0.8):
        kept = [tuple(r) for r in simhash_vp.deduplicated(d, least=least).collect()]
        assert sorted(kept, key=str) == sorted([(1, words[0]), (1, words[1]), (None, words[2])], key=str)


def test_bitmap_misses_no_name_and_marks_few_others(spark):
    from pyspark.sql import functions as F

    from gridloom.llm.near_copies import marked

    rows = spark.range(40000).select(F.xxhash64("id").alias("node"), "id").unionByName(spark.createDataFrame([(0, -1), (-1, -2), (2**63 - 1, -3), (-(2**63), -4)], "node long, id long"))
    hit = marked(rows, rows.filter("id % 2 = 0").select("node"), "node", "hit")
    assert hit.columns == ["node", "id", "hit"]
    assert hit.filter("id % 2 = 0 and not hit").count() == 0
    assert hit.count() == 40004 and hit.filter("id % 2 <> 0 and hit").count() < 0.15 * 20002
    assert marked(rows, rows.limit(0).select("node"), "node", "hit").filter("hit").count() == 0


def test_repeats_and_null_ids_of_one_group(spark):
    from gridloom.llm import simhash_vp

    words = " ".join(f"w{i}" for i in range(60))
    d = spark.createDataFrame([(None, words), (None, words), (None, "alone"), (None, ""), (None, None), (7, words), (7, words), (9, "b"), (9, "b")], "doc_id long, text string")
    for least in (None, 0.8):
        kept = sorted((tuple(r) for r in simhash_vp.deduplicated(d, least=least).collect()), key=str)
        assert [(i, t or "") for i, t in kept] == sorted([(7, words), (9, "b"), (None, "alone"), (None, "")], key=str)


def test_texts_whose_names_clash_both_stay(spark, monkeypatch):
    from pyspark.sql import functions as F

    from gridloom.llm import near_copies, simhash_vp

    words = [" ".join(f"{x}{i}" for i in range(60)) for x in "abc"]
    d = spark.createDataFrame([(k, w) for k, w in enumerate([*words, words[0], words[1] + " more"])], "doc_id long, text string")
    own = F.xxhash64
    # the first name of a text is the same for all, a second name tells them apart
    monkeypatch.setattr(near_copies.F, "xxhash64", lambda *c: F.lit(7).cast("long") if len(c) == 1 and "text" in str(c[0]) else own(*c))
    for most in (1000, 0):
        monkeypatch.setattr(near_copies, "SHARED", most)
        assert d.select(near_copies.text_name(d, "text").alias("n")).distinct().count() == 4
        for least in (None, 0.8):
            kept = simhash_vp.deduplicated(d, least=least).collect()
            assert {r.doc_id for r in kept} <= {0, 1, 2, 4} and {r.doc_id for r in kept} >= {0, 1, 2}


def test_chunk_pairs_meet_all_texts_of_different_roots(spark, monkeypatch):
    from gridloom.llm import near_copies

    monkeypatch.setattr(near_copies, "CHUNK", 3)
    rows = [(k, n, n if n % 5 else 1) for k in (1, 2) for n in range(10 * k, 10 * k + 25)]
    groups = {}
    for r in near_copies.chunk_pairs(spark.createDataFrame(rows, "key long, node long, root long")).collect():
        groups.setdefault(r.group, set()).add(r.node)
    met = {(a, b) for g in groups.values() for a in g for b in g}
    root = {(k, n): r for k, n, r in rows}
    for k in (1, 2):
        own = [n for j, n, _ in rows if j == k]
        assert all((a, b) in met for a in own for b in own if root[k, a] != root[k, b])
    assert max(map(len, groups.values())) <= 6


def test_candidates_come_from_the_tree(spark, monkeypatch):
    """Without its links no edited copy is found."""
    import corpus_pipeline
    from gridloom.llm import simhash_vp

    d = read(spark, "/root/testdata/sf0.01", "documents").dropDuplicates(["text"])
    n = d.count()
    assert corpus_pipeline.near_duplicates(spark, d, "").count() < n
    own = simhash_vp.set_links
    monkeypatch.setattr(simhash_vp, "set_links", lambda *a: own(*a).limit(0))
    assert corpus_pipeline.near_duplicates(spark, d, "").count() == n


def test_the_tree_of_sets_finds_all_links(spark, monkeypatch):
    """Every pair within the bits and sizes of a link ends in one component, also from leaves that are dealt in chunks."""
    import numpy as np

    from gridloom.llm import simhash_vp as sv

    rng = np.random.default_rng(4)
    sets = [rng.integers(0, 1 << 63, n, np.uint64) for n in rng.integers(1, 400, 300)]
    for i in range(0, 200, 2):  # parts of sets, some of them too small to link
        sets[i] = sets[i + 1][: max(1, int(len(sets[i + 1]) * rng.uniform(0.7, 1)))]
    prints = np.array([sv.set_fingerprint(s) for s in sets])
    rows = [(k, len(s), *p.view(np.int64).tolist()) for k, (s, p) in enumerate(zip(sets, prints))]
    df = spark.createDataFrame(rows, "node long, n long, " + ", ".join(f"w{j} long" for j in range(sv.WORDS)))
    bits = np.bitwise_count(prints[:, None] ^ prints[None])
    size = np.array([len(s) for s in sets])
    near = (bits.sum(2) <= sv.WIDE) & (bits[:, :, 0] <= sv.FIRST) & (np.minimum.outer(size, size) >= 0.8 * np.maximum.outer(size, size))
    assert all(near[i, i + 1] for i in range(0, 200, 2) if len(sets[i]) >= 0.8 * len(sets[i + 1])) and near.sum() > 400
    for leaf in (sv.LEAF, 7):
        monkeypatch.setattr(sv, "LEAF", leaf)
        root = list(range(len(sets)))
        find = lambda i: i if root[i] == i else find(root[i])
        for r in sv.set_links(df, 0.8).collect():
            root[find(r.a)] = find(r.b)
        assert all(find(int(i)) == find(int(j)) for i, j in zip(*np.nonzero(near)))
        assert len({find(i) for i in range(len(sets))}) > 150
