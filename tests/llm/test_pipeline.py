"""The pipeline's stages, each on its own input."""

import brute
from test_near_copies import components

from gridloom.llm.common import read

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    import corpus_pipeline

    docs = read(spark, SF, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        kept[name] = rows
        if name != "tokens":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(rows, docs.schema)
    ids = {k: {r.doc_id for r in v} for k, v in kept.items()}
    low = {r.doc_id for r in read(spark, SF, "labels").filter("quality = 0").collect()}
    good = {r.doc_id for r in read(spark, SF, "labels").filter("quality = 1").collect()}
    assert len(ids["quality"] & good) > 0.97 * len(good) and len(ids["quality"] & low) < 0.2 * len(low)
    assert ids["near_duplicates"] == components([(r.doc_id, r.text) for r in kept["quality"]])  # five words, 0.8
    items = [tuple(r) for r in read(spark, SF, "benchmark").collect()]
    assert ids["decontamination"] == {d for d, *_, bad in brute.decontaminate([(r.doc_id, r.text) for r in kept["near_duplicates"]], items) if not bad}
    assert ids["personal_data"] == ids["decontamination"] == ids["tokens"]
    assert not any(sum(x[1:5]) for x in brute.private([(r.doc_id, r.text) for r in kept["personal_data"]]))
    text = {r.doc_id: r.text for r in kept["personal_data"]}
    assert all(len(r.ids) == r.n_tokens and brute.sha(",".join(map(str, r.ids))) == r.ids_sha256 for r in kept["tokens"])
    assert all(r.decoded_sha256 == brute.sha(text[r.doc_id] or "") for r in kept["tokens"])


def test_run(spark):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_stages_keep_clashing_columns_and_all_rows(spark, odd):
    """Columns with the operators' own names, and one id with two texts."""
    import corpus_pipeline

    twin = odd.filter("doc_id = 6").selectExpr("cast(5 as long) as doc_id", *odd.columns[1:])
    docs = odd.unionByName(twin)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        rows = out.collect()
        assert out.columns == docs.columns and all(r[c] == f"own {c}" for r in rows for c in docs.columns[5:])
        if name == "personal_data":
            assert len(rows) == docs.count()
        if name == "near_duplicates":
            assert sorted(r.doc_id for r in rows if r.doc_id in (5, 6)) == [5, 5]
