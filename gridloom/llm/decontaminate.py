"""Benchmark decontamination: a broadcast set of normalised test n-grams against all training windows.

Words are maximal runs of digits, lower-cased A-Z and every code point from U+0080 on. A window is `n` consecutive
words of an item, or the whole item where it has fewer (but some) words.

Plan: one scan of the documents. Inside each row, native array functions hash the first words of every window and
probe a set of window heads that is part of the plan (its size is checked). The few positions that pass are
exploded and verified word by word by a broadcast hash join on the window text; one narrow shuffle gathers the
hits of a row. Beyond `max_heads` distinct heads every window is exploded and joined by Spark's own choice of join.

Edge cases: null and empty texts have no words and are clean; items without words are ignored; an n-gram shared by
several items counts for each; repeated documents (same doc_id) each keep a row; extra columns are ignored by
`find` and kept by `clean`. Empty tables give empty or all-clean results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, sha_hex, text_of

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
HEAD = 4


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def item_windows(benchmark: DataFrame, n: int = 10, item: str = "item_id", text: str = "text") -> DataFrame:
    """(gram, len, items): each distinct window of the items, with the sorted ids of the items that hold it."""
    w = benchmark.select(F.col(item).alias("item"), words_of(text_of(text)).alias("w")).filter(F.size("w") > 0)
    w = w.withColumn("len", F.least(F.size("w"), F.lit(n)))
    w = w.select("item", "w", "len", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("i"))
    w = w.select("item", "len", F.array_join(F.slice("w", F.col("i"), F.col("len")), " ").alias("gram"))
    return w.groupBy("gram", "len").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _head(get, length: int) -> Column:
    return F.xxhash64(*[get(k) for k in range(min(HEAD, length))])


def _in_heads(probe: list[int], length: int):
    return lambda i: _head(lambda k: F.get(F.col("w"), i + k), length).isin(probe)


def _at_length(length: int):
    return lambda i: F.struct(i.alias("i"), F.lit(length).alias("len"))


def find(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_heads: int = 200_000, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_words, spans (merged hit word ranges [s, e)), n_hit, items."""
    windows = item_windows(benchmark, n).cache()
    heads = windows.withColumn("w", F.split("gram", " "))
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect())  # n values at most
    n_heads = windows.count()
    base = docs.select(F.col(doc).alias("doc"), F.monotonically_increasing_id().alias("uid"), F.xxhash64(text).alias("text_hash"), words_of(text_of(text)).alias("w"))
    base = base.withColumn("n_words", F.size("w").cast("long"))
    none = F.expr("cast(array() as array<struct<i:int,len:int>>)")
    found = [none]
    for length in lengths:
        positions = F.when(F.size("w") >= length, F.sequence(F.lit(0), F.size("w") - length)).otherwise(F.expr("cast(array() as array<int>)"))
        if n_heads <= max_heads:
            of_length = heads.filter(F.col("len") == length).select(_head(lambda k: F.get("w", F.lit(k)), length).alias("h")).distinct()
            probe = [r[0] for r in of_length.limit(max_heads + 1).collect()]  # bounded by the check above
            positions = F.filter(positions, _in_heads(probe, length))
        found.append(F.transform(positions, _at_length(length)))
    hits = base.withColumn("c", F.explode_outer(F.concat(*found)))
    hits = hits.select("doc", "uid", "text_hash", "n_words", F.col("c.i").alias("i"), F.col("c.len").alias("len"), F.array_join(F.expr("slice(w, c.i + 1, c.len)"), " ").alias("gram"))
    known = windows if n_heads > max_heads else F.broadcast(windows)
    hits = hits.join(known.withColumnRenamed("len", "wlen"), "gram", "left")
    hit = F.when(F.col("items").isNotNull(), F.struct("i", F.col("len")))
    out = hits.groupBy("uid").agg(
        F.first("doc").alias(doc), F.first("text_hash").alias("text_hash"), F.first("n_words").alias("n_words"), F.array_sort(F.collect_set(hit)).alias("hit"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")
    )
    spans = F.aggregate(
        "hit",
        F.expr("cast(array() as array<struct<s:int,e:int>>)"),
        lambda a, h: F.when(
            (F.size(a) > 0) & (F.element_at(a, -1)["e"] >= h["i"]),
            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["s"].alias("s"), F.greatest(F.element_at(a, -1)["e"], h["i"] + h["len"]).alias("e")))),
        ).otherwise(F.concat(a, F.array(F.struct(h["i"].alias("s"), (h["i"] + h["len"]).alias("e"))))),
    )
    out = out.withColumn("spans", F.when(F.size("hit") > 0, spans).otherwise(F.expr("cast(array() as array<struct<s:int,e:int>>)")))
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["e"] - s["s"])
    return out.select(doc, "n_words", "spans", total.alias("n_hit"), "items", "text_hash")


def digest(found: DataFrame, doc: str = "doc_id") -> DataFrame:
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(doc, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), sha_hex(F.array_join(ids, ",")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the hit words and what stands between them; one space is left for each run."""
    words = F.regexp_extract_all(text, F.lit(ANY_CASE_WORD), F.lit(0))
    gaps = F.split(text, ANY_CASE_WORD, -1)
    tail = F.struct(F.size(words).alias("s"), F.size(words).alias("e"))
    before = F.concat(F.array(F.struct(F.lit(0).alias("s"), F.lit(0).alias("e"))), spans)
    after = F.concat(spans, F.array(tail))
    piece = F.zip_with(before, after, lambda p, q: F.array_join(F.zip_with(F.slice(words, p["e"] + 1, q["s"] - p["e"]), F.slice(gaps, p["e"] + 2, q["s"] - p["e"]), lambda w, g: F.concat(w, g)), ""))
    return F.concat(F.element_at(gaps, 1), F.array_join(piece, " "))


def clean(docs: DataFrame, benchmark: DataFrame, mode: str = "document", n: int = 10, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with contaminated documents removed (mode "document") or their hit words cut out (mode "span")."""
    name, hashed, spans = (fresh(docs, c) for c in ("hit_doc", "hit_hash", "hit_spans"))
    hit = find(docs, benchmark, n, doc=doc, text=text).filter("n_hit > 0").groupBy(F.col(doc).alias(name), F.col("text_hash").alias(hashed)).agg(F.first("spans").alias(spans))
    same = F.col(doc).eqNullSafe(F.col(name)) & (F.xxhash64(F.col(text)) == F.col(hashed))
    if mode == "document":
        return docs.join(hit, same, "left_anti")
    cut = F.when(F.col(spans).isNotNull(), without_spans(F.col(text), F.col(spans))).otherwise(F.col(text))
    return docs.join(hit, same, "left").withColumn(text, cut).select(*docs.columns)
