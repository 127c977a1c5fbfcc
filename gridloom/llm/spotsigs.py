"""SpotSigs document fingerprints.

A signature is a common word (anchor) with the chain of the next `chain` content words after it, content words being
those that are no anchors; the set of a document's signatures is its fingerprint. The k-th anchor of a text at word i
has i - k content words before it, so its chain is read from the content array by position: one linear pass with
native array functions. A text without signatures is represented by one hash of itself, so that equal texts, and only
those, are alike.

Likeness is the Jaccard coefficient of two sets. `near_duplicates` collapses equal fingerprints, partitions by set length
so that only sets whose lengths allow the threshold can meet, takes candidates from the rarest signatures of each set
(as many as a pair of that likeness must share one of), and prunes by length before the exact coefficient. The sets of a hot
signature are cut into chunks and met chunk by chunk, so that no task has all of them.

Edge cases: null texts are empty; one row per input row; repeated rows are equal; documents that share an id are ordered
by text; the document after the last is the first, also if it is the only one; extra columns are ignored. `compare_edited` takes
numeric ids, whose order the ranges follow; `fingerprint` and `near_duplicates` take ids of any type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, cut, sha_hex, text_of

#: Common words of English, French, German and Spanish that serve as anchors.
ANCHORS = (
    "a an and are as at be by for from in is it not of on or that the this to was with "
    "au avec ce dans de des du elle en est et il la le les ne pas pour que qui sur un une "
    "auf das dem den der des die ein eine für im ist mit nicht sich sie und von zu "
    "con del el es los no por se su una y"
).split()
CHAIN = 3
#: Sets of a signature and length partition that meet in one cell.
CHUNK = 256


def signatures(text: Column, chain: int = CHAIN, anchors: list[str] | None = None) -> Column:
    """The sorted distinct 64-bit signatures of a text; never empty."""
    known = list(dict.fromkeys(anchors or ANCHORS))
    words = F.filter(F.split(ascii_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), lambda w: w != "")
    parts = F.struct(F.filter(words, lambda w: ~w.isin(known)).alias("content"), F.filter(F.transform(words, lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: x["w"].isin(known)).alias("anchors"))

    def of(p: Column) -> Column:
        at = F.transform(p["anchors"], lambda x, k: F.struct((x["i"] - k).alias("at"), x["w"].alias("w")))
        at = F.filter(at, lambda x: x["at"] + chain <= F.size(p["content"]))
        return F.transform(at, lambda x: F.xxhash64(x["w"], *[F.get(p["content"], x["at"] + j) for j in range(chain)]))

    found = F.element_at(F.transform(F.array(parts), of), 1)
    distinct = F.element_at(F.transform(F.array(F.array_sort(F.array_distinct(found))), lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(F.xxhash64(text)))), 1)
    return distinct


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both.cast("double") / (F.size(a) + F.size(b) - both)


def as_string(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda s: F.lpad(F.lower(F.hex(s)), 16, "0")), " ")


def with_next(docs: DataFrame, buckets: int | None = None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, next_text): each document with the one after it in the order of ids, cyclically.

    Ids are cut into ranges that begin at ids of the table; the rows of the first id of a range are also dealt to the
    range before, so that a window per range sees every successor and the texts are shuffled once.
    """
    rows = docs.select(F.col(doc).alias("doc"), text_of(text).alias("text"))
    n = buckets or 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen = rows.agg(F.min("doc").alias("low"), F.percentile_approx("doc", [k / n for k in range(1, n)], 10_000).alias("starts"), F.max(F.col("doc").isNull()).alias("nulls")).first()
    starts = sorted({x for x in [seen["low"], *(seen["starts"] or [])] if x is not None})
    if seen["nulls"]:
        starts = [None, *starts]
    last = len(starts) - 1
    known = [x for x in starts if x is not None]
    shift = len(starts) - len(known)
    cells = F.array(*[F.lit(x).cast("long") for x in known]) if known else F.expr("cast(array() as array<bigint>)")
    # the number of starts at or below the id, by bisection over the literal array
    steps = max(1, len(known).bit_length())
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0).alias("lo"), F.lit(len(known)).alias("hi")), lambda a, _: F.when(a["lo"] < a["hi"], F.when(F.get(cells, F.floor((a["lo"] + a["hi"]) / 2).cast("int")) <= F.col("doc"), F.struct((F.floor((a["lo"] + a["hi"]) / 2) + 1).cast("int").alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), F.floor((a["lo"] + a["hi"]) / 2).cast("int").alias("hi")))).otherwise(a))["lo"]
    bucket = F.when(F.col("doc").isNull(), F.lit(0)).otherwise(found - 1 + shift)
    rows = rows.withColumn("bucket", bucket)
    first = F.col("doc").isNull() | F.coalesce(F.get(cells, F.col("bucket") - shift) == F.col("doc"), F.lit(False))
    home = F.struct(F.col("bucket").alias("b"), F.lit(0).alias("guest"))
    before = F.struct(F.when(F.col("bucket") == 0, F.lit(last)).otherwise(F.col("bucket") - 1).alias("b"), F.lit(1).alias("guest"))
    dealt = rows.withColumn("x", F.explode(F.when(first, F.array(home, before)).otherwise(F.array(home))))
    order = W.partitionBy("x.b").orderBy("x.guest", F.col("doc").asc_nulls_first(), "text")
    out = dealt.withColumn("next_text", F.lead("text").over(order)).filter("x.guest = 0")
    return out.select(F.col("doc").alias(doc), "text", "next_text")


def fingerprint(docs: DataFrame, chain: int = CHAIN, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, sigs of every row."""
    return docs.select(doc, signatures(text_of(text), chain).alias("sigs"))


def compare_edited(docs: DataFrame, chain: int = CHAIN, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text and of the next text, with their likeness."""
    d = with_next(docs, doc=doc, text=text).withColumn("n_chars", F.length("text").cast("long"))
    half = F.expr("cast(n_chars div 2 as int)")
    d = d.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half)))
    d = d.select(doc, "n_chars", sha_hex(F.col("edited")).alias("edited_sha256"), signatures(F.col("text"), chain).alias("sigs"), signatures(F.col("edited"), chain).alias("edited_sigs"), signatures(F.col("next_text"), chain).alias("next_sigs"))
    return d.withColumn("near_edited", jaccard(F.col("sigs"), F.col("edited_sigs"))).withColumn("near_next", jaccard(F.col("sigs"), F.col("next_sigs")))


def digest(compared: DataFrame, doc: str = "doc_id") -> DataFrame:
    return compared.select(doc, "n_chars", "edited_sha256", as_string(F.col("sigs")).alias("fingerprint"), as_string(F.col("edited_sigs")).alias("edited_fingerprint"), "near_edited", "near_next")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, chain: int = CHAIN, doc: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(membership: doc_id, class; links: a, b, likeness between the classes of different fingerprints).

    A class is named by its smallest id. Work is bound to the partitions of neighbouring lengths: partition p holds sets
    of lengths in [1/threshold**p, 1/threshold**(p+1)), and a pair of the wanted likeness lies in p and p or p + 1.
    """
    sets = cut(fingerprint(docs, chain, doc, text).withColumn("key", F.xxhash64(F.array_join(F.col("sigs").cast("array<string>"), ","))))
    classes = cut(sets.groupBy("key").agg(F.min(doc).alias("class"), F.first("sigs").alias("sigs")))
    member = sets.select(doc, "key").join(classes.select("key", "class"), "key").select(doc, "class")
    size = F.size("sigs")
    c = classes.select("class", "sigs", size.alias("n"), F.floor(F.log(size.cast("double")) / F.log(F.lit(1 / threshold)) + 1e-9).cast("int").alias("p"))
    each = c.select("class", "n", "p", F.explode("sigs").alias("sig"))
    rarity = each.groupBy("sig").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = each.join(rarity, "sig").withColumn("r", F.row_number().over(W.partitionBy("class").orderBy("df", "sig")))
    # a pair of the likeness shares one of the n - ceil(t n) + 1 rarest signatures of each; singletons come first and meet nobody
    alone = c.select("class", "n").join(each.join(rarity, "sig", "left_semi").groupBy("class").agg(F.count("*").alias("shared")), "class").select("class", (F.col("n") - F.col("shared")).alias("single"))
    prefix = ranked.join(alone, "class").filter(F.col("r") + F.col("single") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1).select("class", "n", "p", "sig")
    hosts = prefix.select(F.col("class").alias("a"), F.col("n").alias("na"), "p", "sig")
    guests = prefix.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.explode(F.array("p", F.col("p") - 1)).alias("p"), "sig", F.col("p").alias("pb"))
    # a hot signature's sets are dealt to a square of cells: a host to the cells of its row, a guest to those of its column
    side = guests.groupBy("sig", "p").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("side"))
    span = F.explode(F.sequence(F.lit(0), F.col("side") - 1))
    hosts = hosts.join(side, ["sig", "p"]).withColumn("i", F.pmod(F.xxhash64("a"), "side").cast("int")).withColumn("j", span)
    guests = guests.join(side, ["sig", "p"]).withColumn("j", F.pmod(F.xxhash64("b"), "side").cast("int")).withColumn("i", span)
    pair = hosts.join(guests.drop("side"), ["sig", "p", "i", "j"])
    pair = pair.filter(((F.col("pb") > F.col("p")) | (F.col("a") < F.col("b"))) & (F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb"))).select("a", "b").distinct()
    left, right = classes.select(F.col("class").alias("a"), F.col("sigs").alias("sa")), classes.select(F.col("class").alias("b"), F.col("sigs").alias("sb"))
    links = pair.join(left, "a").join(right, "b").withColumn("likeness", jaccard(F.col("sa"), F.col("sb"))).filter(F.col("likeness") >= threshold)
    return member, links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness")
