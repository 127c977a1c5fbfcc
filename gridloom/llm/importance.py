"""Importance resampling towards a target distribution: scores by hashed features, the draw by bracketing its cutoff.

Words, or runs of words, are hashed to a fixed number of buckets. Two additive count tables, of the documents and of the
target, give each bucket a gain: the smoothed log ratio of its shares, in thousandths. A document's weight is the sum of its
features' gains, taken from one array of gains by the array of its buckets; with Gumbel noise from the hash of its id, the
highest scores are a draw without replacement in proportion to the weights.

The draw needs no sort of all rows. A quantile sketch proposes a bracket of scores around the cutoff, exact counts of the rows
above and inside say whether the cutoff is in it (if not, it is widened, at last to all scores), and only the bracket is
sorted to find it. The rows above are sorted apart, as their ranks are part of the result.

What the driver holds is one count a bucket. Sorts are range partitions on (score, id), so that a hot score is split by id.

Edge cases: null and empty texts have no features and weight 0; documents with fewer than `least` words are scored and never
drawn; a null id is hashed as an empty one; equal scores go by the smaller id, nulls first; rows that also repeat an id each
take a rank; an empty target gives the gains of its smoothing; an empty table gives an empty one; other columns are left out.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .hilbert import ranked

CELLS, LONGEST, SEED = 10_000, 1, "2024"
#: Precision of the sketch: ranks are off by at most one part in so many.
SKETCH = 10_000
#: Bytes that are letters, digits or part of a longer code point stay, A-Z become a-z; every other byte parts words.
WORD_BYTES = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def buckets(raw: bytes | None, longest: int = LONGEST, cells: int = CELLS) -> tuple[np.ndarray, int]:
    """(bucket of each run of 1 to `longest` words, number of words)."""
    words = (raw or b"").translate(WORD_BYTES).split()
    runs = list(words)
    for n in range(2, longest + 1):
        runs += [b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)]
    return np.fromiter(map(crc32, runs), np.uint32, len(runs)) % np.uint32(cells), len(words)


def counted(docs: DataFrame, text: str = "text", longest: int = LONGEST, cells: int = CELLS) -> np.ndarray:
    """How often each bucket occurs in all texts: an array a task, merged by bucket; `cells` rows at most come to the driver."""

    def run(batches):
        held = np.zeros(cells, np.int64)
        for b in batches:
            for t in b.column(0):
                held += np.bincount(buckets(t.as_py(), longest, cells)[0], minlength=cells)
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(held[used])], ["bucket", "n"])

    parts = docs.select(F.col(text).cast("string").cast("binary").alias("__t")).mapInArrow(run, "bucket int, n long")
    out = np.zeros(cells, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, floored."""
    cells, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (s + cells) / ((float(a) + 1) * (t + cells)))) for a, b in zip(source, target)], np.int64)


def scored(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, seed: str = SEED, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_words, n_features, weight, score): the weight plus Gumbel noise in thousandths, by the hash of seed and id."""
    kind, cells = dict(docs.dtypes)[doc], len(gain)
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def run(batches):
        gain = shared.value
        for b in batches:
            rows = []
            for t in b.column(1):
                at, words = buckets(t.as_py(), longest, cells)
                rows.append((words, len(at), int(gain[at].sum())))
            found = np.array(rows, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(found[:, k]) for k in range(3)]], [doc, "n_words", "n_features", "weight"])

    rows = docs.select(doc, F.col(text).cast("string").cast("binary").alias("__t")).mapInArrow(run, f"`{doc}` {kind}, n_words long, n_features long, weight long")
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long"))


def bracket(rows: DataFrame, part: int, whole: int, score: str = "score", sketch: int = SKETCH) -> tuple[int, int, int, int] | None:
    """(k, low, high, above) for the floor(part n / whole) highest scores: the k-th is in [low, high], `above` rows score higher.

    A sketch proposes the bracket, exact counts outside it decide; a bracket that misses the cutoff is widened eightfold, and the
    last one spans all scores, so the loop ends. None if nothing is to be drawn.
    """
    share, margin = 1 - part / whole, 2 / sketch
    while True:
        ends = [max(0.0, share - margin), min(1.0, share + margin)]
        seen = rows.agg(F.count("*").alias("n"), F.percentile_approx(score, ends, sketch).alias("q"), F.min(score).alias("min"), F.max(score).alias("max")).first()
        k = seen["n"] * part // whole
        if k < 1:
            return None
        low = seen["q"][0] if ends[0] > 0 else seen["min"]
        high = seen["q"][1] if ends[1] < 1 else seen["max"]
        out = rows.agg(F.count_if(F.col(score) > high).alias("above"), F.count_if(F.col(score) < low).alias("below")).first()
        if out["above"] < k <= seen["n"] - out["below"]:
            return k, low, high, out["above"]
        margin *= 8


def drawn(rows: DataFrame, part: int = 10, whole: int = 100, least: int = 20, doc: str = "doc_id", sketch: int = SKETCH) -> DataFrame:
    """`rows` with `rank` (1 for the highest score, ties to the smaller id) of the draw; null for rows outside it.

    Reads `rows` several times: pass a stored table.
    """
    cols = [*rows.columns]
    able = F.col("n_words") >= least
    found = bracket(rows.filter(able), part, whole, "score", sketch)
    none = F.lit(None).cast("long")
    if found is None:
        return rows.withColumn("rank", none)
    k, low, high, above = found
    inside = able & F.col("score").between(low, high)
    order = ["__down", doc, "weight", "n_features"]
    sort = lambda part: ranked(part.withColumn("__down", -F.col("score")), order).withColumn("__r", F.col("rank")).drop("rank")
    first = sort(rows.filter(able & (F.col("score") > high))).select(*cols, (F.col("__r") + 1).cast("long").alias("rank"))
    near = sort(rows.filter(inside)).select(*cols, F.when(F.col("__r") < k - above, F.col("__r") + 1 + above).cast("long").alias("rank"))
    rest = rows.filter(~able | (F.col("score") < low)).select(*cols, none.alias("rank"))
    return first.unionByName(near).unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, part: int = 10, whole: int = 100, least: int = 20, longest: int = LONGEST, cells: int = CELLS, seed: str = SEED, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_features, weight, score, rank, n_words): the `part` in `whole` of the documents that most resemble the target, drawn with noise."""
    gain = gains(counted(docs, text, longest, cells), counted(target, "text", longest, cells))
    rows = stored(scored(docs, gain, longest, seed, doc, text))
    return drawn(rows, part, whole, least, doc).select(doc, "n_features", "weight", "score", "rank", "n_words")
