"""Quality classifier: a factorisation machine over hashed words, structure statistics and length.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)), linear in the features that a
text has. Words are lowered runs of non-blank bytes, hashed to `1 << BITS` cells, weighted by damped counts and
scaled to unit length; the structure statistics and the length (the only metadata used) are bucketed
into cells of their own. Language, source, ids and labels are never inputs of a score.

Training takes a bounded sample of the labelled rows (`SAMPLE`, those with the smallest hash of the id), turned into
sparse features on the executors; the model is fitted by AdaGrad on the driver and broadcast (a fixed size). Scoring is one
map over all rows.

Edge cases: null and empty texts are scored by their (empty) structure; without labels of both classes every score is
the share of good labels, or 0.5 without any; repeated rows score alike; a label that is null is left out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

BITS, RANK, EPOCHS, BATCH, SAMPLE = 16, 6, 6, 64, 12_000
#: Cells (of 8 bytes) of a row that the machine is fitted on.
MOST = 2048
STATS = 16
CELLS = (1 << BITS) + STATS * 16


def statistics(raw: bytes, words: list[bytes], kinds: int) -> list[float]:
    """Shares in [0, 1]: letters in upper case, digits, marks, pipes, blanks, line ends, distinct words, ..."""
    n, w = max(1, len(raw)), max(1, len(words))
    b = np.frombuffer(raw, np.uint8)
    count = np.bincount(b, minlength=256)
    upper, low, digits = count[65:91].sum(), count[97:123].sum(), count[48:58].sum()
    marks = count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum()
    mean = sum(map(len, words)) / w
    return [
        upper / max(1, upper + low), digits / n, marks / n, count[124] / w, count[10] / w, kinds / w, min(1, mean / 20), min(1, len(raw).bit_length() / 20),
        min(1, len(words).bit_length() / 16), count[33] / w, (count[35] + count[36] + count[37] + count[38] + count[42]) / w, count[46] / w, count[44] / w, count[128:].sum() / n,
        max(map(len, words), default=0) / n, (count[60] + count[62] + count[123] + count[125]) / w,
    ]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    crc = zlib.crc32
    cells, counts = np.unique(np.fromiter(map(crc, words), np.uint32, len(words)) & np.uint32((1 << BITS) - 1), return_counts=True)
    x = np.sqrt(counts).astype(np.float32)
    x /= max(1.0, float(np.sqrt((x * x).sum())))
    stats = np.minimum(np.array(statistics(raw, words, len(cells))), 1.0)
    at = (1 << BITS) + np.arange(STATS) * 16 + np.minimum(15, (np.sqrt(stats) * 16).astype(np.int64))
    return np.concatenate([cells.astype(np.int32), at.astype(np.int32)]), np.concatenate([x, np.full(STATS, 0.5, np.float32)])


def heaviest(cells: np.ndarray, x: np.ndarray, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """At most `most` cells, the structure statistics among them; of the words those of the largest weights, then of the smallest cells."""
    if len(cells) <= most:
        return cells, x
    words = np.lexsort((cells[:-STATS], -x[:-STATS]))[: most - STATS]
    at = np.append(np.sort(words), np.arange(len(cells) - STATS, len(cells)))
    return cells[at], x[at]


class Machine:
    def __init__(self, seed: int = 5):
        self.w0, self.w = 0.0, np.zeros(CELLS, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (CELLS, RANK)).astype(np.float32)

    def parts(self, idx: np.ndarray, x: np.ndarray, starts: np.ndarray):
        vx = self.v[idx] * x[:, None]
        s = np.add.reduceat(vx, starts)
        linear = np.add.reduceat(self.w[idx] * x, starts)
        return self.w0 + linear + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), starts)), s, vx

    def scores(self, idx: np.ndarray, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.parts(idx, x, starts)[0].astype(np.float64), -30, 30)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.1, decay: float = 1e-5) -> "Machine":
        share = float(y.mean()) if len(y) else 0.5
        self.w0 = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
        if share in (0.0, 1.0) or not len(y):
            self.v[:] = 0
            return self
        rng, gw, gv, g0 = np.random.default_rng(3), np.full(CELLS, 1e-6, np.float32), np.full((CELLS, RANK), 1e-6, np.float32), 1e-6
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                part = order[at : at + BATCH]
                idx, x, starts = flat([rows[k] for k in part])
                z, s, vx = self.parts(idx, x, starts)
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]).astype(np.float32) / len(part)
                row = np.repeat(np.arange(len(part)), np.diff(np.append(starts, len(idx))))
                each = error[row] * x
                cells, inverse = np.unique(idx, return_inverse=True)
                dw = np.bincount(inverse, each, len(cells)).astype(np.float32) + decay * self.w[cells]
                full = each[:, None] * (s[row] - vx)
                dv = np.stack([np.bincount(inverse, full[:, f], len(cells)) for f in range(RANK)], 1).astype(np.float32) + decay * self.v[cells]
                gw[cells] += dw * dw
                gv[cells] += dv * dv
                g0 += float(error.sum()) ** 2
                self.w[cells] -= rate * dw / np.sqrt(gw[cells])
                self.v[cells] -= 0.2 * rate * dv / np.sqrt(gv[cells])
                self.w0 -= rate * float(error.sum()) / g0**0.5
        return self


def flat(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(r[0]) for r in rows])
    return np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.cumsum(sizes) - sizes


def held_out(doc: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc: str = "doc_id", text: str = "text") -> Machine:
    """The machine fitted on at most `sample` rows that aren't held out, of at most `sample` labelled ids: rows that repeat an id count
    as one, that of the smallest hash. For training, a row brings its `MOST` heaviest cells at most, so the driver gets 200 MB at most."""
    known = labels.select(F.col(doc), F.col("quality").cast("int").alias("__y")).filter(F.col("__y").isNotNull() & ~held_out(doc))
    chosen = known.orderBy(F.xxhash64(doc), doc, "__y").limit(sample)
    found = docs.select(doc, F.col(text).cast("string").alias("__t")).join(F.broadcast(chosen.dropDuplicates([doc])), doc)
    # a key per id: a repeated one is reduced in its map task before any shuffle
    one = found.groupBy(doc).agg(F.min_by(F.struct("__t", "__y"), F.xxhash64("__t")).alias("x"))
    rows = one.select("x.__t", "x.__y")  # `sample` rows at most

    def run(batches):
        for b in batches:
            f = [heaviest(*features(t.as_py())) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in f], pa.list_(pa.int32())), pa.array([x for _, x in f], pa.list_(pa.float32())), b.column(1)], ["i", "x", "y"])

    got = rows.mapInArrow(run, "i array<int>, x array<float>, y int").toArrow()
    if not got.num_rows:
        return Machine().fit([], np.zeros(0))
    i, x = got.column("i").combine_chunks(), got.column("x").combine_chunks()
    bounds = i.offsets.to_numpy()
    values, weights = i.values.to_numpy(), x.values.to_numpy()
    order = sorted(range(got.num_rows), key=lambda k: (zlib.crc32(values[bounds[k] : bounds[k + 1]].tobytes()), k))
    return Machine().fit([(values[bounds[k] : bounds[k + 1]], weights[bounds[k] : bounds[k + 1]]) for k in order], got.column("y").to_numpy()[order].astype(np.float64))


def score(docs: DataFrame, machine: Machine, doc: str = "doc_id", text: str = "text", name: str = "score") -> DataFrame:
    """All columns of `docs` plus the score by this name. A column of this name is replaced: name another to keep it, as `accepted` does."""
    docs = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast((machine.w0, machine.w, machine.v))

    def run(batches):
        m = Machine.__new__(Machine)
        m.w0, m.w, m.v = shared.value
        for b in batches:
            texts = b.column(b.num_columns - 1)
            out = []
            for at in range(0, b.num_rows, 64):
                rows = [features(t.as_py()) for t in texts.slice(at, 64)]
                out.append(m.scores(*flat(rows)))
            scores = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores, pa.float64())], [*b.schema.names[:-1], name])

    named = docs.withColumn(fresh(docs, "scored_text"), F.col(text).cast("string"))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), f"`{name}` double"])
    return named.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    s = score(docs.select(doc, text), train(docs, labels, sample, doc, text), doc, text)
    return s.select(doc, held_out(doc).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without the rows that the classifier rejects."""
    name = fresh(docs, "score")
    return score(docs, train(docs, labels, sample, doc, text), doc, text, name).filter(F.col(name) >= 0.5).select(*docs.columns)
