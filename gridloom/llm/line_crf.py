"""Quality rules by line labelling: a linear-chain conditional random field marks lines as content or boilerplate.

The lines with a word form a sequence. Each line is described by binned surface measures (`MEASURES`: letter case, digits, marks,
word lengths, repeats inside the line, in the text and of whole lines, place), and a path of labels scores the sum of the lines'
weights, the transitions and the start. Viterbi decoding gives the best path; a text is kept if at least half of its code points
in words stand in content lines and the plain rules (`base_failed`) don't reject it.

The field is trained on a bounded sample of the labelled documents (`SAMPLE` documents of the smallest hash of the id, `LINES` lines of
each, in segments of `SEGMENT`) that aren't held out. Documents have labels, lines have none: every line first takes the
label of its document; after a first fit, lines that the field reads otherwise change theirs as long as the document's own label
keeps the larger part of it, and the field is fitted again. Language, source and ids are never inputs.

Rules and labels come from one map over the documents; nothing is shuffled but the ids of the sample.

Edge cases: null and empty texts have no words and are rejected; blank lines are no part of a sequence; with labels of one class or
none every line is content; a null label is left out; repeated rows get equal rows; an empty table gives an empty one; of other
columns of the documents only those of the result's names are replaced, and `judge` leaves out all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_fm import held_out

SAMPLE, LINES, SEGMENT = 3_000, 256, 64
MEASURES = ("upper", "digits", "symbols", "exclamations", "marks", "non_ascii", "word_length", "words", "adjacent_repeats", "repeats", "duplicate", "place")
BINS = 8
#: Kinds of bytes, and the characters that the rules call symbols.
BLANK, END, LOWER, UPPER, DIGIT, SYMBOL, CALL, MARK, LEAD, REST = range(10)
KINDS, SYMBOLS = 10, b"#*$%&|<>"


def _kind(c: int) -> int:
    if c == 10:
        return END
    if c == 32 or 9 <= c <= 13:
        return BLANK
    if c >= 128:
        return REST if c < 192 else LEAD
    if 97 <= c <= 122 or 65 <= c <= 90:
        return LOWER if c >= 97 else UPPER
    if 48 <= c <= 57:
        return DIGIT
    return SYMBOL if c in SYMBOLS else CALL if c == 33 else MARK


KIND = np.array([_kind(c) for c in range(256)], np.uint8)
#: Bytes that are looked at together: bounds the arrays of a long text.
BLOCK = 1 << 20


def in_repeats(ids: np.ndarray, kinds: int) -> np.ndarray:
    """Which words stand in a window of three words that occurs twice or more."""
    hit = np.zeros(len(ids), bool)
    if len(ids) > 2:
        if kinds < 1 << 21:
            key = (ids[:-2] * kinds + ids[1:-1]) * kinds + ids[2:]
        else:
            pair = np.unique(ids[:-1] * kinds + ids[1:], return_inverse=True)[1]
            key = pair[:-1] * kinds + ids[2:]
        _, at, n = np.unique(key, return_inverse=True, return_counts=True)
        twice = n[at] > 1
        for k in range(3):
            hit[k : len(hit) - 2 + k] |= twice
    return hit


def measured(raw: bytes) -> tuple[np.ndarray, np.ndarray, tuple[int, int, int, int, int]]:
    """(bins of the lines with a word, their code points in words, (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words))."""
    words, parts = raw.split(), raw.split(b"\n")
    known: dict[bytes, int] = {}
    ids = np.fromiter([known.setdefault(w, len(known)) for w in words], np.int64, len(words))
    table, starts, line, before = np.zeros((len(parts), KINDS), np.int64), [], 0, True
    for at in range(0, len(raw), BLOCK):
        kind = KIND[np.frombuffer(raw, np.uint8, min(BLOCK, len(raw) - at), at)]
        of = np.cumsum(kind == END)
        table[line : line + of[-1] + 1] += np.bincount(of * KINDS + kind, minlength=(of[-1] + 1) * KINDS).reshape(-1, KINDS)
        void = kind <= END
        first = np.flatnonzero(~void & np.concatenate([[before], void[:-1]]))
        starts.append(of[first] + line)
        line, before = line + int(of[-1]), bool(void[-1])
    of_word = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    n_lines, hit = len(parts), in_repeats(ids, len(known))
    per_line = np.bincount(of_word, minlength=n_lines)
    same = (ids[1:] == ids[:-1]) & (of_word[1:] == of_word[:-1])
    adjacent, repeats = np.bincount(of_word[1:][same], minlength=n_lines), np.bincount(of_word[hit], minlength=n_lines)
    has, seen, copies = np.flatnonzero(per_line), set(), []
    for k in has:
        copies.append(parts[k] in seen)
        seen.add(parts[k])
    chars = table[:, LOWER:REST].sum(1)
    base = (len(words), int(chars.sum()), int(table[:, SYMBOL].sum()), sum(copies), int(hit.sum()))
    t, c, n = table[has], np.maximum(chars[has], 1), per_line[has]
    shares = [
        t[:, UPPER] / np.maximum(1, t[:, UPPER] + t[:, LOWER]), t[:, DIGIT] / c, t[:, SYMBOL] / c, t[:, CALL] / np.maximum(n, 1), t[:, MARK] / c, t[:, LEAD] / c,
        c / np.maximum(n, 1) / 24, np.log2(np.maximum(n, 1)) / 10, adjacent[has] / np.maximum(n, 1), repeats[has] / np.maximum(n, 1),
    ]
    bins = [np.minimum(BINS - 1, (np.sqrt(np.minimum(s, 1)) * BINS).astype(np.int64)) for s in shares]
    place = np.zeros(len(has), np.int64)
    if len(has):
        place[0] += 1
        place[-1] += 2
    return np.stack([*bins, np.array(copies, np.int64), place], 1).astype(np.uint8), chars[has], base


class Field:
    """Weights of the bins (for content, against boilerplate), transitions by (label before, label) and starts; label 1 is content."""

    def __init__(self):
        self.w, self.t, self.s = np.zeros(len(MEASURES) * BINS), np.zeros((2, 2)), np.zeros(2)

    def emissions(self, bins: np.ndarray) -> np.ndarray:
        return self.w[bins.astype(np.int64) + np.arange(len(MEASURES)) * BINS].sum(-1)

    def decode(self, bins: np.ndarray) -> np.ndarray:
        """The best labels of a sequence, by Viterbi's recursion on the gap between the best paths to either label; ties go to content."""
        if not len(bins):
            return np.zeros(0, bool)
        (bb, bc), (cb, cc) = self.t.tolist()
        e = self.emissions(bins).tolist()
        gap, back = float(self.s[1] - self.s[0]) + e[0], []
        for x in e[1:]:
            back.append((gap + cb >= bb, gap + cc >= bc))  # whether the best path to boilerplate, to content comes from content
            gap = x + max(gap + cc, bc) - max(gap + cb, bb)
        labels = [gap >= 0]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return np.array(labels[::-1], bool)

    def likelihood(self, groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """(log likelihood, its gradients by w, t, s) of groups of padded sequences (bins, labels, mask)."""
        total, dw, dt, ds = 0.0, np.zeros_like(self.w), np.zeros_like(self.t), np.zeros_like(self.s)
        for cells, y, mask in groups:
            n, length = y.shape
            rows = np.arange(n)
            e = np.zeros((n, length, 2))
            e[:, :, 1] = self.w[cells].sum(-1)
            a, norm = np.zeros((n, length, 2)), np.zeros(n)
            a[:, 0] = self.s + e[:, 0]
            for k in range(1, length):
                step = a[:, k - 1, :, None] + self.t
                a[:, k] = np.where(mask[:, k, None], np.logaddexp(step[:, 0], step[:, 1]) + e[:, k], a[:, k - 1])
            norm = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
            b = np.zeros((n, 2))
            grad = np.zeros((n, length))
            for k in range(length - 1, -1, -1):
                p = np.exp(a[:, k, 1] + b[:, 1] - norm)
                grad[:, k] = np.where(mask[:, k], y[:, k] - p, 0)
                if k:
                    to = e[:, k] + b
                    pair = np.exp(a[:, k - 1, :, None] + self.t + to[:, None] - norm[:, None, None]) * mask[:, k, None, None]
                    dt -= pair.sum(0)
                    np.add.at(dt, (y[mask[:, k], k - 1], y[mask[:, k], k]), 1)
                    step = self.t + to[:, None]
                    b = np.where(mask[:, k, None], np.logaddexp(step[:, :, 0], step[:, :, 1]), b)
                else:
                    ds += np.bincount(y[:, 0], minlength=2) - np.array([(1 - p).sum(), p.sum()])
            gold = self.s[y[:, 0]] + (e[:, :, 1] * y * mask).sum(1) + (self.t[y[:, :-1], y[:, 1:]] * mask[:, 1:]).sum(1)
            total += float((gold - norm)[rows].sum())
            dw += np.bincount(cells[mask].ravel(), np.repeat(grad[mask], cells.shape[-1]), len(self.w))
        return total, dw, dt, ds

    def fit(self, sequences: list[tuple[np.ndarray, np.ndarray]], rounds: int = 80, rate: float = 0.1, decay: float = 1.0) -> "Field":
        """Gradient ascent with moments (Adam) on the likelihood of (bins, labels), with a quadratic penalty."""
        groups = padded(sequences)
        x = np.concatenate([self.w, self.t.ravel(), self.s])
        one, two, n = np.zeros_like(x), np.zeros_like(x), len(self.w)
        for k in range(1, rounds + 1):
            _, dw, dt, ds = self.likelihood(groups)
            g = np.concatenate([dw, dt.ravel(), ds]) - decay * x
            one, two = 0.9 * one + 0.1 * g, 0.99 * two + 0.01 * g * g
            x = x + rate * (one / (1 - 0.9**k)) / (np.sqrt(two / (1 - 0.99**k)) + 1e-8)
            self.w, self.t, self.s = x[:n], x[n : n + 4].reshape(2, 2), x[n + 4 :]
        return self


def padded(sequences: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Segments of like lengths stacked: (cells of the weights, labels, mask) by powers of two."""
    by: dict[int, list] = {}
    for bins, y in sequences:
        for at in range(0, len(y), SEGMENT):
            part = slice(at, at + SEGMENT)
            by.setdefault(max(0, len(y[part]) - 1).bit_length(), []).append((bins[part], y[part]))
    out = []
    for _, rows in sorted(by.items()):
        length = max(len(y) for _, y in rows)
        cells, labels, mask = np.zeros((len(rows), length, len(MEASURES)), np.int64), np.zeros((len(rows), length), np.int64), np.zeros((len(rows), length), bool)
        for k, (bins, y) in enumerate(rows):
            cells[k, : len(y)], labels[k, : len(y)], mask[k, : len(y)] = bins, y, True
        out.append((cells + np.arange(len(MEASURES)) * BINS, labels, mask))
    return out


def corrected(field: Field, bins: np.ndarray, chars: np.ndarray, label: int) -> np.ndarray:
    """The lines' labels as the field reads them, if the document's own label keeps the larger part; else that label for all."""
    read = field.decode(bins).astype(np.int64)
    own = chars[read == label].sum() * 2 > chars.sum()
    return read if own else np.full(len(bins), label, np.int64)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc: str = "doc_id", text: str = "text") -> Field:
    """The field fitted on at most `sample` labelled documents that aren't held out; of the lines of each, `LINES` come to the driver at most."""
    known = labels.select(F.col(doc), F.col("quality").cast("int").alias("__y")).filter(F.col("__y").isin(0, 1) & ~held_out(doc))
    chosen = known.orderBy(F.xxhash64(doc), doc, "__y").limit(sample)
    found = docs.select(doc, F.col(text).cast("string").cast("binary").alias("__t")).join(F.broadcast(chosen.dropDuplicates([doc])), doc)

    def run(batches):
        for b in batches:
            rows = []
            for t in b.column(1):
                bins, chars, _ = measured(t.as_py() or b"")
                if len(bins) > LINES:
                    bins, chars = np.concatenate([bins[: LINES // 2], bins[-LINES // 2 :]]), np.concatenate([chars[: LINES // 2], chars[-LINES // 2 :]])
                rows.append((bins.tobytes(), chars.astype(np.int64).tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["y", "bins", "chars"])

    rows = found.select("__y", "__t").mapInArrow(run, "y int, bins binary, chars binary")
    # a row of a repeated id is one more document; a key per content keeps their number at the sample's
    one = rows.groupBy("bins", "chars", "y").agg(F.count("*").alias("n")).orderBy(F.xxhash64("bins", "chars", "y"), "bins", "chars", "y").limit(sample)
    data = [(np.frombuffer(r["bins"], np.uint8).reshape(-1, len(MEASURES)), np.frombuffer(r["chars"], np.int64), r["y"]) for r in one.collect()]
    data = [d for d in data if len(d[0])]
    field = Field()
    if len({y for _, _, y in data}) < 2:
        return field
    field.fit([(bins, np.full(len(bins), y, np.int64)) for bins, _, y in data])
    return field.fit([(bins, corrected(field, bins, chars, y)) for bins, chars, y in data], rounds=40)


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_content_lines long, content_share double"


def labelled(docs: DataFrame, field: Field, content: bool = False, text: str = "text") -> DataFrame:
    """`docs` with the plain measures, the lines with a word, those of content and their share of the code points in words.

    With `content` also the text of the content lines alone. Columns of these names are replaced.
    """
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    shared = docs.sparkSession.sparkContext.broadcast((field.w, field.t, field.s))  # a few hundred numbers
    rows = docs.drop(*names, "content")
    kept = len(rows.columns)

    def run(batches):
        field = Field()
        field.w, field.t, field.s = shared.value
        for b in batches:
            out, texts = [], []
            for t in b.column(kept):
                raw = t.as_py() or b""
                bins, chars, base = measured(raw)
                good = field.decode(bins)
                out.append((*base, len(bins), int(good.sum()), float(chars[good].sum() / max(1, chars.sum()))))
                if content:
                    lines = [x for x in raw.split(b"\n") if x.strip()]
                    texts.append(b"\n".join(x for x, g in zip(lines, good) if g))
            cols = list(zip(*out)) if out else [()] * len(names)
            arrays = [pa.array(c, pa.float64() if n == "content_share" else pa.int64()) for c, n in zip(cols, names)]
            yield pa.RecordBatch.from_arrays([*b.columns[:kept], *arrays, *([pa.array(texts, pa.binary()).cast(pa.string())] if content else [])], [*b.schema.names[:kept], *names, *(["content"] if content else [])])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), COLUMNS, *(["content string"] if content else [])])
    return rows.withColumn("__raw", F.col(text).cast("string").cast("binary")).mapInArrow(run, schema)


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least_words: int = 50, most_repeats: int = 50, least_content: float = 0.5, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, measures, base_failed, kept): too short or too repetitive texts fail; of the others those with enough content are kept."""
    rows = labelled(docs.select(doc, text), train(docs, labels, sample, doc, text), text=text).drop(text)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("content_share") >= least_content))
