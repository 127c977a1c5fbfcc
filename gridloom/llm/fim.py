"""Fill-in-middle transformation: lines of a text are dealt to prefix, middle and suffix, found through an indexable skip list.

The lines of a text are the nodes of a skip list. Each link of a lane carries two widths: how many lines and how many code
points it spans. A cut is asked for by its line rank; the search goes right while the accumulated line width stays within the
rank and down otherwise, so that it ends exactly at the rank, with the code points before it as the sum of the other width.

Both ranks, the form and whether a text is transformed at all come from a hash of the seed and the id: a task that runs again
gives the same rows. The work is one map over the documents; nothing is shuffled. `restore` turns an output back into its
text: sentinels don't occur in texts that are transformed, and no join of pieces can make one (each begins with < and ends with >).

Edge cases: null and empty texts give an empty plain output; a text that holds a sentinel stays plain; without line ends a
text is one line; pieces may be empty; a null id is hashed as an empty one; repeated rows give repeated rows; an empty table gives
an empty one; other columns of the documents are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sha_hex

PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
#: Bits of a node's hash that must be zero for each further lane: a lane holds a quarter of the nodes below.
STEP = 2


class SkipList:
    """Nodes of given widths in code points; lane 0 links them all, each further lane a part, and every link has both its widths."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        mixed = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        units, points, at = np.ones(n, np.int64), np.asarray(points, np.int64), np.arange(n)
        self.lanes = [(units, points, None)]
        for height in range(1, 22):
            stays = np.flatnonzero(mixed[at] & np.uint64((1 << STEP * height) - 1) == 0)
            if not len(stays):
                break
            starts = np.concatenate([[0], stays[:-1] + 1])
            # a link ends at a node that stays; what follows the last one is reached through the lanes below
            units, points, at = np.add.reduceat(units[: stays[-1] + 1], starts), np.add.reduceat(points[: stays[-1] + 1], starts), at[stays]
            self.lanes.append((units, points, stays))

    def before(self, rank: int) -> int:
        """Code points of the first `rank` nodes."""
        done = points = link = 0
        for units, widths, below in reversed(self.lanes):
            while link < len(units) and done + units[link] <= rank:
                done, points, link = done + int(units[link]), points + int(widths[link]), link + 1
            if below is not None and link:  # stand on the same node one lane down
                link = int(below[link - 1]) + 1
        if done != rank:
            raise IndexError(rank)
        return points


def line_widths(text: str) -> np.ndarray:
    """Code points of each line, its line end included; a last line without one counts if it isn't empty."""
    parts = text.split("\n")
    widths = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    widths[-1] -= 1
    return widths if widths[-1] else widths[:-1]


def rearranged(text: str, doc: str, seed: str = "7", rate: int = 100, spm: int = 50) -> tuple[int, str, int | None, int | None, str]:
    """(lines, form, code points of prefix and middle, output) of a text by the first four numbers of the hash of seed and id."""
    widths = line_widths(text)
    n = len(widths)
    h = hashlib.sha256(f"{seed}:{doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    if not text or any(s in text for s in SENTINELS) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    nodes = SkipList(widths)
    a, b = nodes.before(low), nodes.before(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(docs: DataFrame, seed: str = "7", rate: int = 100, spm: int = 50, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n, form, prefix_chars, middle_chars, output); `rate` percent of the texts are transformed, `spm` percent of these suffix first."""
    kind = dict(docs.dtypes)[doc]

    def run(batches):
        for b in batches:
            rows = [rearranged(t.as_py() or "", d.as_py() or "", seed, rate, spm) for d, t in zip(b.column(1), b.column(2))]
            n, form, prefix, middle, output = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())],
                [doc, "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    rows = docs.select(doc, F.col(doc).cast("string").alias("__named"), F.col(text).cast("string").alias("__t"))
    return rows.mapInArrow(run, f"`{doc}` {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text of an output: what stands between the sentinels, in the order prefix, middle, suffix."""
    middle = F.substring_index(output, MIDDLE, -1)
    rest = F.substring_index(output, MIDDLE, 1)
    psm = F.concat(F.substring_index(F.substring_index(rest, SUFFIX, 1), PREFIX, -1), middle, F.substring_index(rest, SUFFIX, -1))
    spm = F.concat(F.substring_index(rest, PREFIX, -1), middle, F.substring_index(F.substring_index(rest, PREFIX, 1), SUFFIX, -1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(transformed: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The rows with hashes in place of the texts; `restored_sha256` is of the text rebuilt from output and form alone."""
    back = restored(F.col("output"), F.col("form"))
    return transformed.select(doc, "n", "form", "prefix_chars", "middle_chars", sha_hex(F.col("output")).alias("output_sha256"), sha_hex(back).alias("restored_sha256"))
