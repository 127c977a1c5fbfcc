"""Leaves of fingerprints: bands meet every linked pair, and a task's pairs don't grow with the square of its leaf."""

import numpy as np
import pytest

from gridloom.llm import simhash_vp as sv


def drawn(n):
    """Random fingerprints, copies with up to four other bits, and a crowd that agrees in three of the five bands."""
    rng = np.random.default_rng(6)
    far = rng.integers(0, 1 << 63, n, np.uint64)
    near = far[: n // 4].copy()
    for _ in range(4):
        near ^= np.uint64(1) << rng.integers(0, 64, len(near)).astype(np.uint64)
    crowd = far[0] ^ rng.integers(0, 1 << 20, 200, np.uint64)
    return np.unique(np.concatenate([far, near, crowd]))


@pytest.mark.parametrize("chunks", [1, 3])
def test_bands_find_all_links(monkeypatch, chunks):
    monkeypatch.setattr(sv, "FEW", 10)
    fps = drawn(2000)
    chunk, of = np.arange(len(fps)) % chunks, np.arange(len(fps))
    banded, blocks = sv.Forest(fps, 4), sv.Forest(fps, 4)
    banded.within(of, chunk if chunks > 1 else None)
    i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None]) <= 4, 1))
    if chunks > 1:
        i, j = i[chunk[i] != chunk[j]], j[chunk[i] != chunk[j]]
    blocks.unite(i, j)
    assert np.array_equal(banded.root, blocks.root) and len(i) > 300


def test_a_large_leaf_meets_few_pairs(monkeypatch):
    met = []
    count = np.bitwise_count
    monkeypatch.setattr(sv.np, "bitwise_count", lambda x: met.append(x.size) or count(x))
    fps = np.unique(np.random.default_rng(7).integers(0, 1 << 63, 20_000, np.uint64))
    sv.Forest(fps, 4).within(np.arange(len(fps)))
    assert sum(met) < len(fps) ** 2 / 500


def test_the_rows_grow_slowly_with_the_fingerprints():
    sample = np.random.default_rng(8).integers(0, 1 << 63, 4096, np.uint64)
    tree = sv.Tree(sample, 3_000_000, 4)
    assert sum(len(m) for _, m in tree.leaves(sample)) < 12 * len(sample)
