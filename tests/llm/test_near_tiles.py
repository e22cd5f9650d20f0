"""Tiles of two blocks count shared shingles exactly."""

import numpy as np

from plumbline.llm import near_dedup as N


def test_shingles_missing_from_the_right_block_are_not_shared():
    r = np.random.default_rng(3)
    pool = np.unique(r.integers(0, 1 << 63, 4000).astype(np.uint64))
    left, right, want = [], [], []
    for n in range(400):  # 84 of 100 shared, which is just too few; gaps of the right are dense in the left's own
        union = np.sort(r.choice(pool, 100, replace=False))
        only = r.choice(100, 16, replace=False)
        a, b = np.delete(union, only[:8]), np.delete(union, only[8:])
        left.append(a), right.append(b)
        want.append(100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b)))
    assert not any(want)
    for a, b in zip(left, right, strict=True):
        sigs = np.zeros((2, N.SYMBOLS), np.uint16)
        assert N.confirm([a, b], sigs, 1, 85) == []


def test_two_blocks_equal_one():
    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 63, 3000).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: 3000 - k], r.integers(0, 1 << 63, k).astype(np.uint64)])) for k in (240, 241, 242, 243, 244, 245)]
    sigs = np.zeros((2, N.SYMBOLS), np.uint16)
    for i in range(6):
        for j in range(i):
            exact = 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))
            assert bool(N.confirm([sets[i], sets[j]], sigs, 1, 85)) == bool(N.confirm([sets[i], sets[j]], sigs, 0, 85)) == exact
