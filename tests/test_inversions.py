"""Counting discordant pairs."""

import numpy as np
import pytest

from plumbline.operators import resample


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 300, 1100])
@pytest.mark.parametrize("kinds", [1, 5, 10_000])
def test_discordant_pairs_are_those_of_comparing_all(n, kinds):
    rng = np.random.default_rng(n)
    a, g = rng.integers(0, kinds, n), rng.integers(0, kinds, n)
    want = int((((a[:, None] - a) * (g[:, None] - g)) < 0).sum()) // 2
    assert resample.discordant(a.astype(float), g.astype(float)) == want


def test_keys_of_one_row_make_no_arrays(monkeypatch):
    def split(*_):  # an array for each key, under each weighting, was most of the time
        raise AssertionError("an array a key")

    monkeypatch.setattr(np, "split", split)
    assert resample._repeated(np.arange(1000)) == []
    assert [x.tolist() for x in resample._repeated(np.array([5, 3, 5, 4, 3, 5]))] == [[1, 4], [0, 2, 5]]


@pytest.mark.parametrize("n", [1, 2, 1000, 70_000])
def test_values_are_ordered_by_sorts_of_whole_numbers(n):
    rng = np.random.default_rng(n)
    for x in (rng.normal(size=n), rng.integers(-3, 3, n) * 1.0, 0.5 + rng.integers(0, 99, n) * 2.0**-50, np.where(rng.random(n) < 0.5, -0.0, 0.0)):
        assert (x[resample._order(x)] == np.sort(x)).all()


@pytest.mark.parametrize("merged", [1 << 16, 300])
@pytest.mark.parametrize("add", [0, 1 << 29, -2000])
def test_groups_are_merged_apart(monkeypatch, merged, add):
    monkeypatch.setattr(resample, "MERGED", merged)
    r = np.random.default_rng(2).integers(0, 3000, 5000) + add
    assert resample.inversions(r) == sum(int((r[:i] > x).sum()) for i, x in enumerate(r))


def test_two_million_rows_are_one_block():
    assert resample.BLOCK_ROWS == 2_000_000  # two blocks, as of over 1,250,000 before, are counted more than twice
