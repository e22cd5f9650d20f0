"""The pipeline's near-dedup stage against brute force at a similarity of 0.8."""

import random

import numpy as np
import pytest

import corpus_pipeline as P
from plumbline.llm import near_dedup as N
from test_near_dedup import corpus, edited, shingles


def kept(rows, percent):
    """Ids that are the least of their group; rows have ids of their own."""
    sets, root = [(i, shingles(t)) for i, t in rows], {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return sorted(i for i in root if find(i) == i)


def pairs_between():
    """Pairs of similarity 0.80 up to 0.85, and some below."""
    r, rows = random.Random(7), []
    for n in range(80):
        base = [f"p{n}w{x}" for x in range(r.choice([100, 200]))]
        rows += [(10_000 + 2 * n, " ".join(base)), (10_001 + 2 * n, edited(r, base, round(len(base) * r.choice([0.021, 0.0225, 0.035]))))]
    return rows


@pytest.mark.parametrize("block_docs", [1500, 9])
def test_stage_equals_brute_force_at_80(spark, monkeypatch, block_docs):
    monkeypatch.setattr(N, "BLOCK_DOCS", block_docs)
    rows = corpus(11) + pairs_between()
    want = kept(rows, 80)
    assert len(kept(rows, 85)) > len(want) + 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in P.once(spark, docs, "").collect()) == want


@pytest.mark.parametrize("percent", list(N.SCHEMES))
def test_keys_are_sized_for_the_least_similarity(percent):
    plan, p = N.scheme(percent), percent / 100
    one = p**plan.places + plan.places * (1 - p) * p ** (plan.places - 1)
    assert (1 - one) ** plan.chunks < 0.0002
    r = np.random.default_rng(0)
    a = r.integers(0, 1 << 16, (50_000, plan.symbols)).astype(np.uint16)
    b = np.where(r.random(a.shape) < p, a, a ^ 1).astype(np.uint16)
    assert (N.keys(a, plan.places) == N.keys(b, plan.places)).any(axis=1).mean() > 0.9997
    assert ((a != b).sum(axis=1) <= plan.far).mean() > 0.9999


def test_no_scheme_below():
    with pytest.raises(ValueError, match="79 %"):
        N.scheme(79)
