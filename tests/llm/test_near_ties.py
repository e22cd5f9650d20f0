"""Ties join exactly what chains of near signatures under shared keys join, and nothing else."""

import numpy as np
import pytest

from plumbline.llm import components as C
from plumbline.llm import near_dedup as N


def grouped(ids, pairs):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("hot", [False, True])
def test_equals_brute_force(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(N, "HOT_ROWS", 5)
        monkeypatch.setattr(N, "BROADCAST_NODES", 0)
        monkeypatch.setattr(N, "BLOCK_SIGNATURES", 6)
        monkeypatch.setattr("plumbline.llm.common.HOT_ROWS", 5)
    plan = N.scheme(85)
    r = np.random.default_rng(1)
    common = r.integers(0, 1 << 16, plan.symbols).astype(np.uint16)
    sigs = []
    for family in range(12):  # all share a chunk, so all meet, but families are far from each other
        base = r.integers(0, 1 << 16, plan.symbols).astype(np.uint16)
        base[: plan.places] = common[: plan.places]
        for _ in range(5):
            one = base.copy()
            one[plan.places + r.choice(plan.symbols - plan.places, 9, replace=False)] ^= 3
            sigs.append(one)
    sigs += [r.integers(0, 1 << 16, plan.symbols).astype(np.uint16) for _ in range(10)]
    order = r.permutation(len(sigs))
    sigs = [sigs[i] for i in order]
    made = N.keys(np.array(sigs), plan.places)
    near = [
        (i, j)
        for i in range(len(sigs)) for j in range(i)
        if (made[i] == made[j]).any() and (sigs[i] != sigs[j]).sum() <= plan.far
    ]
    want = grouped(range(len(sigs)), near)
    assert len(set(want.values())) == 22
    classes = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(sigs)], "node long, sig binary")
    ties = [(t.a, t.b) for t in N.near_ties(classes, plan).collect()]
    assert all((sigs[a] != sigs[b]).sum() <= plan.far for a, b in ties)
    assert grouped(range(len(sigs)), ties) == want
    assert len(ties) < 4 * len(sigs)


def test_components_of_a_hot_node(spark, monkeypatch):
    for where in ("plumbline.llm.common.HOT_ROWS", "plumbline.llm.components.HOT_ROWS"):
        monkeypatch.setattr(where, 10)
    links = [(0, i) for i in range(1, 60)] + [(100, 101), (101, 102), (70, 59), (None, 3), (5, None)]
    got = {x.node: x.component for x in C.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in [*range(60), 70]} | {100: 100, 101: 100, 102: 100}


def test_salted_join_equals_plain(spark, monkeypatch):
    from plumbline.llm import common

    left = spark.createDataFrame([(i % 7 if i % 3 else 0, None if i % 5 == 0 else "k", i) for i in range(300)], "a long, b string, v long")
    right = spark.createDataFrame([(i, "k", -i) for i in range(5)], "a long, b string, w long")
    want = sorted(map(str, left.join(right, ["a", "b"], "left").collect()))
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    hot = common.hot_keys(left, ["a", "b"])
    assert (0, "k") in hot
    joined = common.salted_join(left, right, ["a", "b"])
    assert sorted(map(str, joined.select("a", "b", "v", "w").collect())) == want
    assert "salt" in joined._jdf.queryExecution().analyzed().toString()
    assert "monotonically" not in joined._jdf.queryExecution().analyzed().toString()
