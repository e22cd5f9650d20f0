import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from plumbline.llm import simhash as S


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def plain_print(text):
    w = words(text)
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute(rows, radius=4):
    prints = [(i, plain_print(t)) for i, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in combinations(range(len(rows)), 2):
        if rows[x][0] is not None and rows[y][0] is not None and (prints[x][1] ^ prints[y][1]).bit_count() <= radius:
            root[find(x)] = find(y)
    low = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            low[find(x)] = min(low.get(find(x), i), i)
    return sorted(((i, f"{p:016x}", None if i is None else low[find(x)]) for x, (i, p) in enumerate(prints)), key=str)


def corpus(seed):
    r = random.Random(seed)
    rows = []
    for _ in range(40):
        base = [f"w{r.randrange(2000)}" for _ in range(r.choice([1, 3, 4, 5, 40, 120, 400]))]
        for _ in range(r.randint(1, 8)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2])):
                w[r.randrange(len(w))] = f"Edit{r.randrange(10**6)}"
            rows.append(" ".join(w))
    rows += ["", None, " \t", "A b", "a\nB", "a\tb", "É b c d e", "é b c d e", "x " * 3000, "q" * 70000 + " x", " a b", "a\x0bb c d"]
    r.shuffle(rows)
    return [(i if i % 29 else None if i % 2 else 3, t) for i, t in enumerate(rows)]


def result(spark, rows, **more):
    found = S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **more)
    return sorted(map(tuple, found.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    assert result(spark, rows) == brute(rows)


def test_more_chunks_and_small_blocks_change_nothing(spark, monkeypatch):
    rows = corpus(3)
    expected = brute(rows, 6)
    monkeypatch.setattr(S, "SHARD", -1)
    monkeypatch.setattr(S, "BLOCK", 7)
    monkeypatch.setattr(S, "BATCH", 50)
    assert len(S.routes(4, 1)) == 70
    assert result(spark, rows, radius=6) == expected


def test_no_broadcast_and_hot_classes(spark, monkeypatch):
    rows = corpus(4) + [(10_000 + i, "the same four words here") for i in range(300)]
    monkeypatch.setattr(S, "BROADCAST_CLASSES", 0)
    monkeypatch.setattr(S, "HOT_ROWS", 50)
    assert result(spark, rows) == brute(rows)


def test_hash_is_that_of_spark(spark):
    texts = ["one two three four", "É", "a b c", "x" * 200 + " y z w"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("xxhash64(lower(t)) as h").collect()
    flat, offsets = "".join(texts).encode(), np.cumsum([0] + [len(t.encode()) for t in texts])
    hashes, counts = S.shingle_hashes(np.frombuffer(flat, np.uint8), offsets)
    assert counts.tolist() == [1, 1, 1, 1]
    assert [h for i, h in enumerate(hashes.view(np.int64).tolist()) if i != 1] == [r.h for i, r in enumerate(rows) if i != 1]


@pytest.mark.parametrize("bits", [3, 40])
def test_tree_search(bits):
    r = np.random.default_rng(bits)
    points = np.unique(r.integers(0, 1 << bits, 3000, np.uint64))
    tile = np.sort(r.integers(0, 5, len(points)))
    found = set()
    trees = S.Trees(points, tile)
    roots = trees.roots[np.searchsorted(tile[trees.roots], tile)]
    for q, n in trees.near(points, roots, 4):
        found |= set(zip(q.tolist(), n.tolist(), strict=True))
    expected = {(i, j) for i in range(len(points)) for j in np.flatnonzero((np.bitwise_count(points ^ points[i]) <= 4) & (tile == tile[i])).tolist()}
    assert found == expected


def test_nothing_and_other_columns(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = spark.createDataFrame([(1, "a", 5, 6), (2, None, 5, 6)], "doc_id long, text string, print int, component_id int")
    found = sorted(map(tuple, S.near_duplicates(rows).collect()))
    assert found == [(1, f"{xxhash.xxh64_intdigest(b'a', 42):016x}", 1), (2, "0" * 16, 2)]
