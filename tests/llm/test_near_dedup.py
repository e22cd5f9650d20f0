import random
import re
from collections import defaultdict

import numpy as np
import pytest

from plumbline.llm import components as C
from plumbline.llm import near_dedup as N


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    ids = sorted({i for i, _ in rows if i is not None})
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return sorted((i, len(shingles(t)), None if i is None else find(i), i is None or find(i) == i) for i, t in rows if i is not None)


def edited(r, words, n):
    w = list(words)
    for _ in range(n):
        w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


def corpus(seed):
    r = random.Random(seed)
    rows, n = [], 0
    for _ in range(25):
        base = [f"w{r.randrange(3000)}" for _ in range(r.choice([3, 5, 8, 60, 150, 300]))]
        for _ in range(r.randint(1, 8)):
            rows.append((n, edited(r, base, r.choice([0, 0, 1, 2, 4, 8]))))
            n += 1
    hot = [f"h{r.randrange(3000)}" for _ in range(146)]
    for _ in range(60):
        rows.append((n, edited(r, hot, r.randint(1, 5))))
        n += 1
    rows += [(n, ""), (n + 1, None), (n + 2, " \t"), (n + 3, "A b"), (n + 4, "a\nB"), (n + 5, "É b"), (n + 6, "é b"), (n + 7, "q" * 70000 + " x"), (n + 8, "q" * 70000 + " x")]
    rows += [(n + 20 + i, " ".join(hot)) for i in range(10)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("blocks", [(400_000, 1500), (2000, 9)])
def test_equals_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(N, "BLOCK_SHINGLES", blocks[0])
    monkeypatch.setattr(N, "BLOCK_DOCS", blocks[1])
    if blocks[1] == 9:
        monkeypatch.setattr(N, "BROADCAST_NODES", 0)
    rows = corpus(4)
    docs = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string").selectExpr("*", "1 as node", "'x' as sig")
    got = N.near_duplicates(docs).collect()
    assert [tuple(g)[1:] for g in got if g.doc_id is None] == [(len(shingles(rows[0][1])), None, True)]
    assert sorted(tuple(g) for g in got if g.doc_id is not None) == brute(rows)


def test_repeated_ids_and_none(spark):
    text = " ".join(map(str, range(50)))
    rows = [(1, text), (1, text), (1, "other words of the same id here"), (2, text + " 50"), (3, "other words of the same id here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((g.doc_id, g.component_id) for g in N.near_duplicates(docs).collect())
    assert got == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 1)]
    assert N.near_duplicates(docs.limit(0)).count() == 0


def test_near_signatures_share_a_key():
    r = np.random.default_rng(0)
    a = r.integers(0, 1 << 16, (300, N.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for row in b:  # the largest distance that the index guarantees
        row[r.choice(N.SYMBOLS, N.CHUNKS * (N.ERRORS + 1) - 1, replace=False)] ^= 1
    assert (N.keys(a) == N.keys(b)).any(axis=1).all()


def test_components(spark):
    r = random.Random(0)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(40)] + [(900, 900)]
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b), near[b].add(a)
    want = {}
    for s in sorted(near):
        todo = [s]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = s
                todo += near[x]
    want.pop(900)
    want = {k: v for k, v in want.items() if any(m != k for m in near[k])}
    got = {x.node: x.component for x in C.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want


def test_exact_compares_all_that_meet(spark, monkeypatch):
    """With a distance that rules out nearly all, links are lost, unless all that meet are compared."""
    rows = corpus(6)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    monkeypatch.setitem(N.SCHEMES, 85, N.SCHEMES[85]._replace(far=1))
    shown = lambda found: sorted(tuple(r) for r in found.collect() if r.doc_id is not None)
    assert shown(N.near_duplicates(df)) != want
    assert shown(N.near_duplicates(df, exact=True)) == want
