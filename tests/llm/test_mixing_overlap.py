"""Texts of several sources: the membership patterns of the query's and the pipeline's mixture."""

import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import mixing as M


def cost(words, size):
    full, part = divmod(words, size)
    return sum(c * size for c in range(full)) + full * part


@pytest.mark.parametrize("seed", range(10))
def test_routes_are_cheapest(seed):
    r = random.Random(seed)
    sets = [frozenset(x) for n in (1, 2) for x in itertools.combinations("abc", n)]
    patterns = [(s, r.randint(1, 3)) for s in r.sample(sets, 3)]
    limits = [{s: r.randint(0, 3) for s in p} for p, _ in patterns]
    quotas = {s: r.randint(0, 4) for s in "abc"}
    edges = [(i, s) for i, (p, _) in enumerate(patterns) for s in sorted(p)]
    best = None
    for give in itertools.product(*[range(limits[i][s] + 1) for i, s in edges]):
        by_source, by_pattern = defaultdict(int), defaultdict(int)
        for (i, s), words in zip(edges, give, strict=True):
            by_source[s] += words
            by_pattern[i] += words
        if all(by_source[s] <= quotas[s] for s in by_source):
            key = (-sum(give), sum(cost(w, patterns[i][1]) for i, w in by_pattern.items()))
            best = key if best is None else min(best, key)
    got = M.routes(patterns, quotas, 2, limits)
    assert all(0 <= got[e] <= limits[e[0]][e[1]] for e in edges)
    words = [sum(got[i, s] for s in p) for i, (p, _) in enumerate(patterns)]
    assert all(sum(got[i, s] for i, (p, _) in enumerate(patterns) if s in p) <= quotas[s] for s in quotas)
    assert (-sum(words), sum(cost(w, size) for w, (_, size) in zip(words, patterns, strict=True))) == best


def overlapping(seed=3):
    """Half of the texts are in one source of three, half in two."""
    r, rows = random.Random(seed), []
    for t in range(400):
        text = " ".join([f"t{t}"] * r.randint(1, 9))
        for s in r.sample(["a", "b", None], r.choice([1, 2])):
            rows.append((len(rows), text, s))
    return rows


@pytest.mark.parametrize("few", [True, False])
def test_flow_carries_the_mixture(spark, monkeypatch, few):
    seen, real = [], M._search
    monkeypatch.setattr(M, "_search", lambda patterns, *a: (seen.extend(p for p, _ in patterns.values()), real(patterns, *a))[1])
    if not few:
        monkeypatch.setattr(M, "BROADCAST_TEXTS", 0)
        monkeypatch.setattr(M, "BROADCAST_PATTERNS", 0)
    rows = overlapping()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as _x", "'o' as taken")
    run = lambda: M.mix_sources(docs, F.col("source"), weights=(1,), share=M.Fraction(1, 3)).collect()
    got = run()
    assert {len(p) for p in seen} == {1, 2}  # the search saw patterns of several sources
    assert sorted(map(str, got)) == sorted(map(str, run()))
    size, taken, by_text = defaultdict(int), defaultdict(int), defaultdict(int)
    for g in got:
        size[g.source] += g.size
        taken[g.source] += g.taken
        by_text[g.text] += g.taken // g.size
    total = sum(size.values())
    assert all(g.source_size == size[g.source] and g.target == pytest.approx(total / 9) for g in got)
    assert all(abs(taken[s] - total / 9) <= 5 for s in size)
    assert sum(c > 1 for c in by_text.values()) <= 2  # there are texts enough: none is repeated
    once = M.mix_sources(docs, F.col("source"), weights=(1,), share=M.Fraction(3, 2)).collect()
    assert all(0 <= g.taken <= 2 * g.size for g in once)
    assert sum(g.taken for g in once) == pytest.approx(1.5 * total, abs=15)


def test_many_copies_of_one_text(spark):
    rows = [(i, "x y z", "ab"[i % 2]) for i in range(500)] + [(1000 + i, f"own {i}", "a") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = M.mix_sources(docs, F.col("source")).collect()
    taken = defaultdict(int)
    for g in got:
        taken[g.source] += g.taken
    assert all(abs(taken[g.source] - g.target) <= 3 for g in got)


def test_pipeline_stage_goes_through_the_flow(spark, monkeypatch):
    seen, real = [], M._search
    monkeypatch.setattr(M, "_search", lambda patterns, *a: (seen.extend(p for p, _ in patterns.values()), real(patterns, *a))[1])
    docs = spark.createDataFrame(overlapping(), "doc_id long, text string, source string")
    assert corpus_pipeline.mixture(spark, docs, "").count() > 0
    assert {len(p) for p in seen} == {1, 2}
