import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.operators import dense, fusion, irmetrics, sparse

DOCS = [(1, "the cat sat on the mat"), (2, "a dog and a cat"), (3, "birds fly"), (4, ""), (5, "the cat sat on the mat")]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def bm25(query, k1=1.5, b=0.75):
    docs = {i: t.split() for i, t in DOCS}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(w for t in docs.values() for w in set(t))
    out = {}
    for i, t in docs.items():
        s = 0.0
        for w in query.split():
            f = t.count(w)
            s += math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * f * (k1 + 1) / (f + k1 * (1 - b + b * len(t) / avg))
        if s > 0:
            out[i] = s
    return sorted(out.items(), key=lambda x: (-round(x[1], 9), x[0]))


def test_bm25_counts_repeated_query_terms(spark):
    queries = ["cat", "cat cat dog", "nothing known", "birds the"]
    got = sparse.search(frame(spark, DOCS, "doc_id long, text string"), frame(spark, list(enumerate(queries)), "qid long, qtext string"), 3).orderBy("qid", "rank").collect()
    for i, q in enumerate(queries):
        assert [(r.doc_id, pytest.approx(r.score)) for r in got if r.qid == i] == bm25(q)[:3]


def test_dense_order_and_padding(spark, monkeypatch):
    v = frame(spark, [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 3.0]), (4, [0.0, 0.0]), (5, [2.0, 0.0]), (6, None)], "doc_id long, vec array<double>")
    q = frame(spark, [(0, [1.0, 0.0]), (7, [0.0, 1.0])], "qid long, vec array<double>")
    rows = lambda **k: [(r.qid, r.doc_id) for r in dense.search(v, q, 10, **k).orderBy("qid", "rank").collect()]
    assert rows() == [(0, 1), (0, 5), (0, 3), (0, 2), (0, 4), (7, 2), (7, 3), (7, 1), (7, 4), (7, 5)]
    assert rows(metric="l2")[:3] == [(0, 1), (0, 4), (0, 5)]
    monkeypatch.setattr(dense, "QUERY_BYTES", 8)  # one query at a time
    monkeypatch.setattr(dense, "HELD", 2)
    assert rows(metric="dot")[:3] == [(0, 3), (0, 5), (0, 1)]
    assert dense.search(v, q.limit(0), 3).count() == 0


def test_rrf(spark):
    hits = lambda ids: frame(spark, [(0, i, r + 1) for r, i in enumerate(ids)], "qid long, doc_id string, rank int")
    got = fusion.rrf(hits("ABC"), hits("CAB"), 5).orderBy("rank").collect()
    assert [(r.doc_id, pytest.approx(r.score)) for r in got] == [("A", 1 / 61 + 1 / 62), ("C", 1 / 63 + 1 / 61), ("B", 1 / 62 + 1 / 63)]
    tied = fusion.rrf(hits("A"), hits("B"), 5).orderBy("rank").collect()
    assert [r.doc_id for r in tied] == ["A", "B"]  # the dense leg comes first


def test_hash_embedder_and_cosine(spark):
    import hashlib

    v = {r.doc_id: r.vec for r in dense.hash_counts(frame(spark, DOCS, "doc_id long, text string"), "doc_id", "text").collect()}
    want = [0.0] * 64
    for w in DOCS[0][1].split():
        want[int(hashlib.md5(w.encode()).hexdigest(), 16) % 64] += 1
    assert v[1] == want and 4 not in v
    row = frame(spark, [([3.0, 4.0], [0.0, 0.0], [4.0, 3.0])], "a array<double>, z array<double>, b array<double>")
    got = row.select(dense.cosine(F.col("a"), F.col("b")).alias("c"), dense.cosine(F.col("a"), F.col("z")).alias("none"), dense.normalised(F.col("a")).alias("n"), dense.normalised(F.col("z")).alias("m")).first()
    assert got.c == pytest.approx(0.96) and got.none == 0 and got.n == [0.6, 0.8] and got.m == [0.0, 0.0]


def test_ranking_metrics(spark):
    q = frame(spark, [(0,), (1,), (2,)], "qid long")
    hits = frame(spark, [(0, 5, 1), (0, 7, 2), (0, 9, 3), (1, 5, 1), (2, 5, 1)], "qid long, doc_id long, rank int")
    rel = frame(spark, [(0, 7), (0, 9), (0, 9), (0, 11), (1, 6)], "qid long, doc_id long")
    got = {r.qid: r for r in irmetrics.binary_metrics(q, hits, rel, 2).collect()}
    ideal = 1 + 1 / math.log2(3)
    assert got[0].ndcg == pytest.approx((1 / math.log2(3)) / ideal) and got[0].recall == pytest.approx(1 / 3)
    assert (got[0].mrr, got[0].mrr_at_k) == (0.5, 0.5)
    assert tuple(got[1])[1:] == tuple(got[2])[1:] == (0.0, 0.0, 0.0, 0.0)
    gains = frame(spark, [(0, 9, 2), (0, 7, 1), (0, 99, 2)], "qid long, doc_id long, gain int")
    graded = {r.qid: r.ndcg for r in irmetrics.graded_ndcg(q, hits, gains, 3).collect()}
    assert graded[0] == pytest.approx((1 / math.log2(3) + 2 / 2) / (2 + 2 / math.log2(3) + 1 / 2)) and graded[2] == 0
    assert [(r.doc_id, r.place) for r in irmetrics.hard_negatives(hits, rel, 1).orderBy("qid").collect()] == [(5, 1), (5, 1), (5, 1)]
    corpus = frame(spark, [(i,) for i in range(20)], "doc_id long")
    drawn = irmetrics.random_negatives(q, corpus, rel, 4).collect()
    assert len(drawn) == 12 and not {(r.qid, r.doc_id) for r in drawn} & {(0, 7), (0, 9), (0, 11), (1, 6)}
