"""Which documents hold which texts; running sums; negatives; whole grids; edits."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import dense, irmetrics, judge, order, perturb, resample, sparse, stats


@pytest.mark.parametrize("few", [True, False])
def test_containing_equals_brute_force(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(sparse, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(sparse.small, "__defaults__", (0,))
    r = random.Random(2)
    words = ["ab", "abc", "b", "c", "cd", "x\ny", "  ", "é"]
    docs = [(i, " ".join(r.choices(words, k=r.randint(0, 9)))) for i in range(80)] + [(200, None)]
    items = [(i, " ".join(r.choices(words, k=r.randint(1, 5)))) for i in range(25)] + [(90, "b"), (91, "b c"), (92, ""), (93, None), (94, "none of this")]
    got = judge.containing(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "qid long, qtext string")).collect()
    want = {(q, d) for q, t in items for d, text in docs if t is not None and text is not None and t in text}
    assert sorted((g.qid, g.doc_id) for g in got) == sorted(want)


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_running_sums(spark, monkeypatch, most):
    monkeypatch.setattr(order, "ONE_TASK", most)
    r = random.Random(1)
    rows = [(r.choice("ab"), i * r.choice([1, 1, 7]), r.randint(0, 5)) for i in range(300)]
    rows = list({(g, s): (g, s, v) for g, s, v in rows}.values())
    df = spark.createDataFrame(rows, "g string, s int, v int").repartition(5)
    got = order.running(df, [F.desc("s")], {"before": F.col("v")}, ("g",)).collect()
    assert len(got) == len(rows)
    for x in got:
        assert x.before == sum(v for g, s, v in rows if g == x.g and s > x.s)
    scored = spark.createDataFrame([(r.random() if i % 3 else 0.5, i % 2, "xy"[i % 2 == 0 and i % 5 == 0]) for i in range(200)], "score double, label int, by string")
    whole = stats.roc_auc(scored).first().auc
    s, y = zip(*[(x.score, x.label) for x in scored.collect()])
    pairs = [(a > b) + 0.5 * (a == b) for a, p in zip(s, y) for b, q in zip(s, y) if p == 1 and q == 0]
    assert whole == pytest.approx(sum(pairs) / len(pairs))
    assert stats.dropped(spark.createDataFrame([(None, 1), (float("nan"), None), (1.0, None), (1.0, 0)], "score double, label int")).first() == (2, 1, 1)


def test_random_negatives(spark, monkeypatch):
    monkeypatch.setattr(order, "ONE_TASK", 0)
    docs = spark.createDataFrame([(i,) for i in range(50)], "doc_id long")
    asked = spark.createDataFrame([(q,) for q in range(6)], "qid long")
    rel = spark.createDataFrame([(0, i) for i in range(48)] + [(1, 3)], "qid long, doc_id long")
    got = defaultdict(list)
    for x in irmetrics.random_negatives(asked, docs, rel, 5).orderBy("place").collect():
        got[x.qid].append(x.doc_id)
    assert {q: len(d) for q, d in got.items()} == {0: 2, **dict.fromkeys(range(1, 6), 5)}
    assert set(got[0]) == {48, 49} and 3 not in got[1] and len({tuple(d) for d in got.values()}) == 6


def test_grid_equals_single_cells(spark):
    r = random.Random(4)
    hits = [(c, q, d, i + 1) for c in ("x", "y") for q in range(5) for i, d in enumerate(r.sample(range(30), 10))]
    rel = spark.createDataFrame([(q, d) for q in range(4) for d in r.sample(range(30), 6)], "qid long, doc_id long")
    asked = spark.createDataFrame([(q,) for q in range(5)], "qid long")
    df = spark.createDataFrame(hits, "config string, qid long, doc_id long, rank int")
    got = {(g.config, g.k, g.qid): (g.ndcg, g.recall, g.mrr) for g in irmetrics.grid_metrics(asked, df, rel, (3, 10)).collect()}
    assert len(got) == 20
    for c in ("x", "y"):
        for k in (3, 10):
            for g in irmetrics.binary_metrics(asked, df.filter((F.col("config") == c) & (F.col("rank") <= k)), rel, k).collect():
                assert got[c, k, g.qid] == pytest.approx((g.ndcg, g.recall, g.mrr))
    corpus = spark.createDataFrame([(d,) for d in range(10)], "doc_id long")
    usable, known = irmetrics.judged(asked, spark.createDataFrame([(0, 99), (1, 5)], "qid long, doc_id long"), corpus)
    assert [x.qid for x in usable.collect()] == [1] and known.count() == 1
    assert irmetrics.candidate_ratio(5, corpus).first() == (0.5, True)


def test_tiles_equal_one_block(spark, monkeypatch):
    r = np.random.default_rng(3)
    v = spark.createDataFrame([(i, r.normal(size=4).tolist()) for i in range(90)], "doc_id long, vec array<double>")
    q = spark.createDataFrame([(i, r.normal(size=4).tolist()) for i in range(25)], "qid long, vec array<double>")
    run = lambda m, **o: sorted(map(tuple, dense.search(v, q, 6, m, **o).collect()))
    want = {m: run(m) for m in ("cosine", "dot", "l2")}
    monkeypatch.setattr(dense, "QUERY_BYTES", 300)
    for m, rows in want.items():
        assert run(m) == rows
        plan = dense.search(v, q, 6, m)._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan


def test_bm25_of_many_queries(spark, monkeypatch):
    r = random.Random(6)
    docs = spark.createDataFrame([(i, " ".join(r.choices("the a cat dog tree of".split(), k=r.randint(0, 12)))) for i in range(60)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, " ".join(r.choices("the cat tree zebra".split(), k=2))) for i in range(9)], "qid long, qtext string")
    want = sorted(map(tuple, sparse.search(docs, asked, 5).collect()))
    monkeypatch.setattr(sparse, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(sparse, "HOT_POSTINGS", 10)
    assert sorted(map(tuple, sparse.search(docs, asked, 5).collect())) == want


def test_edits_by_column(spark):
    rows = [
        ("a", "It costs 12 and 0.50, not 123456789012345678 or 0.", ["The Grand Canal and NASA"], ["Other things. More."]),
        ("b", "NASA built it.  NASA, again", ["The Grand Canal is NASA land", "ESA"], []), ("c", "It IS fine and shows USES", [], None), (None, "can not", None, None), ("d", "   ", ["x"], ["y"]),
    ]
    df = spark.createDataFrame(rows, "qid string, answer string, passages array<string>, distractors array<string>")
    told = spark.createDataFrame([("c", "said by a model")], "qid string, text string")
    got = defaultdict(set)
    for x in perturb.apply_all(df, seeds=tuple(range(12)), paraphrases=told).collect():
        got[x.qid, x.operator].add(x.text)
    assert got["c", "paraphrase"] == {"said by a model"} and "d" not in {k for k, o in got if o != "original"}
    assert got["b", "entity_swap"] == {"The Grand Canal built it.  NASA, again", "ESA built it.  NASA, again"}
    assert ("c", "entity_swap") not in got and got["c", "negation"] == {"It is not fine and shows USES"}
    assert got[None, "negation"] == {"cannot not"}
    for text in got["a", "number_corruption"]:
        assert text != rows[0][1]
        a, b, long, c = re.fullmatch(r"It costs (\d+) and (\d+\.\d\d), not (\d+) or (\d+)\.", text).groups()
        changed = [(12, float(a)), (0.5, float(b)), (0, float(c))]
        assert sum(x != y for x, y in changed) + (long != "123456789012345678") == 1
        for old, new in changed:
            assert new == old or abs(new - old) >= 2 and (old != 0 or 50 <= new <= 998)
    assert len(got["a", "number_corruption"]) > 3
    assert got["b", "duplication"] == {"NASA built it.  NASA, again. NASA built it. NASA, again"}
    assert got["a", "off_topic_padding"] == {rows[0][1] + " Other things. More."} or len(got["a", "off_topic_padding"]) == 1


def test_more_intervals(spark):
    df = spark.createDataFrame([(float(i % 2), float(i % 3 == 0), float(i % 5 == 0)) for i in range(300)], "p double, a double, b double")
    s = resample.bootstrap_sum_of_means(df.filter("a = 1"), df.filter("a = 0"), "p", 300).first()
    assert s.point == pytest.approx(1.0) and s.ci_lo < 1 < s.ci_hi
    d = resample.bootstrap_ratio_difference(df, "p", "a", "b", 300).first()
    assert d.point == pytest.approx(0.0) and d.ci_lo < 0 < d.ci_hi
    assert resample.bootstrap_sum_of_means(df.limit(0), df, "p", 10).first().point != 0
