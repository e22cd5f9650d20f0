import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.llm import quality as Q


def made(n=400, seed=2):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = r.random() < (0.9 if i % 3 else 0.5)
        word = lambda: "".join(r.choices("etaoinshr", k=r.randint(2, 8)))
        text = " ".join(word() if good else word().upper() + "!!" for _ in range(r.randint(5, 80)))
        rows.append((i, text, ["bad.org", "a.org", "b.org"][i % 3], "en" if i % 2 else None, 7.0, "x"))
        if r.random() < 0.7:
            labels.append((i, int(good)))
    return rows, labels


SCHEMA = "doc_id long, text string, source string, lang string, _n double, keep string"


def test_equals_brute_force(spark):
    rows, labels = made()
    rows += [(5000, None, None, None, 1.0, "x"), (5001, "", "a.org", "en", 1.0, "x"), (5002, "lone words here", "only.org", "en", 1.0, "x"), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame([*labels, (99999, 1), (3, None), (None, 1)], "doc_id long, quality int")
    got = Q.posterior(docs, marks, F.col("source"), F.col("lang")).collect()
    assert len(got) == len(rows)
    host, path = defaultdict(list), defaultdict(list)
    for g in got:
        host[g.source].append(g.evidence)
        path[g.source, g.lang].append(g.evidence)
    n = len(got)
    mean = sum(g.evidence for g in got) / n
    noise, sq = mean * (1 - mean), sum(len(h) * (sum(h) / len(h)) ** 2 for h in host.values())
    between = (sq - n * mean**2 - (len(host) - 1) * noise) / (n - sum(len(h) ** 2 for h in host.values()) / n)
    strength = min(max(noise / between - 1 if between > 0 else 1e4, 1), 1e4)
    lo = lambda p: math.log(p / (1 - p))
    for g in got:
        h, p = host[g.source], path[g.source, g.lang]
        rate = (sum(h) - g.evidence + strength * mean) / (len(h) - 1 + strength)
        assert g.host_rate == pytest.approx(rate)
        sub = (sum(p) - g.evidence + Q.PATH_STRENGTH * rate) / (len(p) - 1 + Q.PATH_STRENGTH)
        assert g.path_rate == pytest.approx(sub)
        assert g.quality == pytest.approx(1 / (1 + math.exp(-lo(g.evidence) - Q.SITE_WEIGHT * (lo(sub) - lo(mean)))))
        assert g.keep == (g.quality >= Q.LEAST)
    truth = dict(labels)
    right = [g.keep == bool(truth[g.doc_id]) for g in got if g.doc_id in truth]
    assert sum(right) / len(right) > 0.97


def test_salted_equals_broadcast(spark, monkeypatch):
    rows, labels = made(60)
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")
    run = lambda: sorted((g.doc_id, round(g.quality, 9)) for g in Q.posterior(docs, marks, F.col("source"), F.col("lang")).collect())
    want = run()
    monkeypatch.setattr(Q, "BROADCAST_SITES", 0)
    assert run() == want


def test_no_labels_and_no_rows(spark):
    rows, _ = made(20)
    docs, none = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], "doc_id long, quality int")
    got = Q.posterior(docs, none, F.col("source"), F.col("lang")).collect()
    assert {g.evidence for g in got} == {0.5} and all(g.keep for g in got)
    assert Q.posterior(docs.limit(0), none, F.col("source"), F.col("lang")).count() == 0
