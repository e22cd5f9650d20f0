import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import perturb, resample, reshape
from plumbline.operators import stats as D


def scores(spark, rows):
    return spark.createDataFrame(rows, "score double, label int")


def plain_auc(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_auc(spark):
    rows = [(0.1, 0), (0.4, 1), (0.4, 0), (0.8, 1)]
    assert D.roc_auc(scores(spark, rows)).first().auc == 0.875
    r = random.Random(0)
    rows = [(r.choice([0.1, 0.2, 0.3, 0.7]), int(r.random() < 0.4)) for _ in range(200)]
    df = scores(spark, [*rows, (None, 1), (float("nan"), 0), (0.5, None)])
    assert D.roc_auc(df).first().auc == pytest.approx(plain_auc(rows))
    assert resample.auc(*map(np.array, zip(*rows))) == pytest.approx(plain_auc(rows))
    assert math.isnan(D.roc_auc(scores(spark, [(0.1, 1)])).first().auc)
    curve = sorted((p.fpr, p.tpr) for p in D.roc_curve(df).collect())
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(curve, curve[1:]))
    assert curve[0] == (0, 0) and curve[-1] == (1, 1) and area == pytest.approx(plain_auc(rows))
    assert D.pr_auc(scores(spark, [(0.9, 1), (0.8, 0), (0.7, 1)])).first().ap == pytest.approx(0.5 + 0.5 * 2 / 3)


def test_thresholds(spark):
    df = scores(spark, [(0.2, 0), (0.4, 1), (0.6, 0), (0.8, 1)])
    swept = D.rates(D.sweep(df, D.unit_grid(df)))
    at = {round(r.tau, 2): r for r in swept.collect()}
    assert (at[0.5].tp, at[0.5].fp, at[0.5].fn, at[0.5].tn) == (1, 1, 1, 1) and at[0.5].f1 == 0.5
    assert at[1.0].precision == at[1.0].f1 == 0.0
    best = D.best_tau_by_f1(swept).first()
    assert best.f1 == pytest.approx(0.8) and best.tau == pytest.approx(0.4)
    assert D.youden(swept).first().tau == pytest.approx(0.21)
    assert D.degenerate_f1(df).first().f1 == pytest.approx(2 / 3)
    tiers = df.withColumn("tier", F.when(F.col("label") == 1, "pos").otherwise("easy"))
    kept = D.retention_sweep(tiers, D.gate_grid(df), "tier", "pos")
    assert D.recommended_threshold(kept.filter("is_positive"), 0.99).first().tau == pytest.approx(0.4)
    assert D.recommended_threshold(kept.filter("is_positive and tau > 0.5"), 0.99).first().tau == pytest.approx(0.51)


def test_percentiles(spark):
    v = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 10)], "v double")
    got = D.order_statistics(v, F.col("v"), {"p95": D.linear(0.95), "n": D.nearest(0.95)}).first()
    assert got.p95 == pytest.approx(8.8) and got.n == 10
    bins = {r.bin: r.n for r in D.histogram(v, "v", 1.0, 10.0, 3).collect()}
    assert bins == {1: 3, 2: 1, 3: 1}


def test_order_statistics_in_ranges(spark, monkeypatch):
    """Of groups that no task holds, as numpy finds them."""
    from plumbline.operators import order

    r = np.random.default_rng(3)
    rows = [(g, float(x)) for g in "ab" for x in np.round(r.normal(size=700), 2)] + [("c", 1.5), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    wanted = {"p05": D.linear(0.05), "p50": D.linear(0.5), "p99": D.linear(0.99), "d00": D.nearest(0.0), "d95": D.nearest(0.95), "d100": D.nearest(1.0)}
    for most in (1_000_000, 50):
        monkeypatch.setattr(order, "ONE_TASK", most)
        got = {x.g: x for x in D.order_statistics(df, F.col("v"), wanted, ("g",)).collect()}
        for g in "abc":
            v = [x for k, x in rows if k == g and x is not None]
            for name, (kind, p) in wanted.items():
                want = np.quantile(v, p, method="linear" if kind == "linear" else "inverted_cdf")
                assert got[g][name] == pytest.approx(want), (g, name)
    assert D.order_statistics(df.limit(0), F.col("v"), wanted).first().p50 is None


def test_resampling(spark):
    r = np.random.default_rng(1)
    rows = [(float(r.normal(y)), int(y)) for y in (r.random(120) < 0.5)]
    df = scores(spark, rows)
    a = resample.bootstrap_auc(df, n=300).first()
    assert a.ci_lo < a.point < a.ci_hi and a.point == pytest.approx(plain_auc(rows))
    assert tuple(a) == tuple(resample.bootstrap_auc(df.repartition(3), n=300).first())
    assert math.isnan(resample.bootstrap_auc(scores(spark, [(0.5, 1)]), n=10).first().point)
    noise = df.withColumn("other", F.lit(0.5))
    assert resample.permutation_test(noise, "score", "other", "label", 300).first().p < 0.05
    assert resample.permutation_test(noise, "score", "score", "label", 100).first().p == 1.0
    both = df.withColumn("y", F.lit(2.0))
    assert resample.bootstrap_ratio(both, "score", "y", 200).first().point == pytest.approx(sum(s for s, _ in rows) / 240)
    w = resample.dirichlet_weights(spark, ("a", "b"), 50)
    assert w.count() == 50 and w.filter(F.abs(F.col("a") + F.col("b") - 1) > 1e-9).count() == 0


def test_reshaping(spark):
    rows = spark.createDataFrame([(1, "q1", 1.0), (1, "q2", 0.0), (2, "q1", 1.0)], "id int, q string, v double")
    got = {r.id: (r.q1, r.q2, r.q3) for r in reshape.pivot(rows, ("id",), "q", "v", ("q1", "q2", "q3")).collect()}
    assert got == {1: (1.0, 0.0, None), 2: (1.0, None, None)}
    with pytest.raises(Exception, match="two values"):
        reshape.pivot(rows.union(rows), ("id",), "q", "v", ("q1",)).collect()
    assert reshape.quotas(10, 3) == [4, 3, 3]
    with pytest.raises(Exception, match="unknown label"):
        rows.select(reshape.binary_label(F.col("q"), ("q1",), ("no",))).collect()


def test_edits_are_labelled_and_repeatable(spark):
    answer = "The Markov Decision Process has 12 states. It improves the method a lot."
    rows = spark.createDataFrame([("a", answer, ["Support Vector Machine is used.", "LSTM too."], ["Bread needs flour. And salt."]), ("b", "", None, None)], "qid string, answer string, passages array<string>, distractors array<string>")
    got = perturb.apply_all(rows).collect()
    made = {r.operator for r in got if r.qid == "a"}
    assert made == {"original", *(e.__name__ for e in perturb.EDITS)}
    assert [r.operator for r in got if r.qid == "b"] == ["original"]
    assert all(r.text != answer for r in got if r.qid == "a" and r.operator != "original")
    assert {r.operator for r in got if r.hallucinated} == perturb.BREAKING
    pads = {r.text for r in got if r.operator == "off_topic_padding"}
    assert pads == {answer + " Bread needs flour. And salt."}
    assert sorted(map(str, got)) == sorted(map(str, perturb.apply_all(rows.repartition(2)).collect()))
