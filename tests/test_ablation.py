"""Arms over the same questions: routed records, paired differences, the verdict, the question set."""

import pytest
from pyspark.sql import functions as F

from plumbline.config import Config
from plumbline.plans import ablation
from plumbline.plans.engine import Engine

TEXTS = ["Bread needs flour and water and salt.", "Boats need wind and a sail to move.", "Chains have states in order."]


def test_arms(spark):
    config = Config(k=1, retrieval_mode="dense", retrieval_gate=0.3, abstain_threshold=0.1, route_iterate_margin=0.3)
    engine = Engine(spark, config).index_texts(TEXTS)
    asked = spark.createDataFrame([(0, TEXTS[0], True), (1, "zzz qqq", False), (2, "bread salt order", False)], "qid long, question string, answerable boolean")
    got = {(r.arm, r.qid): r for r in ablation.records(engine.passages, engine.vectors, asked, config).collect()}
    assert len(got) == 9
    assert not got["single", 0].abstained and got["routed", 0][3:] == got["single", 0][3:]
    assert got["routed", 1].abstained and got["routed", 1].calls == 0 and got["single", 1].calls == 0
    way = {r.qid: r.route for r in engine.route(asked).collect()}
    for q in range(3):
        if way[q] == "iterative":
            assert got["routed", q][3:] == got["iterative", q][3:]


def records(spark, single, other):
    rows = [(arm, i, i % 2 == 0, d, 0.5, c) for arm, flags, c in (("single", single, 1), ("routed", other, 3)) for i, d in enumerate(flags)]
    return spark.createDataFrame(rows, "arm string, qid long, answerable boolean, abstained boolean, trust double, calls long")


def test_differences_and_verdict(spark):
    n = 40
    worst, best = [i % 2 == 0 for i in range(n)], [i % 2 == 1 for i in range(n)]
    found = ablation.differences(records(spark, worst, best), "routed", n=200)
    rows = {r.statistic: r for r in found.collect()}
    assert rows["answered_rate"].point == rows["abstention_rate"].point == 1.0 and rows["youden_j"].point == 2.0
    assert rows["abstention_precision"].point == 1.0 and rows["mean_calls"].point == 2.0
    assert ablation.verdict("routed", found).startswith("routed HELPS: Youden's J +2.000") and "calls a question +2.000" in ablation.verdict("routed", found)
    assert "HURTS" in ablation.verdict("routed", ablation.differences(records(spark, best, worst), "routed", n=200))
    assert "NOT AN IMPROVEMENT" in ablation.verdict("routed", ablation.differences(records(spark, best, best), "routed", n=200))


def test_question_set(spark):
    frame = lambda p, n: spark.createDataFrame([(f"{p}{i}",) for i in range(n)] + [(None,), (f"{p}0",)], "question string")
    got = ablation.query_set(frame("a", 10), {"y": frame("y", 5), "x": frame("x", 5), "z": frame("z", 1)}, 4, 8).collect()
    count = {t: sum(r.tier == t for r in got) for t in ("corpus", "x", "y", "z")}
    assert count == {"corpus": 4, "x": 3, "y": 3, "z": 1}
    assert all(r.answerable == (r.tier == "corpus") and r.question for r in got) and len({r.question for r in got}) == len(got)
