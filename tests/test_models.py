"""Models that are plugged in, and what happens where they fail."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.config import Config
from plumbline.operators import trust
from plumbline.plans import agentic, models
from plumbline.plans.engine import Engine

TEXTS = ["Bread needs flour and water and salt.", "Boats need wind and a sail to move.", "Chains have states in order."]


vectors = (lambda: lambda texts: np.array([[t.lower().count(w) + 0.1 for w in ("bread", "boat", "chain")] for t in texts]))()  # goes to tasks by value


def test_function_models_answer(spark):
    def write(question, passages):
        return f"{passages[0]} [1]"

    def judge(premises, claims):  # neutral, entailment, contradiction: the model's own order
        return np.array([[0.1, 0.8 if c[:8] in p else 0.1, 0.1] for p, c in zip(premises, claims)])

    def ask(answer, n):
        if "Boats" in answer:
            raise RuntimeError("no answer from the model")
        return ["bread?", "more bread?"]

    own = models.Models(
        models.FunctionEmbedder("counts", vectors), models.FunctionNli(judge, ("NEUTRAL", "ENTAILMENT", "CONTRADICTION")), models.FunctionGenerator(write, ask),
        models.FunctionScorer(lambda q, t: np.array([float(len(x)) for x in t])),
    )
    config = Config(k=2, retrieval_mode="dense", rerank=True, answer_relevance=True, retrieval_gate=0.5)
    engine = Engine(spark, config, own).index_texts(TEXTS)
    got = {r.qid: r for r in engine.answer(["about bread", "about a boat"]).collect()}
    assert got[0].answer == TEXTS[0] + " [1]" or got[0].answer == TEXTS[1] + " [1]"  # the longer passage comes first
    assert got[0].faithfulness == pytest.approx(0.8) and got[0].contradiction_rate == pytest.approx(0.1)
    with_back = [r.answer_relevance for r in got.values()]
    assert any(x is not None for x in with_back) or all("Boats" in r.answer for r in got.values())
    with pytest.raises(ValueError, match="labels"):
        models.FunctionNli(judge, ("yes", "no", "maybe"))


def test_failed_back_questions_are_null(spark):
    def ask(answer, n):
        raise RuntimeError("down")

    gen = models.FunctionGenerator(lambda q, p: p[0], ask)
    engine = Engine(spark, Config(k=1, retrieval_mode="dense", answer_relevance=True, retrieval_gate=0.0, abstain_threshold=0.0), models.Models(generator=gen)).index_texts(TEXTS)
    (row,) = engine.answer(["bread"]).collect()
    assert row.answer == TEXTS[0] and row.answer_relevance is None and not row.abstained


def test_stored_vectors_and_answers(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    table = spark.createDataFrame([("a", [1.0, 2.0])], "t string, vec array<double>").select(models.text_key(F.col("t")).alias("text_key"), "vec")
    with pytest.raises(Exception, match="no vector is stored for: b"):
        models.LookupEmbedder("x", table).embed(rows, "id", "t").collect()
    other = models.LookupEmbedder("x", table, models.FunctionEmbedder("one", lambda t: np.ones((len(t), 2)), unit=False))
    assert {r.id: r.vec for r in other.embed(rows, "id", "t").collect()} == {1: [1.0, 2.0], 2: [1.0, 1.0]}
    hits = spark.createDataFrame([(0, "known?", 1, "p q r."), (1, "new?", 1, "a passage of text.")], "qid long, question string, rank int, passage string")
    told = spark.createDataFrame([("known?", "recorded")], "question string, text string")
    with pytest.raises(Exception, match="no answer is recorded"):
        models.RecordedGenerator(told).generate(hits).collect()
    both = models.RecordedGenerator(told, models.ExtractiveGenerator()).generate(hits)
    assert {r.qid: r.answer for r in both.collect()} == {0: "recorded", 1: "a passage of text. [1]"}


def test_registry():
    assert models.make(models.EMBEDDERS, "hash-64").name == "hash-64"
    with pytest.raises(ValueError, match="known: extractive"):
        models.make(models.GENERATORS, "other")


@pytest.mark.parametrize("bad", ["", None, "same", "error"])
def test_reformulation_that_fails_ends_the_rounds(spark, bad):
    def fn(q):
        if bad == "error":
            raise RuntimeError("down")
        return q if bad == "same" else bad

    engine = Engine(spark, Config(k=1, retrieval_mode="dense", retrieval_gate=0.0, abstain_threshold=0.99)).index_texts(TEXTS)
    rounds, results = agentic.iterate(engine.passages, engine.vectors, engine._asked(["bread and wind"]), engine.config, models.FunctionReformulator(fn))
    assert [(r["round"], r.stop_reason) for r in rounds.collect()] == [(1, "reformulation_unavailable")]
    assert results.count() == 1


def test_gates_leave_only_what_is_known(spark):
    engine = Engine(spark, Config(k=2, retrieval_mode="dense", retrieval_gate=0.99)).index_texts(TEXTS)
    (row,) = engine.answer(["wind of another kind"]).collect()
    assert row.abstain_reason.startswith("retrieval") and row.relevance is not None
    assert [row[c] for c in ("faithfulness", "contradiction_rate", "attribution", "conciseness", "best_support")] == [None] * 5
    engine.config = Config(k=2, retrieval_mode="dense", retrieval_gate=0.0, abstain_threshold=1.1)
    (row,) = engine.answer(["wind of another kind"]).collect()
    assert row.abstain_reason.startswith("support") and row.faithfulness is not None and row.contradiction_rate is not None
    assert [row[c] for c in ("relevance", "attribution", "conciseness")] == [None] * 3 and row.t_geom == 0


def test_display_and_mapping(spark):
    cites = spark.createDataFrame([(0, 1, 2), (0, 0, 2), (0, 1, 2), (0, 2, 1)], "qid long, claim_idx int, cited_rank int")
    assert {(r.qid, r.cited_rank): r.claims for r in trust.cited_by(cites).collect()} == {(0, 2): [0, 1], (0, 1): [2]}
    rows = spark.createDataFrame([(1, "a b", "a c")], "qid long, answer string, reference string")
    claims, hits, cited = trust.attribution_inputs(rows)
    assert (claims.first().claim, hits.first().passage, cited.first().cited_rank) == ("a b", "a c", 1)
    with pytest.raises(Exception, match="no answer or reference: 2"):
        trust.attribution_inputs(spark.createDataFrame([(2, None, "x")], rows.schema))[0].collect()
    answered = spark.createDataFrame([(1, False, "x"), (2, True, "y"), (3, False, " ")], "qid long, abstained boolean, answer string")
    assert [r.qid for r in trust.real_answers(answered).collect()] == [1]
