import json

import pytest
from pyspark.sql import functions as F

from plumbline.__main__ import main
from plumbline.config import Config
from plumbline.plans.engine import Engine, arm_metrics, pass_rates, summary

TEXT = "\n".join(["Bread needs flour and water and salt.", "It rises in a warm place for hours.", "A sailing boat needs wind and a sail.", "The sea is wide and deep and cold."] * 3)


def test_engine(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text(f"## One\n{TEXT}\n## Two\nCats sit on mats all day long.\nDogs run over the fields at night.\n")
    config = Config(retrieval_mode="dense", k=2)
    engine = Engine(spark, config)
    with pytest.raises(ValueError):
        engine.answer(["x"])
    engine.index_dir(str(tmp_path / "in")).save(str(tmp_path / "index"))
    again = Engine(spark, config).load(str(tmp_path / "index"))
    asked = ["where do cats sit on mats all day long", "qqq www"]
    a, b = (sorted(map(str, e.answer(asked).drop("abstain_reason").collect())) for e in (engine, again))
    assert a == b and len(a) == 2
    hits = again.retrieve(asked, k=1).collect()
    assert [h.source for h in hits if h.qid == 0] == ["a.md"] and [h.page for h in hits if h.qid == 0] == [2]
    routes = {r.qid: r.route for r in again.route(asked).collect()}
    assert routes[0] != "abstain" and routes[1] == "abstain"
    one = summary(again.answer(asked)).first()
    assert one["count"] == 2 and one.abstained >= 1
    with pytest.raises(ValueError):
        Engine(spark).index_texts(spark.createDataFrame([], "passage_id long, text string"))
    _, results = again.answer_iterative(asked[:1])
    assert results.count() == 1


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "c").mkdir()
    (tmp_path / "c/a.txt").write_text(TEXT)
    (tmp_path / "q.json").write_text(json.dumps(["what does bread need", {"question": "what is the sea"}]))
    assert main(["index", str(tmp_path / "c"), str(tmp_path / "i"), "--mode", "dense"]) == 0
    assert main(["ask", str(tmp_path / "i"), "bread needs flour and water", "--mode", "dense"]) == 0
    assert main(["eval", str(tmp_path / "i"), str(tmp_path / "q.json"), str(tmp_path / "o"), "--mode", "dense"]) == 0
    assert spark.read.json(str(tmp_path / "o/results")).count() == 2
    assert "indexed" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["ask", str(tmp_path / "missing"), "x"])


def test_arms_and_golden_sets(spark):
    rows = [("single", True, False, 0.8, 1), ("single", True, True, 0.0, 0), ("single", False, True, 0.0, 0), ("single", False, False, 0.4, 1)]
    r = arm_metrics(spark.createDataFrame(rows, "arm string, answerable boolean, abstained boolean, trust double, calls int")).first()
    assert (r.answered_rate, r.abstention_rate, r.abstention_precision, r.youden_j, r.mean_trust) == (0.5, 0.5, 0.5, 0.0, pytest.approx(0.6))
    golden = [("in_corpus", "answer", False, 0.5), ("in_corpus", "answer", True, None), ("adversarial", "abstain", True, None)]
    got = {r.metric: r.value for r in pass_rates(spark.createDataFrame(golden, "class string, expect string, abstained boolean, trust_geometric double")).collect()}
    assert got == {"in_corpus_pass_rate": 0.5, "adversarial_pass_rate": 1.0, "overall_pass_rate": pytest.approx(2 / 3), "mean_geometric_trust": 0.5}
