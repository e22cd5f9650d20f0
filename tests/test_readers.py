"""Small files of each benchmark format, read back."""

import csv
import json

import pytest

from plumbline.sources import datasets


def shown(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_title_and_text_are_one(spark, tmp_path):
    rows = [("d1", "A title", "and a text."), ("d2", "", "text alone"), ("d3", None, "no title"), ("d4", "title alone", None)]
    spark.createDataFrame(rows, "_id string, title string, text string").write.parquet(str(tmp_path / "corpus"))
    assert shown(datasets.beir_corpus(spark, str(tmp_path / "corpus"))) == [("d1", "A title and a text."), ("d2", "text alone"), ("d3", "no title"), ("d4", "title alone")]


def test_queries_and_judgments(spark, tmp_path):
    spark.createDataFrame([("q1", "what?"), ("q2", None)], "_id string, text string").write.parquet(str(tmp_path / "queries"))
    assert shown(datasets.beir_queries(spark, str(tmp_path / "queries"))) == [("q1", "what?")]
    (tmp_path / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t2\nq1\td2\t0\nq2\td1\t1\n")
    assert shown(datasets.qrels(spark, str(tmp_path / "test.tsv"))) == [("q1", "d1", 2), ("q2", "d1", 1)]


def test_responses_with_two_kinds_of_hallucination(spark, tmp_path):
    kind = "struct<evident_conflict: int, baseless_info: int>"
    rows = [("1", "QA", "c", "o", (1, 0)), ("2", "Summary", "c", "o", (0, 2)), ("3", "QA", "c", "o", (1, 1)), ("4", "QA", "c", "o", (0, 0)), ("5", "QA", "c", "o", None), ("6", "QA", "c", "o", (None, 1))]
    spark.createDataFrame(rows, f"id string, task_type string, context string, output string, hallucination_labels_processed {kind}").write.parquet(str(tmp_path / "r"))
    got = {r.id: (r.conflict, r.baseless, r.hallucinated, r.one_kind) for r in datasets.ragtruth(spark, str(tmp_path / "r")).collect()}
    assert got == {
        "1": (True, False, True, True), "2": (False, True, True, True), "3": (True, True, True, False),
        "4": (False, False, False, False), "5": (False, False, False, False), "6": (False, True, True, True),
    }
    some = datasets.subset(datasets.ragtruth(spark, str(tmp_path / "r")), "task_type", ("QA",))
    assert some.count() == 5
    with pytest.raises(ValueError, match="task_type"):
        datasets.subset(some, "task_type", ())


def test_attributed_answers(spark, tmp_path):
    with open(tmp_path / "a.csv", "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["query", "answer", "reference", "label"])
        out.writerows([["q", 'says "so",\nin lines', "ref", "Attributable"], ["q", "b", "ref", "Extrapolatory"], ["q", "c", "ref", "Contradictory"]])
    got = {r.answer: r.supported for r in datasets.attributed(spark, str(tmp_path / "a.csv")).collect()}
    assert got == {'says "so",\nin lines': 1, "b": 0, "c": 0}
    (tmp_path / "b.csv").write_text("answer,reference,label\na,b,Else\n")
    with pytest.raises(Exception, match="unknown label"):
        datasets.attributed(spark, str(tmp_path / "b.csv")).collect()


def test_summaries_in_one_language(spark, tmp_path):
    rows = [("g1", "en-US", "s", "m", "q", "Yes"), ("g2", "en-US", "s", "m", "q", "No"), ("g3", "en-US", "s", "m", "q", "Unsure"), ("g4", "de", "s", "m", "q", "Yes"), ("g5", None, "s", "m", "q", "Yes")]
    spark.createDataFrame(rows, "gem_id string, worker_lang string, summary string, model string, question string, answer string").write.parquet(str(tmp_path / "s"))
    assert {r.gem_id: r.value for r in datasets.summaries(spark, str(tmp_path / "s")).collect()} == {"g1": 1, "g2": 0, "g3": None}


def test_cited_sentences_and_golden_cases(spark, tmp_path):
    row = {"query_id": "q", "quotes": [{"idx": 1, "text": "t"}], "answers": [{"sentences": [{"index": 0, "text": "s [1]", "attributable": 1}]}], "more": 1}
    (tmp_path / "h.jsonl").write_text(json.dumps(row) + "\n")
    (got,) = datasets.cited_sentences(spark, str(tmp_path / "h.jsonl")).collect()
    assert got.quotes[0].idx == 1 and got.answers[0].sentences[0].attributable == 1
    cases = [{"question": "a?", "expect": "answer", "class": "in_corpus", "note": "n"}, {"question": "b?", "expect": "abstain", "class": "adversarial"}]
    (tmp_path / "g.json").write_text(json.dumps(cases, indent=1))
    assert shown(datasets.golden(spark, str(tmp_path / "g.json"))) == [("a?", "answer", "in_corpus", "n"), ("b?", "abstain", "adversarial", None)]
