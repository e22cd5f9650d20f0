import json

import pytest
from pyspark.sql import functions as F

from plumbline.plans import agentic
from plumbline.config import Config
from plumbline.operators import dense
from plumbline.sources import corpus, datasets, store


def test_corpus_of_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    long = "\n".join(f"a line of text number {i}" for i in range(12))
    (tmp_path / "b.md").write_text(f"intro\n## One\n{long}\n## Two\n{long}\nmore than that\n")
    (tmp_path / "sub" / "a.txt").write_text(long)
    (tmp_path / "skip.bin").write_bytes(b"\0")
    files = corpus.read_corpus(spark, str(tmp_path))
    found = corpus.passages(files).orderBy("passage_id").collect()
    assert [r.passage_id for r in found] == list(range(len(found)))
    assert [r.source for r in found] == sorted(r.source for r in found) and {r.source for r in found} == {"b.md", "sub/a.txt"}
    assert {r.page for r in found if r.source == "b.md"} == {1, 2}
    with pytest.raises(ValueError):
        corpus.read_corpus(spark, str(tmp_path / "skip.bin"))
    with pytest.raises((FileNotFoundError, Exception)):
        (tmp_path / "empty").mkdir()
        corpus.read_corpus(spark, str(tmp_path / "empty"))
    blurbs = spark.createDataFrame([(0, "Context: about One."), (1, None)], "passage_id long, sentence string")
    made = {r.passage_id: r for r in corpus.contextualised(corpus.passages(files), blurbs).collect()}
    assert made[0].text.startswith("about One. ") and made[0].source_text == found[0].text and made[1].text == found[1].text


def test_index_round_trip(spark, tmp_path):
    p = spark.createDataFrame([(0, "a b", "a b")], "passage_id long, text string, source_text string")
    v = dense.hash_counts(p, "passage_id", "text")
    store.save_index(str(tmp_path / "i"), "hash-64", "hybrid", p, v)
    mode, passages, vectors = store.load_index(spark, str(tmp_path / "i"), "hash-64")
    assert mode == "hybrid" and passages.collect() == p.collect() and vectors.collect() == v.collect()
    with pytest.raises(ValueError):
        store.load_index(spark, str(tmp_path / "i"), "other")
    store.save_index(str(tmp_path / "s"), "none", "sparse", p.drop("source_text"), None)
    _, passages, vectors = store.load_index(spark, str(tmp_path / "s"), "none")
    assert vectors is None and passages.first().source_text == "a b"


def test_uploads(spark, tmp_path):
    text = "\n".join(f"a line of text number {i}" for i in range(12)).encode()
    rows = [("a.md", text), ("b.exe", b"x"), ("c.txt", b""), ("d.txt", b"\xff\xfe"), ("e.pdf", b"abc"), ("f.txt", b"x" * 2000), ("g.TXT", b"short"), ("noext", b"x")]
    up = spark.createDataFrame(rows, "filename string, content binary")
    got = {r.filename: r.reason for r in store.add_corpus(str(tmp_path / "c"), up, "hash-64", F.current_timestamp(), 1000).collect()}
    assert got["a.md"] is None and got["b.exe"].startswith("unsupported") and got["noext"].endswith("(none)")
    assert (got["c.txt"], got["d.txt"], got["e.pdf"], got["g.TXT"]) == ("empty file", "not UTF-8 text", "not a PDF", "no passages")
    assert got["f.txt"].startswith("larger")
    listed = store.list_corpora(spark.read.parquet(str(tmp_path / "c/corpora"))).collect()
    assert [r.filename for r in listed] == ["a.md"] and listed[0].passages > 0


def test_caches_score_each_item_once(spark, tmp_path):
    items = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "id int, k string")
    cache = spark.createDataFrame([("a", 1.0)], "k string, value double")
    seen = []

    def score(missing):
        seen.extend(r.k for r in missing.collect())
        return missing.select("k", F.lit(2.0).alias("value"))

    got = {r.id: r.value for r in store.with_cache(items, cache, "k", score).collect()}
    assert got == {1: 1.0, 2: 2.0, 3: 1.0, 4: 2.0} and sorted(seen) == ["b", "c"]


def test_datasets(spark, tmp_path):
    def put(name, value):
        (tmp_path / name).write_text(value if isinstance(value, str) else json.dumps(value))
        return str(tmp_path / name)

    got = datasets.questions(spark, put("q.json", ["plain?", {"question": "named?"}])).orderBy("qid").collect()
    assert [r.question for r in got] == ["plain?", "named?"]
    with pytest.raises(Exception, match="a question is"):
        datasets.questions(spark, put("bad.json", [{"q": 1}])).collect()
    answers = {r.question: r for r in datasets.answers(spark, put("a.json", {"x": "text", "y": {"answer": "yes", "citations": {"0": 1}}})).collect()}
    assert answers["x"].text == "text" and answers["y"].text == "yes" and answers["y"].citations == {0: 1}
    rel = datasets.qrels(spark, put("r.tsv", "query-id\tcorpus-id\tscore\n1\td1\t1\n1\td2\t0\n")).collect()
    assert [(r.qid, r.doc_id, r.gain) for r in rel] == [("1", "d1", 1)]
    grades = datasets.judgments(spark, put("j.json", {"grades": {"q?": {"s1": 2}}, "_sections": {}})).collect()
    assert [tuple(r) for r in grades] == [("q?", "s1", 2)]
    assert datasets.if_there(spark, str(tmp_path / "missing.json")) is None


def test_rounds_and_stop_reasons(spark):
    texts = ["Bread needs flour and water and salt and time to rise in a warm place.", "A sailing boat needs wind and a sail to move over the sea."]
    passages = spark.createDataFrame(list(enumerate(texts)), "passage_id long, text string")
    vectors = dense.hash_counts(passages, "passage_id", "text")
    questions = spark.createDataFrame([(0, "bread needs flour and water and salt and time"), (1, "qqq zzz vvv"), (2, "sailing needs bread")], "qid long, question string")
    config = Config(k=2, retrieval_mode="dense", abstain_threshold=0.3, agentic_max_rounds=3)
    rounds, results = agentic.iterate(passages, vectors, questions, config)
    by = {}
    for r in rounds.orderBy("qid", "round").collect():
        by.setdefault(r.qid, []).append(r)
    assert all(rs[-1].stop_reason for rs in by.values()) and all(not r.stop_reason for rs in by.values() for r in rs[:-1])
    assert {rs[-1].stop_reason for rs in by.values()} <= {"trust_threshold_met", "no_new_passages", "max_rounds"}
    out = {r.qid: r for r in results.collect()}
    for q, rs in by.items():
        best = max(r.trust for r in rs)
        assert out[q].best_trust == pytest.approx(best) and out[q].abstained == (best < 0.3)
    rounds, _ = agentic.iterate(passages, vectors, questions, config, reformulate=None)
    assert {r.stop_reason for r in rounds.collect()} <= {"trust_threshold_met", "reformulation_unavailable"}
