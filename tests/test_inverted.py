"""The stored inverted index against scoring everything."""

import random

import pytest

from plumbline.config import Config
from plumbline.operators import inverted, sparse
from plumbline.plans.engine import Engine


def corpus(n=600, seed=1):
    r = random.Random(seed)
    common = [f"c{i}" for i in range(12)]
    rows = [(i, " ".join([*r.choices(common, k=r.randint(0, 30)), *(f"w{r.randrange(400)}" for _ in range(r.randint(0, 8)))])) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "c1 c1 c1"), (n + 3, "c1 c1 c1"), (n + 4, "Ünï w1-w2 W3")]
    return rows


def queries():
    r = random.Random(2)
    rows = [(i, " ".join([f"c{r.randrange(12)}", *(f"w{r.randrange(400)}" for _ in range(4))])) for i in range(12)]
    return [*rows, (50, "c1 c1 c2"), (51, "nothing here"), (52, None), (53, "w1 w1 w1"), (54, " ".join(f"c{i}" for i in range(12)))]


def tables(spark, tmp_path):
    passages = spark.createDataFrame(corpus(), "passage_id long, text string")
    asked = spark.createDataFrame(queries(), "qid long, qtext string")
    index = inverted.build(passages)
    inverted.save(index, str(tmp_path / "index"))
    return passages, asked, inverted.load(spark, str(tmp_path / "index"))


def shown(hits):
    return sorted((r.qid, r["rank"], r.passage_id, round(r.score, 6)) for r in hits.collect())


@pytest.mark.parametrize(("group", "direct"), [(4, 0), (64, 0), (16, 1 << 40)])
def test_equals_scoring_everything(spark, tmp_path, monkeypatch, group, direct):
    monkeypatch.setattr(inverted, "GROUP", group)
    monkeypatch.setattr(inverted, "DIRECT", direct)
    passages, asked, index = tables(spark, tmp_path)
    assert (index.n, index.key) == (605, "passage_id")
    for k, more in ((5, {}), (1000, {}), (5, {"k1": 0.9, "b": 0.2})):
        assert shown(inverted.search(index, asked, k, **more)) == shown(sparse.search(passages, asked, k, key="passage_id", **more))
    assert {(r.term, r.df, round(r.idf, 9)) for r in inverted.weights(index).collect()} == {
        (r.term, r.df, round(r.idf, 9)) for r in sparse.term_weights(sparse.postings(passages, "passage_id"), sparse.stats(passages)).collect()
    }


def test_groups_are_left_out_and_none_that_counts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "GROUP", 4)
    passages, asked, index = tables(spark, tmp_path)
    _, told = inverted.visits(index, *inverted._asked(index, asked, "qid", "qtext", 1.5), 3)
    told = told.toPandas()
    assert told.visit.isna().sum() > len(told) / 4, "bounds rule groups out"
    every = sparse.search(passages, asked, 10_000, key="passage_id")
    groups = inverted.build(passages).blocks.selectExpr("grp", "explode(keys) as passage_id").distinct()
    best = {(r.qid, r.grp): r.s for r in every.join(groups, "passage_id").groupBy("qid", "grp").agg({"score": "max"}).withColumnRenamed("max(score)", "s").collect()}
    assert all(best[q, g] <= b + 1e-9 for q, g, b in zip(told.qid, told.grp, told.bound, strict=True)), "no document scores above its group's bound"


def test_search_reads_no_texts_and_only_its_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "BUCKET_DOCS", 100)
    _, asked, index = tables(spark, tmp_path)
    assert index.buckets == 7
    hits = inverted.search(index, asked.filter("qid = 53"), 5)
    plan = hits._jdf.queryExecution().toString()
    assert " text#" not in plan and "(text#" not in plan and "[text#" not in plan
    monkeypatch.setattr(inverted, "DIRECT", 0)
    plan = inverted.search(index, asked.filter("qid = 53"), 5)._jdf.queryExecution().toString()
    assert " text#" not in plan and "(text#" not in plan and "[text#" not in plan
    blocks = inverted.bounds(index, *inverted._asked(index, asked.filter("qid = 53"), "qid", "qtext", 1.5), 1.5, 0.75)
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<term:string,grp:bigint,most:double>" in plan and "PartitionFilters: [isnotnull(bucket#" in plan


def test_nothing(spark, tmp_path):
    _, asked, index = tables(spark, tmp_path)
    assert inverted.search(index, asked.limit(0), 5).count() == 0
    empty = inverted.build(spark.createDataFrame([], "passage_id long, text string"))
    inverted.save(empty, str(tmp_path / "none"))
    assert inverted.search(inverted.load(spark, str(tmp_path / "none")), asked, 5).count() == 0


@pytest.mark.parametrize("mode", ["sparse", "hybrid"])
def test_engine_keeps_its_index(spark, tmp_path, mode):
    config = Config(retrieval_mode=mode, k=4)
    texts = spark.createDataFrame(corpus(200), "passage_id long, text string")
    made = Engine(spark, config).index_texts(texts)
    made.save(str(tmp_path / "e"))
    loaded = Engine(spark, config).load(str(tmp_path / "e"))
    asked = ["c1 w3 w4", "w5 w6 c2 c3"]
    a, b = (sorted((r.qid, r.passage_id, r["rank"]) for r in e.retrieve(asked).collect()) for e in (made, loaded))
    assert a == b and a
    assert loaded.index is not None and loaded.index.blocks.columns[0] == "term"
    plain = sparse.search(loaded.passages, spark.createDataFrame(list(enumerate(asked)), "qid long, qtext string"), 4, key="passage_id")
    if mode == "sparse":
        assert a == sorted((r.qid, r.passage_id, r["rank"]) for r in plain.collect())
