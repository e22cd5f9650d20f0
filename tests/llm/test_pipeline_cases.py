"""Each stage of the pipeline on nulls, repeated rows and ids, clashing names and nothing."""

import pytest

import corpus_pipeline as P

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies long, ids string, evidence string, component_id int, `_x y` string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "i", "e", 3, "odd") for r in rows], SCHEMA)


ROWS = [
    (1, "one two three four five six seven", "en", "a", 1), (1, "one two three four five six seven", "en", "a", 1), (2, None, None, None, None), (None, "null id but with text here", "en", "b", 1),
    (None, "null id but with text here", "en", "b", 1), (3, "", "en", "a", 0), (4, "12 34 !!", "de", "c", 1), (5, "another document of some other words here", None, None, 2), (1, "a third row of the first id", "en", "b", 3),
    (6, "long " * 50_000, "en", "a", 9),
]


@pytest.mark.parametrize("name", ["language", "good", "once", "mixture", "tokens"])
def test_stage_handles_odd_rows(spark, tmp_path, name):
    spark.createDataFrame([(1, 1), (99, 0), (None, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    step = getattr(P, name)
    docs = frame(spark, ROWS)
    got = step(spark, docs, str(tmp_path))
    rows = sorted(map(str, got.collect()))
    assert rows == sorted(map(str, step(spark, docs.repartition(3), str(tmp_path)).collect()))  # whatever the order
    if name != "tokens":
        assert got.columns == docs.columns
    empty = step(spark, docs.limit(0), str(tmp_path))
    assert empty.columns == got.columns and empty.count() == 0
    ids = [str(r.doc_id) for r in step(spark, docs, str(tmp_path)).collect()]
    if name == "language":
        assert sorted(ids) == sorted(str(r[0]) for r in ROWS if r[1] and any(map(str.isalpha, r[1])))
    if name == "good":
        assert len(ids) == len(ROWS)  # one kind of label teaches nothing
    if name == "once":
        assert sorted(ids) == ["1", "2", "3", "4", "5", "6", "None", "None"]
    if name == "tokens":
        assert len(ids) == len(ROWS)


def test_no_stage_leaves_its_tables(spark, tmp_path, monkeypatch):
    """What a stage stored on its way is gone once its result is written."""
    import os

    from plumbline.llm import common

    spark.createDataFrame([(1, 1), (6, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    shared = common.shared_dir(spark).removeprefix("file://") + "/plumbline"
    os.makedirs(shared, exist_ok=True)
    before = set(os.listdir(shared))
    frame(spark, ROWS).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() > 0
    left = set(os.listdir(shared)) - before
    assert len(left) == 1 and next(iter(left)).startswith("stage-3")  # what the last stage reads


def test_results_are_lazy(spark, tmp_path):
    """A stage's result can be read after other stages, and other threads, have begun."""
    from concurrent.futures import ThreadPoolExecutor

    spark.createDataFrame([(1, 1), (6, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = frame(spark, ROWS)
    first = P.good(spark, docs, str(tmp_path))
    with ThreadPoolExecutor(3) as pool:
        others = list(pool.map(lambda n: P.once(spark, docs.limit(n), str(tmp_path)), (4, 7, 10)))
    assert first.count() == P.good(spark, docs, str(tmp_path)).count() > 0
    assert [o.count() for o in others] == [P.once(spark, docs.limit(n), str(tmp_path)).count() for n in (4, 7, 10)]


def test_the_language_that_was_told_goes_on(spark, tmp_path):
    english = "the quick brown fox jumps over the lazy dog and then it runs away from the farm with all of the hens number"
    german = "der schnelle braune fuchs springt ueber den faulen hund und dann laeuft er mit allen huehnern vom hof nummer"
    rows = [(i, f"{english if i % 2 else german} {i}", "en" if i % 2 else "de", "a", 1) for i in range(60)]
    rows[10] = (10, rows[10][1], "en", "a", 1)  # wrongly labelled
    rows[11] = (11, rows[11][1], None, "a", 1)
    got = {r.doc_id: r.lang for r in P.language(spark, frame(spark, rows), str(tmp_path)).collect()}
    assert got == {i: "en" if i % 2 else "de" for i in range(60)}
