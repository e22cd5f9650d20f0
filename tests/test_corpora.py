"""Uploads from the first check to the last deletion, PDF files by a given parser, and folders."""

import pytest
from pyspark.sql import functions as F

from plumbline.config import Config
from plumbline.plans.engine import Corpora, Engine
from plumbline.sources import corpus, store

TEXT = "\n".join(f"a line of text number {i}" for i in range(12))


parse = (lambda: lambda content: content.decode("latin-1").removeprefix("%PDF-").split("\f"))()  # goes to tasks by value


def uploads(spark, *rows):
    return spark.createDataFrame(list(rows), "filename string, content binary")


def test_pdf_uploads(spark, tmp_path):
    pdf = b"%PDF-" + f"{TEXT}\f{TEXT} on page two".encode()
    many = b"%PDF-" + b"<< /Type /Page >> " * 101 + b"<< /Type /Pages >>"
    got = {r.filename: r.reason for r in store.add_corpus(str(tmp_path / "c"), uploads(spark, ("a.pdf", pdf), ("b.pdf", many)), "hash-64", F.current_timestamp(), parse=parse).collect()}
    assert got == {"a.pdf": None, "b.pdf": "more than 100 pages"}
    (row,) = store.list_corpora(spark.read.parquet(str(tmp_path / "c/corpora"))).collect()
    record, passages = store.get_corpus(spark, str(tmp_path / "c"), row.corpus_id)
    assert record.first().passages == passages.count() > 2 and {r.page for r in passages.collect()} == {1, 2}
    if not corpus.has_pdf_parser():
        assert store.add_corpus(str(tmp_path / "d"), uploads(spark, ("a.pdf", pdf)), "hash-64", F.current_timestamp()).first().reason == "no PDF parser is installed"


def test_corpora_live_and_die(spark, tmp_path):
    kept = Corpora(spark, str(tmp_path / "c"), Config(retrieval_mode="dense"), capacity=1)
    assert kept.list().count() == 0
    two = uploads(spark, ("a.md", TEXT.encode()), ("b.md", (TEXT + "\nother").encode()), ("a.md", TEXT.encode()))
    first = {r.filename: r.corpus_id for r in kept.add(two.dropDuplicates(), F.lit("2024-01-01").cast("timestamp")).collect()}
    again = kept.add(two, F.lit("2025-01-01").cast("timestamp")).collect()  # each upload is a corpus of its own
    assert {r.reason for r in again} == {None} and len({r.corpus_id for r in again}) == 3 and kept.list().count() == 5
    for r in again:
        kept.delete(r.corpus_id)
    n = kept.get(first["a.md"]).first().passages
    assert store.get_corpus(spark, kept.path, first["a.md"])[1].count() == n
    one = kept.engine(first["a.md"])
    assert kept.engine(first["a.md"]) is one and one.passages.count() == n
    kept.engine(first["b.md"])
    assert list(kept._engines) == [first["b.md"]]  # only as many as there is room for
    kept.delete(first["a.md"])
    for wrong in (first["a.md"], "../x", "0" * 32):
        with pytest.raises(KeyError):
            kept.get(wrong)
    with pytest.raises(KeyError):
        kept.delete(first["a.md"])
    assert kept.sweep(F.lit("2024-01-03").cast("timestamp"), 24, 10) == [first["b.md"]] and kept.list().count() == 0


def test_deleted_corpora_are_readable_for_a_while(spark, tmp_path):
    kept = Corpora(spark, str(tmp_path / "c"), Config(retrieval_mode="dense"), grace=3600)
    made = kept.add(uploads(spark, ("a.md", TEXT.encode()))).first()
    reader = store.get_corpus(spark, kept.path, made.corpus_id)[1]
    kept.delete(made.corpus_id)
    assert kept.list().count() == 0 and kept.vacuum() == [] and reader.count() > 1
    kept.grace = 0.0
    assert kept.vacuum() == [made.corpus_id]
    assert not list((tmp_path / "c").glob("*/folder=*")) and not list((tmp_path / "c/deleted").iterdir())


def test_writers_at_once_and_vectors_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    kept = Corpora(spark, str(tmp_path / "c"), Config(retrieval_mode="dense"))
    with ThreadPoolExecutor(4) as pool:
        made = list(pool.map(lambda i: kept.add(uploads(spark, (f"{i}.md", f"{TEXT}\nof file {i}".encode()))).first(), range(4)))
    listed = {r.corpus_id: r.passages for r in kept.list().collect()}
    assert set(listed) == {m.corpus_id for m in made} and len(listed) == 4
    for m in made:
        record, passages = store.get_corpus(spark, kept.path, m.corpus_id)
        assert passages.count() == listed[m.corpus_id] == store.corpus_vectors(spark, kept.path, m.corpus_id).count()
    assert not list((tmp_path / "c/aside").iterdir())
    asked = []
    embedder = kept.models.embedder
    kept.models.embedder = type("Spy", (), {"name": embedder.name, "embed": lambda self, rows, *a: (asked.append(rows.columns), embedder.embed(rows, *a))[1]})()
    engine = kept.engine(made[0].corpus_id)
    assert asked == [] and engine.vectors.count() == engine.passages.count()
    own = embedder.embed(engine.passages, "passage_id", "text")
    assert sorted(map(str, engine.vectors.collect())) == sorted(map(str, own.select("passage_id", "vec").collect()))


def test_failure_leaves_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "c")
    real = store.stored

    def failing(df, name):
        return real(df.withColumn("bytes", F.raise_error(F.lit("full disk")).cast("long")), name) if name == "never" else real(df, name)

    monkeypatch.setattr(store, "stored", failing)
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "corpora").write_text("in the way")  # records can't be written
    with pytest.raises(Exception):
        store.add_corpus(path, uploads(spark, ("a.md", TEXT.encode())), "hash-64", F.current_timestamp())
    left = [p for p in (tmp_path / "c").glob("passages/folder=*")]
    assert left == []


def test_folder_of_many_kinds(spark, tmp_path):
    for i in range(150):
        (tmp_path / f"x{i}.k{i}").write_text("other" * 50)
    (tmp_path / "a.md").write_text(TEXT)
    (tmp_path / "b.pdf").write_bytes(b"%PDF-" + TEXT.encode())
    found = corpus.read_corpus(spark, str(tmp_path), parse=parse).collect()
    assert {r.source for r in found} == {"a.md", "b.pdf"}
    (tmp_path / "only").mkdir()
    (tmp_path / "only" / "x.bin").write_bytes(b"\0")
    with pytest.raises(ValueError):
        corpus.read_corpus(spark, str(tmp_path / "only"))


def test_contextualising_asks_for_each_text_once(spark, tmp_path):
    files = spark.createDataFrame([("a", [TEXT]), ("b", [TEXT])], "source string, pages array<string>")
    asked = []

    def make(missing):
        asked.extend(r.key for r in missing.collect())
        return missing.select("key", F.concat(F.lit("About "), "source").alias("value"))

    found = corpus.passages(files)
    out = corpus.contextualise(found, make, "m", path=str(tmp_path / "cache"))
    assert len(asked) == len(set(asked)) == found.select("text").distinct().count()
    assert all(r.text.startswith("About ") and not r.source_text.startswith("About ") for r in out.collect())
    asked.clear()
    corpus.contextualise(found, make, "m", spark.read.parquet(str(tmp_path / "cache"))).collect()
    assert asked == []


def test_report(spark):
    rows = spark.createDataFrame([("a|b", 0.5), ("c", None)], "name string, value double")
    assert store.markdown(rows) == "| name | value |\n| --- | --- |\n| a\\|b | 0.5000 |\n| c | n/a |\n"
    with pytest.raises(ValueError):
        store.markdown(rows, 1)


def test_engine_without_models_of_its_own(spark):
    from plumbline.plans.models import Models

    engine = Engine(spark, Config(k=1), Models()).index_texts(["bread needs flour and water", "boats need wind to sail"])
    assert engine.retrieve(["what do boats need"]).first().passage.startswith("boats")


def test_caches_by_use_and_small_readers(spark, tmp_path):
    from plumbline.plans.engine import published
    from plumbline.sources import datasets

    items = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    cache = spark.createDataFrame([("a", 1.0, "m"), ("b", 2.0, "old"), ("a", 5.0, "m")], "k string, value double, model string")
    seen = []

    def score(missing):
        seen.extend(r.k for r in missing.collect())
        return missing.select("k", F.lit(9.0).alias("value"))

    got = {r.k: r.value for r in store.with_cache(items, cache, "k", score, str(tmp_path / "s"), F.col("model") == "m").collect()}
    assert got == {"a": 1.0, "b": 9.0, "c": 9.0} and sorted(seen) == ["b", "c"] and spark.read.parquet(str(tmp_path / "s")).count() == 2
    queries = spark.createDataFrame([(i, f"q{i}" if i % 4 else None) for i in range(20)], "qid long, qtext string")
    some = datasets.negative_queries(queries, 5)
    assert some.count() == 5 and sorted(map(tuple, some.collect())) == sorted(map(tuple, datasets.negative_queries(queries.repartition(3), 5).collect()))
    assert datasets.negative_queries(queries, 99).count() == 15
    told = spark.createDataFrame([("q", "t", "x"), ("q", "u", "x")], "question string, text string, kind string")
    assert [tuple(r) for r in datasets.presets(told, "kind").collect()] == [("q", "x")]
    with pytest.raises(ValueError):
        datasets.subset(told, "kind", ())
    with pytest.warns(UserWarning, match="no earlier result"):
        assert datasets.if_there(spark, str(tmp_path / "none")) is None
    row = published(spark.createDataFrame([(0.123456, None, "s")], "a double, b double, c string")).first()
    assert tuple(row) == (0.1235, None, "s")
