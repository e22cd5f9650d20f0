import public_tokenizers
import sentencepiece

import corpus_pipeline as P
from test_near_dedup import brute
from test_quality import made

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep string"


def fixture():
    rows, labels = made(200)
    docs = [(i, t, lang or "en", source, len(t), "x") for i, t, source, lang, *_ in rows]
    docs += [(900, None, "en", "a.org", 0, "x"), (901, "12 !!", "en", None, 5, "x"), (902, docs[1][1], "en", "b.org", 9, "x"), (903, docs[1][1] + " more", "en", "a.org", 9, "x")]
    docs += [docs[1], docs[1]]
    return docs, labels


def test_stages_equal_plain_versions(spark, tmp_path):
    rows, labels = fixture()
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [f.__name__ for _, f in P.STAGES] == ["language", "good", "once", "mixture", "tokens"]
    step = {}
    for _, stage in P.STAGES:
        name = stage.__name__
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        step[name] = docs.collect()
        if name != "tokens":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "keep"]
    ids = lambda name: sorted(r.doc_id for r in step[name])
    assert ids("language") == sorted(r[0] for r in rows if r[1] and any(map(str.isalpha, r[1])))
    shouting = {r.doc_id for r in step["language"] if "!!" in r.text}
    assert ids("good") == [i for i in ids("language") if i not in shouting]
    kept = [x[0] for x in brute([(r.doc_id, r.text) for r in step["good"]]) if x[3]]
    assert ids("once") == sorted(set(kept))
    words = sum(len(r.text.split()) for r in step["once"])
    taken = sum(len(r.text.split()) for r in step["mixture"])
    assert abs(taken - 1.5 * words) < 0.05 * words
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text = {r.doc_id: r.text for r in step["mixture"]}
    assert ids("tokens") == ids("mixture")
    assert all(list(r.ids) == lib.encode(text[r.doc_id]) for r in step["tokens"])
    again = P.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, again)) == sorted(map(str, step["tokens"]))


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
