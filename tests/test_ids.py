"""Ids of passages and questions stay apart however many a document or conversation has."""

import pytest

from plumbline.functions import ids
from plumbline.plans import queries_retrieval, queries_text, queries_trust


def test_pairs_have_ids_of_their_own(spark):
    majors = [-(2**33), -7, -1, 0, 1, 2, 9, 2**33 - 1]
    minors = [-(2**27), -1, 0, 1, 999, 1000, 9999, 10_000, 10_001, 20_000, 2**27 - 1]
    for base in (ids.PASSAGES, ids.TURNS):
        rows = [(a, b) for a in majors for b in minors] + [(2**45, 0), (-(2**45), base - 1)]
        df = spark.createDataFrame(rows, "a long, b int")
        packed = df.select("a", "b", ids.pack(df.a, df.b, base).alias("id"))
        got = packed.select("*", ids.major_of(packed.id, base).alias("m")).collect()
        assert len({r.id for r in got}) == len(got) and all(r.m == r.a for r in got)
        assert all(r.id == r.a * base + r.b for r in got if 0 <= r.b < base)
    none = spark.createDataFrame([(None, 1), (1, None)], "a long, b int")
    assert [r[0] for r in none.select(ids.pack(none.a, none.b, 10)).collect()] == [None, None]
    far = spark.createDataFrame([(2**40, 10_000)], "a long, b int")
    with pytest.raises(Exception, match="no id for the pair"):
        far.select(ids.pack(far.a, far.b, ids.PASSAGES)).collect()


def test_long_document_and_conversation(spark, tmp_path):
    lines = "\n".join(f"line {i} of a long document" for i in range(40_020))
    docs = [(1, lines, "en", "a", len(lines)), (2, "zebra words of another document, the second one", "en", "a", 40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries_text.passages_of(spark, str(tmp_path)).collect()
    assert len(found) > 10_001 and len({r.passage_id for r in found}) == len(found)

    asked = [(5, "zebra"), (6, "40015 40016 40017")]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.qid, r.doc_id) for r in queries_retrieval.collapse_to_documents(spark, str(tmp_path)).collect()}
    assert got == {(5, 2), (6, 1)}

    turns = [(1, t, "user" if t % 2 == 0 else "assistant", f"c1 t{t}") for t in range(1010)] + [(2, 0, "user", "c2 t0"), (2, 1, "assistant", "c2 t1")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    t = queries_trust.talk(spark, str(tmp_path)).collect()
    assert len(t) == 506 and len({r.qid for r in t}) == 506
