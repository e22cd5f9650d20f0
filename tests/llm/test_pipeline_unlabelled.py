"""The language stage without any labelled document."""

import corpus_pipeline as P


def test_no_model_drops_only_what_has_no_letter(spark):
    rows = [(1, "some words", None), (2, "12 !!", None), (3, None, None), (4, "", None), (5, "7 é", None), (None, "один", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(str(r.doc_id) for r in P.language(spark, docs, "").collect()) == ["1", "5", "None"]
    labelled = spark.createDataFrame([(i, t, "en") for i, t, _ in rows], docs.schema)
    assert sorted(str(r.doc_id) for r in P.language(spark, labelled, "").collect()) == ["1", "5", "None"]
