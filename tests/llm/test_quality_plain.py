"""Features text by text, and a classifier that no plain step could better."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import quality as Q
from plumbline.llm.common import text_buffer
from test_quality import SCHEMA, made


def features(text):
    data = (text or "").encode()
    if not data:
        return [0.0] * Q.N_FEATURES
    share = lambda test: sum(map(test, data)) / len(data)
    letter = lambda b: 65 <= b <= 90 or 97 <= b <= 122
    digit = lambda b: 48 <= b <= 57
    plain = lambda b: chr(b) in ".,'-" if b < 128 else False
    sign = share(lambda b: 32 < b < 128 and not letter(b) and not digit(b) and not plain(b))
    words = data.split()
    same = sum(a == b for a, b in zip(words, words[1:]))
    n = max(1, len(words))
    return [
        share(lambda b: 65 <= b <= 90), share(digit), sign, share(lambda b: b == ord("|")), share(lambda b: b == ord("!")), share(lambda b: b == 10), share(lambda b: b >= 128), share(plain),
        math.log1p(len(words)) / 10, sum(map(len, words)) / n / 20, same / n, math.sqrt(sign),
    ]


TEXTS = ["", None, "a", "Hello, World! 12 | x", "one one one two\nthree", "É ü 🙂 \t x-y 'z'", " \n ", "A" * 700 + " !!", "w " * 3000]


def test_features_equal_plain():
    got = Q.features(*text_buffer(pa.array(TEXTS, pa.string())))
    assert np.allclose(got, [features(t) for t in TEXTS])


def test_fitted_on_plain_features(spark):
    """The weights are where the penalised likelihood of plain features is flat."""
    rows, labels = made(300, seed=9)
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")
    model = Q.fit(docs, marks)
    text = {r[0]: r[1] for r in rows}
    x, y = np.array([features(text[i]) for i, _ in labels]), np.array([v for _, v in labels])
    assert np.allclose(model.mean, x.mean(axis=0))
    z = (x - model.mean) / model.spread
    p = 1 / (1 + np.exp(-(z @ model.weights + model.bias)))
    assert np.abs(z.T @ (y - p) - model.weights).max() < 1e-4 and abs((y - p).sum()) < 1e-4
    got = {r.doc_id: r.evidence for r in Q.posterior(docs, marks, F.col("source"), F.col("lang")).collect()}
    for i, t in text.items():
        margin = float(((np.array(features(t)) - model.mean) / model.spread) @ model.weights + model.bias)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-12, min(12, margin)))), abs=1e-9)


def test_several_texts_of_one_id(spark):
    rows, labels = made(60)
    odd = [(0, "other text of the same id", *rows[0][2:]), (0, "A THIRD!! ONE!!", *rows[0][2:])]
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    models = [Q.fit(spark.createDataFrame(x, SCHEMA).repartition(n), marks) for n, x in ((1, rows + odd), (4, odd[::-1] + rows))]
    assert np.array_equal(models[0].weights, models[1].weights) and models[0].bias == models[1].bias


def test_columns_on_demand(spark):
    rows, labels = made(30)
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")
    some = Q.posterior(docs, marks, F.col("source"), F.col("lang"), columns=["doc_id"])
    assert some.columns == ["doc_id", *Q.OUTPUTS]
    whole = {r.doc_id: r.quality for r in Q.posterior(docs, marks, F.col("source"), F.col("lang")).collect()}
    assert {r.doc_id: r.quality for r in some.collect()} == pytest.approx(whole)
