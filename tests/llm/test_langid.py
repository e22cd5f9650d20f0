import random

import numpy as np

from plumbline.llm import langid as L
from plumbline.llm.common import text_buffer
import pyarrow as pa

SYLLABLES = {"en": "the ing and ion er of ly th".split(), "de": "sch ung ein ich keit ver ü der".split(), "fr": "eau que les oi é ment tre ch".split()}


def texts(n, seed=0):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = r.choice(sorted(SYLLABLES))
        out.append((i, " ".join("".join(r.choices(SYLLABLES[lang], k=r.randint(1, 3))) for _ in range(r.randint(3, 60))), lang))
    return out


def test_held_out_accuracy_and_cases(spark):
    rows = texts(400) + [(1000, None, "en"), (1001, "12 !!", "en"), (1002, "", None), (1003, "a", "en"), (1004, "the ing " * 400_000, None), (None, "schung einkeit verich", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' as lang_pred")
    model = L.fit(docs, ~L.held_out())
    out = L.identify(docs.withColumn("held_out", L.held_out()), model)
    got = {r.doc_id: r for r in out.collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert len(held) > 40 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert got[1004].lang_pred == "en" and got[None].lang_pred == "de" and got[1003].lang_ambiguous
    assert all(0 <= r.lang_score <= 1 for r in got.values())


def test_degenerate(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in L.identify(docs, L.fit(docs, ~L.held_out())).collect()] == ["und"]
    one = spark.createDataFrame([(2, "abc", "x"), (3, "zzz", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.lang_score) for r in L.identify(one, L.fit(one, ~L.held_out())).collect()] == [("x", 1.0)] * 2
    assert L.identify(docs.limit(0), L.fit(one, ~L.held_out())).count() == 0


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 12, 40):
        code = L.codebook(n)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= max(1, code.shape[1] // 4)


def test_windows_change_nothing(monkeypatch):
    data, offsets = text_buffer(pa.array(["", "abcé", "xy", None, "hello world again", "q"]))
    model = L.Model(["a"], np.ones((1, 2)), np.random.default_rng(0).normal(size=(2, (1 << L.BITS) + 1)), np.ones(2))
    model.weights[:, -1] = 0
    whole = L.margins(model, data, offsets)
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(L, "WINDOW", size)
        assert np.allclose(L.margins(model, data, offsets), whole)
