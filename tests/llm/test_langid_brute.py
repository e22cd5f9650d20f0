"""The language classifier against a plain computation of its counts, weights and decoding."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import langid as L

WORDS = {"aa": ["alpha", "beta", "gamma"], "bb": ["uno", "dos", "tres"], "cc": ["eins", "zwei", "drei"]}


def rows(n, languages, seed=1):
    r = random.Random(seed)
    out = [(i, " ".join(r.choices(WORDS[lang], k=r.randint(1, 12))).title(), lang) for i in range(n) for lang in [r.choice(languages)]]
    return [*out, (n, None, "aa"), (n + 1, "1 2", "bb"), (n + 2, "x", None), (None, "alpha uno", "cc")]


def buckets(text):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return [((low[i] << 16 | low[i + 1] << 8 | low[i + 2]) * 2654435761 % (1 << 32)) >> (32 - L.BITS) for i in range(len(low) - 2)]


def plain(data):
    """Prediction and score of each row."""
    learn = [(t, lang) for i, t, lang in data if (i is None or zlib.crc32(str(i).encode()) % 5) and t is not None and lang is not None]
    languages = sorted({lang for _, lang in learn})
    counts = {lang: Counter(b for t, x in learn if x == lang for b in buckets(t)) for lang in languages}
    size = 1 << L.BITS
    rate = lambda lang, b: (counts[lang][b] + 0.1) / (counts[lang].total() + 0.1 * size)
    codes = L.codebook(len(languages)).tolist()
    used = sorted({b for c in counts.values() for b in c})
    weights, trust = [], []
    for bit in range(len(codes[0])):
        up = [x for x, c in zip(languages, codes) if c[bit] > 0]
        down = [x for x, c in zip(languages, codes) if c[bit] < 0]
        score = lambda b: math.log(sum(rate(x, b) for x in up) / len(up)) - math.log(sum(rate(x, b) for x in down) / len(down))  # noqa: B023, E731
        other = score(-1)  # of every bucket that no text has
        margin = {x: sum(rate(x, b) * score(b) for b in used) + (size - len(used)) * rate(x, -1) * other for x in languages}
        scale = max(sum(map(abs, margin.values())) / len(margin), 1e-9)
        weights.append(({b: score(b) / scale for b in used}, other / scale))
        trust.append(max(0.05, min(c[bit] * margin[x] / scale for x, c in zip(languages, codes))))
    trust = [t / sum(trust) for t in trust]
    out = []
    for _, text, _ in data:
        if not any(map(str.isalpha, text or "")):
            out.append(("und", 0.0))
            continue
        found = buckets(text)
        margins = [sum(w.get(b, rest) for b in found) / max(1, len(text.encode()) - 2) for w, rest in weights]
        loss = [sum(t * math.log1p(math.exp(-2 * m * c)) for t, m, c in zip(trust, margins, code)) for code in codes]
        best = min(range(len(loss)), key=lambda i: loss[i])
        out.append((languages[best], 1 / sum(math.exp(-4 * (x - loss[best])) for x in loss)))
    return out


@pytest.mark.parametrize("languages", [["aa", "bb"], ["aa", "bb", "cc"]])
def test_equals_plain_computation(spark, languages):
    data = [r for r in rows(120, languages) if r[2] in (*languages, None)]
    docs = spark.createDataFrame([(*r, n) for n, r in enumerate(data)], "doc_id long, text string, lang string, n int")
    got = sorted(L.identify(docs, L.fit(docs, ~L.held_out())).collect(), key=lambda r: r.n)
    for g, (name, score) in zip(got, plain(data), strict=True):
        assert g.lang_pred == name and np.isclose(g.lang_score, score, atol=1e-5), (g, name, score)


def test_query_equals_plain_computation(spark, tmp_path):
    from plumbline.llm.queries import op10_langid

    data = rows(90, list(WORDS), seed=4)
    spark.createDataFrame(data, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op10_langid(spark, str(tmp_path)).collect()}
    for (i, _, _), (name, score) in zip(data, plain(data), strict=True):
        assert got[i].lang_pred == name and np.isclose(got[i].score, score, atol=1e-5)
        assert got[i].held_out == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0)
