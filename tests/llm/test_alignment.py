import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plumbline.llm import alignment as A
from plumbline.llm.sentencepiece_codec import model_bytes
from plumbline.llm.queries import byte_bpe

MODEL = model_bytes(public_tokenizers.path("piece_bpe_32k.model"))
TOK = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
TOK.encode_special_tokens = True
LIB = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
CHARS = {c: b for c, b in A.byte_level().items()}


def plain_tokens(text):
    if not text:
        return [], []
    a = [(i, bytes(CHARS[c] for c in TOK.id_to_token(i))) for i in TOK.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(LIB.id_to_piece(i)[1:-1], 16)]) if LIB.is_byte(i) else LIB.id_to_piece(i).replace("▁", " ").encode()) for i in LIB.encode(text)]
    whole = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])


def plain_groups(text):
    a, b = plain_tokens(text)
    cuts = []
    for side in (a, b):
        at, ends = 0, []
        for _, x in side:
            at += len(x)
            ends.append(at)
        cuts.append(ends)
    out, i, j = [], 0, 0
    for end in sorted(set(cuts[0]) & set(cuts[1])):
        p, q = cuts[0].index(end, i) + 1, cuts[1].index(end, j) + 1
        out.append(([t for t, _ in a[i:p]], [t for t, _ in b[j:q]]))
        i, j = p, q
    return out


def brute(rows):
    groups = [plain_groups(t) for _, t in rows]
    links = [Counter((x, y) for g, h in gs for x in g for y in h) for gs in groups]
    count = Counter(p for c in links for p in c)
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for (i, _), gs, c in zip(rows, groups, links, strict=True):
        shown = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in gs)
        out.append((
            i, sum(len(g) for g, _ in gs), sum(len(h) for _, h in gs), len(gs), sum(c.values()),
            sum(n for p, n in c.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in c.items()),
            hashlib.sha256(shown.encode()).hexdigest() if gs else "",
        ))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    some = ["the", "café", "naïve", "straße", "don't", "12345", "3.14", "<|endoftext|>", "<0x41>", "\n", "  ", "\t", "日本語", "🙂👍🏽", " ", "　", "é", "…", "x" * 50, "https://a.b/c?d=e", "\x00", "\x01", "﻿", " "]
    rows = [(i, r.choice([" ", "", "  "]).join(r.choice(some) for _ in range(r.randint(1, 40)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " "), (103, "a▁b"), (104, "▁"), (105, " lead"), (106, "trail "), (107, "a" * 5000), (108, "the the the"), (108, "the the the"), (None, "the"), (109, "ab " * 20000), (110, "é" * 300 + " b"), (111, "a   b"), (112, "é  b")]
    return rows


def result(spark, rows):
    found = A.align(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, pairs int"), byte_bpe(), MODEL)
    return sorted(map(tuple, found.collect()), key=str)


@pytest.mark.parametrize("head", [10**6, 20, 0])
def test_equals_brute_force(spark, monkeypatch, head):
    monkeypatch.setattr(A, "HEAD_PAIRS", head)
    rows = corpus(head)
    assert result(spark, rows) == brute(rows)


def test_nothing(spark):
    assert result(spark, []) == []


@pytest.fixture(scope="module")
def own():
    return A.Aligner(byte_bpe(), MODEL)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\ta'.éß▁1 　\u0085"), st.characters(exclude_categories=["Cs"]))), max_size=4))
def test_segments_are_as_whole_texts(own, texts):
    numbers, shas, *_ = own.align(texts)
    for t, n, sha in zip(texts, numbers.tolist(), shas, strict=True):
        gs = plain_groups(t)
        shown = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in gs)
        assert sha == (hashlib.sha256(shown.encode()).hexdigest() if gs else "")
        assert n[:3] == [sum(len(g) for g, _ in gs), sum(len(h) for _, h in gs), len(gs)]


def walked(t, a, b):
    a_ids, b_ids = [t.bytes[0].index(x) for x in a], [t.bytes[1].index(x) for x in b]
    of_a, of_b, n = t.groups(*(np.array(x, int) for x in (a_ids, [len(a)], b_ids, [len(b)])))
    return [(int((of_a == g).sum()), int((of_b == g).sum())) for g in range(int(n[0]))]


@pytest.mark.parametrize("few", [0, 16])
def test_transducer(monkeypatch, few):
    monkeypatch.setattr(A, "FEW", few)
    t = A.Transducer([b"ab", b"c", b"de"], [b"a", b"bc", b"de", b"x"])
    assert walked(t, [b"ab", b"c", b"de"], [b"a", b"bc", b"de"]) == [(2, 2), (1, 1)]
    assert walked(t, [], []) == []
    seen = len(t.memo)
    assert walked(t, [b"ab", b"c"], [b"a", b"bc"]) == [(2, 2)]
    assert len(t.memo) == seen
    with pytest.raises(ValueError, match="different bytes"):
        walked(t, [b"ab"], [b"x"])


def test_libraries_agree_on_ascii(own):
    r = random.Random(3)
    texts = ["".join(r.choices([chr(c) for c in range(128)], k=r.randint(1, 30))) for _ in range(20_000)]
    texts += [" " + "".join(r.choices("abcdefghij0123456789'", k=r.randint(1, 40))) for _ in range(20_000)]
    assert own.ascii.encode_ordinary_batch(texts) == [e.ids for e in TOK.encode_batch(texts, add_special_tokens=False)]


def test_crossed_groups_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(A, "CROSSED", 1)
    rows = corpus(8)
    assert result(spark, rows) == brute(rows)


def test_forgetting_changes_nothing(own, monkeypatch):
    texts = [t for _, t in corpus(5)]
    before = own.align(texts)
    monkeypatch.setattr(A, "KEPT_SEGMENTS", 0)
    again = own.align(texts)
    assert all((x == y) if isinstance(x, list) else (x == y).all() for x, y in zip(before, again, strict=True))
