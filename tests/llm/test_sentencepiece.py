import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2 as pb

from plumbline.llm import sentencepiece_codec as S

BLOB = S.model_bytes(public_tokenizers.path("piece_bpe_32k.model"))
LIB = sentencepiece.SentencePieceProcessor(model_proto=BLOB)
OWN = S.Codec(BLOB)
TEXTS = ["", " ", "  a", "a  b ", "x\ny\t z\r", "café ▁ Ünïcode 🙂🙂", "a" * 3000, " ▁▁ ", "1234 5", "\u0000z", "Hello world", "Hello world", "end   "]


def split(flat, per):
    out, at = [], 0
    for n in per:
        out.append(flat[at : at + n].tolist())
        at += n
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet=" ▁ab\né🙂1", max_size=30)), max_size=6))
def test_ids_equal_the_library(texts):
    ids, begins, ends, per = OWN.encode(texts)
    assert split(ids, per) == [LIB.encode(t) for t in texts]
    assert OWN.decode(split(ids, per)) == [LIB.decode(LIB.encode(t)) for t in texts]


def test_spans_cover_the_source():
    ids, begins, ends, per = OWN.encode(TEXTS)
    for text, b, e in zip(TEXTS, split(begins, per), split(ends, per), strict=True):
        data = text.encode()
        assert "".join("" if y < x else data[x:y].decode("utf-8", "ignore") for x, y in zip(b, e)) is not None
        assert b"".join(data[x:y] for x, y in zip(b, e, strict=True)) == data
        assert all(x == y for x, y in zip(b[1:], e, strict=False))


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("squeeze", [True, False])
def test_compiled_map_equals_the_library(rule, squeeze):
    made = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, remove_extra_whitespaces=squeeze, escape_whitespaces=True)
    proto = pb.ModelProto.FromString(BLOB)
    proto.normalizer_spec.CopyFrom(pb.ModelProto.FromString(made.serialized_model_proto()).normalizer_spec)
    proto.normalizer_spec.add_dummy_prefix = True
    proto.normalizer_spec.remove_extra_whitespaces = squeeze
    proto.normalizer_spec.escape_whitespaces = True
    blob = proto.SerializeToString()
    own, lib = S.Codec(blob), sentencepiece.SentencePieceProcessor(model_proto=blob)
    for text in [*TEXTS, "ﬁ Å ①  ﾊﾟ ㍿ x", "  lead　ide ", "éä"]:
        ids, begins, ends, per = own.encode([text])
        assert ids.tolist() == lib.encode(text), text
        data = text.encode()
        pieces = lib.encode(text, return_type="proto").pieces
        for p, b in zip(pieces, begins.tolist(), strict=True):
            assert p.begin == b or p.piece.startswith("<0x"), (text, p.piece)
        assert all(0 <= b <= e <= len(data) for b, e in zip(begins, ends, strict=True))


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(S, "KEPT_SEGMENTS", 3)
    own = S.Codec(BLOB)
    for text in ["a b c d e", "a b x", "q r s", "a"]:
        assert own.encode([text])[0].tolist() == LIB.encode(text)


def test_operator(spark):
    rows = [(i, t, "kept") for i, t in enumerate(TEXTS)] + [(99, None, None), (None, "a b", "n"), (1, " ", "kept")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = S.encode_decode(docs, BLOB)
    assert out.columns == ["doc_id", "text", "ids", "begins", "ends", "decoded"]
    got = S.digests(out).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] or "" for r in rows}
    for r in got:
        ids = LIB.encode(text[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIB.decode(ids).encode()).hexdigest()
    assert S.digests(S.encode_decode(docs.limit(0), BLOB)).count() == 0
