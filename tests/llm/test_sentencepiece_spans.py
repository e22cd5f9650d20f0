"""Normalisation and spans against a plain version that goes through a text chunk by chunk."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2 as pb

from plumbline.llm import sentencepiece_codec as S
from plumbline.llm.common import text_buffer

BLOB = S.model_bytes(public_tokenizers.path("piece_bpe_32k.model"))


def model(rule, squeeze, prefix=True):
    proto = pb.ModelProto.FromString(BLOB)
    if rule:
        made = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, remove_extra_whitespaces=squeeze, escape_whitespaces=True)
        proto.normalizer_spec.CopyFrom(pb.ModelProto.FromString(made.serialized_model_proto()).normalizer_spec)
    proto.normalizer_spec.add_dummy_prefix = prefix
    proto.normalizer_spec.remove_extra_whitespaces = squeeze
    proto.normalizer_spec.escape_whitespaces = True
    return proto.SerializeToString()


def plain(codec, text):
    """Normalised text and alignment, one chunk at a time."""
    data, mark = text.encode(), S.MARK.encode()
    chunks, at = [], 0
    while at < len(data):
        hit = codec.map.longest(data, at, len(data))
        if hit is None:
            width = len(data[at:].decode()[0].encode())
            hit = (data[at : at + width], width)
        chunks.append((hit[0], at, data[at : at + hit[1]] == hit[0]))
        at += hit[1]
    out, align, before = b"", [], True
    for new, start, same in chunks:  # a character that stays is aligned byte by byte
        if codec.squeeze and before:
            new = new.lstrip(b" ")
        for k, byte in enumerate(new):
            out += mark if byte == 32 else bytes([byte])
            align += [start + k * same] * (3 if byte == 32 else 1)
        if new:
            before = new.endswith(b" ")
    end = len(data)
    if codec.prefix and (out if codec.squeeze else data):
        out, align = mark + out, [align[0] if align else 0] * 3 + align
    while codec.squeeze and out.endswith(mark):
        end = align[-3]
        out, align = out[:-3], align[:-3]
    return out, [*align, end]


CODECS = {(r, q, p): S.Codec(model(r, q, p)) for r in (None, "nmt_nfkc", "nfkc_cf") for q in (True, False) for p in (True, False)}
ALPHABET = " ▁a\tbﬁÅé①　ﾊﾟ​ ́🙂1"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=14), max_size=5))
def test_normalise_equals_plain(texts):
    for codec in CODECS.values():
        out, bounds, align = codec.normalise(*text_buffer(pa.array(texts, pa.string())))
        for i, text in enumerate(texts):
            a, b = int(bounds[i]), int(bounds[i + 1])
            assert (out[a:b].tobytes(), align[a + i : b + i + 1].tolist()) == plain(codec, text), text


@pytest.mark.parametrize("rule", ["nmt_nfkc", None])
@pytest.mark.parametrize("squeeze", [True, False])
def test_ids_equal_the_library_in_batches(rule, squeeze):
    r = np.random.default_rng(0)
    texts = ["".join(r.choice(list(ALPHABET), r.integers(0, 30))) for _ in range(300)]
    blob = model(rule, squeeze)
    lib = sentencepiece.SentencePieceProcessor(model_proto=blob)
    ids, begins, ends, per = CODECS[rule, squeeze, True].encode(texts)
    want = lib.encode(texts)
    assert np.array_equal(per, [len(x) for x in want]) and ids.tolist() == [i for x in want for i in x]


def test_span_digests_come_from_the_alignment(spark, monkeypatch):
    rows = [(1, "ab  cd é"), (2, "ab  cd é"), (3, None), (4, "ab cd é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in S.digests(S.encode_decode(docs, BLOB)).collect()}
    assert got[1].spans_hash == got[2].spans_hash != got[4].spans_hash
    assert [got[i].covered_bytes for i in (1, 3, 4)] == [9, 0, 8]
