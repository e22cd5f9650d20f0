import hashlib
import zlib

import numpy as np
import pytest

from plumbline.llm import telephony as A


def test_tables_are_the_standard_ones():
    mu, al = A.TABLES["mulaw"], A.TABLES["alaw"]
    assert (mu[0], mu[0x7F], mu[0x80], mu[0xFF]) == (-32124, 0, 32124, 0)
    assert (al[0x55], al[0xD5], al[0x2A], al[0xAA], al[0x80]) == (-8, 8, -32256, 32256, 5504)
    assert len(set(mu.tolist())) == 255 and len(set(al.tolist())) == 256


def adpcm_by_sample(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(A.STEPS[index])
            move = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                move += part if code & bit else 0
            value = max(-32768, min(32767, value - move if code & 8 else value + move))
            index = max(0, min(88, index + int(A.INDEX_MOVES[code])))
            out.append(value)
    return out


def test_adpcm_equals_one_sample_at_a_time():
    data = np.random.default_rng(0).integers(0, 256, 40 * A.BLOCK, dtype=np.uint8)
    want = [adpcm_by_sample(bytes(b)) for b in data.reshape(-1, A.BLOCK)]
    assert A.decode_adpcm(data).tolist() == want


@pytest.mark.parametrize("codec", A.CODECS)
def test_container_round_trip(codec):
    payload = bytes(range(256)) * 9
    assert A.from_wav(A.to_wav(payload, codec)) == (codec, payload)
    with pytest.raises(ValueError):
        A.from_wav(A.to_wav(payload, codec)[:-1])
    with pytest.raises(ValueError):
        A.from_wav(b"abc")


def test_operator(spark, monkeypatch):
    monkeypatch.setattr(A, "WINDOW", 5)
    texts = ["", None, "é" * 288, "x", "x", "long " * 50_000, "z" * 577, *[f"text {i}" for i in range(20)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'c' as codec")
    got = {r.doc_id: r for r in A.digests(A.read(A.store(docs, "text"))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576) or b"\xff" * 576
        r = got[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
        media = A.to_wav(payload, A.CODECS[zlib.crc32(payload) % 3])
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert r.feature == A.feature(*[(c, A.decode_all([(c, p)])[0]) for c, p in [A.from_wav(media)]][0])
    assert got[3][1:] == got[4][1:] and {r.feature.split()[0] for r in got.values()} == set(A.CODECS)
    assert A.digests(A.read(A.store(docs.limit(0), "text"))).count() == 0
