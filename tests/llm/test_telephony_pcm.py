"""Resampling against a plain sum, what the filter passes, and the stored PCM."""

import hashlib

import numpy as np
import pytest

from plumbline.llm import telephony as A


def plain(pcm, rate, source):
    """Each output sample as its own sum over input samples, from the filter's definition."""
    from fractions import Fraction

    step = Fraction(source, rate)
    wide = max(1.0, source / rate)
    half = int(np.ceil(A.CROSSINGS * wide))
    out = []
    for m in range(-(-len(pcm) * rate // source)):
        at = m * step
        base, frac = int(at // 1), float(at % 1)
        h = []
        for k in range(1 - half, half + 1):
            x = (k - frac) / wide
            window = np.cos(np.pi * (k - frac) / (2 * half)) ** 2 if abs(k - frac) <= half else 0.0
            h.append(np.sinc(x) * window)
        h = [round(v / sum(h) * 2**A.WEIGHT_BITS) for v in h]
        h[half - 1] += 2**A.WEIGHT_BITS - sum(h)
        total = sum(w * int(pcm[base + k]) for k, w in zip(range(1 - half, half + 1), h, strict=True) if 0 <= base + k < len(pcm))
        out.append(max(-32768, min(32767, (total + 2 ** (A.WEIGHT_BITS - 1)) >> A.WEIGHT_BITS)))
    return out


@pytest.mark.parametrize("rate", [1000, 1600, 4000, 8000, 11025, 16000, 3000])
@pytest.mark.parametrize("made", [7, 1 << 14])
def test_equals_plain_sums(monkeypatch, rate, made):
    monkeypatch.setattr(A, "MADE", made)
    pcm = np.random.default_rng(1).integers(-32768, 32768, 157).astype(np.int16)
    got = A.resampled(pcm, rate)
    assert len(got) == -(-157 * rate // A.RATE)
    want = pcm.tolist() if rate == 8000 else plain(pcm, rate, A.RATE)
    assert np.abs(got.astype(int) - want).max() <= 1 and np.mean(got == want) > 0.95
    assert len(A.resampled(pcm[:0], rate)) == 0


def test_filter_passes_low_and_stops_high():
    t = np.arange(8000) / 8000
    for hertz, least, most in ((300, 0.95, 1.05), (500, 0.9, 1.05), (1200, 0, 0.05), (3000, 0, 0.01)):
        sound = (10000 * np.sin(2 * np.pi * hertz * t)).astype(np.int16)
        got = A.resampled(sound, 1600)[50:-50].astype(float)
        assert least <= np.sqrt((got**2).mean()) / (10000 / np.sqrt(2)) <= most, hertz


def test_features_come_from_the_stored_pcm(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "some sound " * 90), (2, None)], "doc_id long, text string")
    tables, real = [], A.stored
    monkeypatch.setattr(A, "stored", lambda s, df, name: (tables.append(real(s, df, name)), tables[-1])[1])
    got = {r.doc_id: r for r in A.digests(A.read(A.store(docs, "text"))).collect()}
    (table,) = tables
    for r in table.collect():
        pcm = np.frombuffer(bytes(r.pcm), "<i2")
        assert got[r.doc_id].pcm_sha256 == hashlib.sha256(bytes(r.pcm)).hexdigest()
        assert got[r.doc_id].pcm_bytes == len(r.pcm) and got[r.doc_id].feature == A.feature(r.codec, pcm)


def features_by_hand(text):
    """Plain version of the whole way: pad, file, codec by CRC, decode, filter, describe."""
    import zlib

    raw = (text or "").encode()
    payload = raw + b"\xff" * (-len(raw) % 576) or b"\xff" * 576
    codec = ["mulaw", "alaw", "ima_adpcm"][zlib.crc32(payload) % 3]
    if codec == "mulaw":
        pcm = []
        for c in payload:
            c = ~c & 0xFF
            size = (((c & 15) << 3) + 132 << (c >> 4 & 7)) - 132
            pcm.append(-size if c & 128 else size)
    elif codec == "alaw":
        pcm = []
        for c in payload:
            c ^= 0x55
            e, size = c >> 4 & 7, (c & 15) << 4
            size = size + 8 if e == 0 else size + 264 << (e - 1)
            pcm.append(size if c & 128 else -size)
    else:
        pcm = []
        for a in range(0, len(payload), 36):
            block = payload[a : a + 36]
            value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
            pcm.append(value)
            for byte in block[4:]:
                for code in (byte & 15, byte >> 4):
                    step = int(A.STEPS[index])
                    move = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                    value = max(-32768, min(32767, value - move if code & 8 else value + move))
                    index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][code & 7]))
                    pcm.append(value)
    out = plain(pcm, A.PCM_RATE, 8000)
    turns = sum((a < 0) != (b < 0) for a, b in zip(out, out[1:]))
    return codec, len(out), (sum(x * x for x in out) / len(out)) ** 0.5, max(map(abs, out)), turns


def test_operator_equals_plain_version(spark):
    texts = [None, "a", "héllo wörld " * 30, *[f"document number {i} " * (3 + i) for i in range(6)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in A.digests(A.read(A.store(docs, "text"))).collect():
        codec, n, rms, peak, turns = features_by_hand(texts[r.doc_id])
        name, *rest = r.feature.split()
        got = {k: float(v) for k, v in (x.split("=") for x in rest)}
        assert (name, got["n"]) == (codec, n)
        assert got["rms"] == pytest.approx(rms, abs=1) and abs(got["peak"] - peak) <= 1 and abs(got["turns"] - turns) <= 2


def test_shards_are_as_all_at_once(spark):
    rows = [(i, "x" * (i % 7) * 100 + f" {i % 5}") for i in range(40)] + [(99, None), (99, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = A.digests(A.read(A.store(docs, "text")))
    parts = A.in_shards(A.store(docs, "text"), shards=3)
    assert parts.columns == whole.columns and sorted(map(str, parts.collect())) == sorted(map(str, whole.collect()))
    assert A.in_shards(A.store(docs.limit(0), "text")).count() == 0
    assert A.PCM_RATE == 4000
