"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAV containers.

Payload bytes are kept as they are: 8-bit companded samples, or ADPCM blocks of BLOCK bytes. The
stored form is a RIFF/WAVE file; reading it back finds its chunks, takes the codes, and decodes
them: mu-law and A-law through 256-entry tables, ADPCM sample by sample of a block but across all
blocks of a batch at once. Decoded sound is resampled to a rate of the caller's choice by a
polyphase low-pass filter (a windowed sinc in whole numbers, so that every machine gets the same
samples) and kept as PCM; `digests` stores that PCM and computes features from what it reads back.

Cases: a null payload counts as empty; payloads are padded with bytes 255 to a positive multiple
of UNIT, so no file is empty; equal payloads give equal files; long payloads are decoded in
windows of blocks; a file with a broken container raises ValueError; an empty table gives an empty
result; columns named like an output are replaced, others pass through.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import discard, made_so_far, remove, scratch, slices, stored
from plumbline.sources.shared import exists

UNIT = 576
#: Bytes of an ADPCM block: a header of 4 and two samples in each other byte.
BLOCK = 36
#: Rate of the telephone sound, and of the PCM that is stored unless the caller says otherwise.
RATE, PCM_RATE = 8000, 4000
#: The resampling filter: zero crossings on either side, bits of its weights, samples made at once.
CROSSINGS, WEIGHT_BITS, MADE = 6, 15, 1 << 14
#: WAVE format tags.
TAGS = {"mulaw": 7, "alaw": 6, "ima_adpcm": 17}
NAMES = {tag: name for name, tag in TAGS.items()}
CODECS = tuple(TAGS)
#: ADPCM blocks that are decoded at once.
WINDOW = 1 << 13
#: Parts of the rows whose sound is on disk one after the other.
SHARDS = 8
#: Bytes of files that one step reads.
SLICE = 1 << 19

#: Fixed values of the IMA ADPCM standard: how a code moves the step index.
INDEX_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
#: Fixed values of the IMA ADPCM standard: the step sizes.
STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
        130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
        1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
        7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ],
    np.int32,
)


def mulaw_table() -> np.ndarray:
    """PCM of each mu-law code: inverted bits, a sign, 3 bits of exponent, 4 of mantissa, bias 132."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """PCM of each A-law code: every other bit inverted, a sign, exponent and mantissa."""
    code = np.arange(256) ^ 0x55
    exponent = code >> 4 & 7
    size = ((code & 15) << 4) + np.where(exponent > 0, 264, 8)
    size = np.where(exponent > 1, size << np.maximum(exponent - 1, 0), size)
    return np.where(code & 128, size, -size).astype(np.int16)


TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}


def decode_adpcm(codes: np.ndarray) -> np.ndarray:
    """PCM of whole blocks, block x sample; each step handles one sample of all blocks."""
    blocks = codes.reshape(-1, BLOCK)
    out = np.empty((len(blocks), 2 * (BLOCK - 4) + 1), np.int16)
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out[:, 0] = value
    for k in range(2 * (BLOCK - 4)):
        code = blocks[:, 4 + k // 2] >> (4 * (k & 1)) & 15
        step = STEPS[index]
        move = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(np.where(code & 8, value - move, value + move), -32768, 32767)
        index = np.clip(index + INDEX_MOVES[code], 0, 88)
        out[:, k + 1] = value
    return out


def pad(data: bytes) -> bytes:
    return data + b"\xff" * (-len(data) % UNIT or (0 if data else UNIT))


def to_wav(payload: bytes, codec: str) -> bytes:
    """A mono WAVE file whose data chunk is the payload."""
    adpcm = codec == "ima_adpcm"
    align, bits = (BLOCK, 4) if adpcm else (1, 8)
    each = 2 * (BLOCK - 4) + 1
    samples = len(payload) // BLOCK * each if adpcm else len(payload)
    speed = RATE * BLOCK // each if adpcm else RATE
    extra = struct.pack("<HH", 2, each) if adpcm else struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", TAGS[codec], 1, RATE, speed, align, bits) + extra
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples)
    body += b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def from_wav(media: bytes) -> tuple[str, bytes]:
    """Codec and payload of a WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, codec = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"fmt ":
            codec = NAMES.get(int.from_bytes(media[at + 8 : at + 10], "little"))
        if name == b"data":
            if codec is None or at + 8 + size > len(media):
                break
            return codec, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no sound of a known codec")


@cache
def kernels(up: int, down: int) -> tuple[int, list[np.ndarray]]:
    """Half width, and for each of `up` phases the weights, which sum to 2**WEIGHT_BITS."""
    wide = max(1.0, down / up)  # below the lower of both rates' half alone
    half = int(np.ceil(CROSSINGS * wide))
    found = []
    for phase in range(up):
        off = np.arange(1 - half, half + 1) - phase * down % up / up
        h = np.sinc(off / wide) * np.where(np.abs(off) <= half, np.cos(np.pi * off / (2 * half)) ** 2, 0)
        h = np.rint(h / h.sum() * 2**WEIGHT_BITS)
        h[half - 1] += 2**WEIGHT_BITS - h.sum()
        found.append(h)
    return half, found


def resampled(pcm: np.ndarray, rate: int = PCM_RATE, source: int = RATE) -> np.ndarray:
    """From one rate to another, any ratio: sample m is the filtered sound at m / rate; beyond
    either end the sound is silent. Sums are of whole numbers under 2**53, hence exact."""
    shared = gcd(rate, source)
    up, down = rate // shared, source // shared
    if up == down:
        return pcm.astype(np.int16)
    half, weights = kernels(up, down)
    n = -(-len(pcm) * up // down)
    out = np.empty(n, np.int16)
    for phase, h in enumerate(weights):
        first, mine = phase * down // up, out[phase::up]
        for a in range(0, len(mine), MADE):
            count = min(MADE, len(mine) - a)
            low = first + a * down + 1 - half
            high = low + (count - 1) * down + 2 * half
            x = np.zeros(high - low)
            inside = pcm[max(0, low) : max(0, min(high, len(pcm)))]
            x[max(0, -low) : max(0, -low) + len(inside)] = inside
            sums = np.lib.stride_tricks.sliding_window_view(x, 2 * half)[::down] @ h
            mine[a : a + count] = np.clip(np.floor(sums / 2**WEIGHT_BITS + 0.5), -32768, 32767)
    return out


def decode_all(found: list[tuple[str, bytes]], rate: int = PCM_RATE) -> list[np.ndarray]:
    """Resampled PCM of each payload; ADPCM blocks of all payloads are decoded together."""
    out: list = [None] * len(found)
    adpcm = [i for i, (codec, _) in enumerate(found) if codec == "ima_adpcm"]
    for i, (codec, payload) in enumerate(found):
        if codec != "ima_adpcm":
            out[i] = resampled(TABLES[codec][np.frombuffer(payload, np.uint8)], rate)
    if adpcm:
        flat = np.frombuffer(b"".join(found[i][1] for i in adpcm), np.uint8)
        pcm = np.concatenate([decode_adpcm(flat[a : a + WINDOW * BLOCK]) for a in range(0, len(flat), WINDOW * BLOCK)])
        ends = np.cumsum([len(found[i][1]) // BLOCK for i in adpcm])
        for i, part in zip(adpcm, np.split(pcm, ends[:-1]), strict=True):
            out[i] = resampled(part.ravel(), rate)
    return out


def store(rows: DataFrame, source: str, size: str = "n_bytes", media: str = "media") -> DataFrame:
    """rows with the payload's unpadded size and the WAVE file in place of the source column.

    The codec follows from the payload alone (its CRC-32), so that equal payloads are stored alike.
    """
    kept = [f for f in rows.schema.fields if f.name not in (size, media, source)]
    schema = T.StructType([*kept, T.StructField(size, T.LongType()), T.StructField(media, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, source, SLICE):
                raw = [x or b"" for x in part.column(source).to_pylist()]
                files = [to_wav(p, CODECS[zlib.crc32(p) % 3]) for p in map(pad, raw)]
                columns = [part.column(f.name) for f in kept]
                made = [pa.array(list(map(len, raw)), pa.int64()), pa.array(files, pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, *made], names=[f.name for f in schema.fields])

    return rows.select(*[F.col(f"`{f.name}`") for f in kept], F.col(source).cast("binary").alias(source)).mapInArrow(run, schema)


def feature(codec: str, pcm: np.ndarray) -> str:
    """Codec, samples, root mean square, peak and sign changes of resampled sound."""
    x = pcm.astype(np.float64)
    rms, peak = np.sqrt((x * x).mean()) if len(x) else 0.0, int(np.abs(x).max(initial=0))
    turns = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"{codec} n={len(x)} rms={rms:.2f} peak={peak} turns={turns}"


def read(rows: DataFrame, media: str = "media", rate: int = PCM_RATE) -> DataFrame:
    """rows with what the files hold: codec, payload, and pcm (resampled, 16 bits, little-endian)."""
    made = {"codec": T.StringType(), "payload": T.BinaryType(), "pcm": T.BinaryType()}
    kept = [f for f in rows.schema.fields if f.name not in made]
    schema = T.StructType([*kept, *(T.StructField(n, k) for n, k in made.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, media, SLICE):
                found = [from_wav(x) for x in part.column(media).to_pylist()]
                new = [
                    pa.array([c for c, _ in found], pa.string()),
                    pa.array([p for _, p in found], pa.binary()),
                    pa.array([x.astype("<i2").tobytes() for x in decode_all(found, rate)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[f.name for f in schema.fields])

    return rows.select([F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)


def heard(rows: DataFrame) -> DataFrame:
    """rows with a feature string of their sound in place of codec and pcm."""
    kept = [f for f in rows.schema.fields if f.name not in ("codec", "pcm", "feature")]
    schema = T.StructType([*kept, T.StructField("feature", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sound = zip(batch.column("codec").to_pylist(), batch.column("pcm"), strict=True)
            found = [feature(c, np.frombuffer(x.as_buffer(), "<i2")) for c, x in sound]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(found, pa.string())], names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


def digests(rows: DataFrame) -> DataFrame:
    """Sizes and digests of payloads (read back) and of files; the PCM is stored, and its size,
    digest and features come from the stored bytes."""
    sound = rows.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "codec",
        "pcm",
    )
    kept = stored(rows.sparkSession, sound, "sound")
    kept = kept.withColumn("pcm_bytes", F.octet_length("pcm").cast("long")).withColumn("pcm_sha256", F.sha2("pcm", 256))
    return heard(kept)


def in_shards(files: DataFrame, rate: int = PCM_RATE, shards: int = SHARDS) -> DataFrame:
    """As digests(read(files)), of stored files, shard by shard: a shard's PCM, which is larger than its
    file, is removed once its features are there, and so is its part of the files."""
    spark = files.sparkSession
    media, found = scratch(spark, "media"), scratch(spark, "features")
    shard = F.pmod(F.xxhash64(*files.columns), F.lit(shards)).alias("_shard")
    files.select("*", shard).write.option("compression", "zstd").partitionBy("_shard").parquet(media)
    schema = None
    for i in range(shards):
        part = f"{media}/_shard={i}"
        mark = made_so_far()
        rows = spark.read.schema(files.schema).parquet(part) if exists(spark, part) else spark.createDataFrame([], files.schema)
        out = digests(read(rows, rate=rate))
        schema = out.schema
        out.write.mode("append").parquet(found)
        discard(spark, mark)
        remove(spark, [part])
    return spark.read.schema(schema).parquet(found)
