"""SentencePiece encoding with spans in the source bytes, and decoding.

Normalisation takes the longest prefix that the model's compiled character map (a double-array
trie) knows, and records for each normalised byte which source byte it came from. All texts of a
batch are normalised at once, every model by the same steps; the trie is walked only from bytes
that start one of its prefixes (of which a model without a map has none). Pieces never
hold a word mark after another character (checked when a model is loaded), so merges cannot
cross the start of a word: the normalised text falls into independent segments, of which each
is segmented once per worker and then looked up. Pieces are projected to source spans through
the alignment.

Cases: a null text counts as empty and gives empty lists; one very long word is one segment, kept
until the next batch at most where it is beyond KEPT_PIECES; equal texts give equal rows, repeated rows stay; an empty table gives an empty
table; other columns pass through, except that an existing column named like an output
(`ids`, `begins`, `ends`, `decoded`) is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import list_array, slices, text_buffer

MARK = "▁"
OUTPUTS = ("ids", "begins", "ends", "decoded")
#: Segments, and pieces of segments, after which a worker forgets what it has looked up.
KEPT_SEGMENTS, KEPT_PIECES = 250_000, 2_000_000
#: Bytes of text that are encoded at once.
SLICE = 1 << 19


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class CharMap:
    """The compiled character map of a model: longest-prefix replacement on UTF-8 bytes."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.strings = blob[4 + size :]
        #: Whether a known prefix starts with a byte.
        self.starts = np.zeros(256, bool)
        if self.units:
            root = self._offset(self.units[0])
            self.starts[:] = [(root ^ b) < len(self.units) and self.units[root ^ b] & 0x800000FF == b for b in range(256)]

    def longest(self, data: bytes, at: int, end: int) -> tuple[bytes, int] | None:
        """The replacement of the longest known prefix of data[at:end], and that prefix's length."""
        units, node, found = self.units, 0, None
        if not units:
            return None
        node ^= self._offset(units[0])
        for i in range(at, end):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = (units[node] & 0x7FFFFFFF, i + 1 - at)
        if found is None:
            return None
        start, length = found
        return self.strings[start : self.strings.index(b"\0", start)], length

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)


def _room(held: np.ndarray, n: int) -> np.ndarray:
    """An array of at least n places that starts as held does."""
    return held if n <= len(held) else np.concatenate([held, np.zeros(max(n, 2 * len(held)) - len(held), held.dtype)])


class Codec:
    """One model; made once in each worker."""

    def __init__(self, blob: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto.FromString(blob)
        spec = proto.normalizer_spec
        self.map = CharMap(spec.precompiled_charsmap)
        self.prefix = spec.add_dummy_prefix
        self.squeeze = spec.remove_extra_whitespaces
        if not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that mark the start of words are supported")
        if any(p.type == pb.ModelProto.SentencePiece.USER_DEFINED for p in proto.pieces):
            raise ValueError("models with user-defined symbols are not supported")
        self.split = not any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in proto.pieces)
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=blob)
        plain = pb.ModelProto.FromString(blob)  # segments it gets are normalised already
        plain.normalizer_spec.precompiled_charsmap = b""
        plain.normalizer_spec.name = "identity"
        plain.normalizer_spec.add_dummy_prefix = False
        plain.normalizer_spec.remove_extra_whitespaces = False
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=plain.SerializeToString())
        self.lengths = np.array(
            [1 if p.type == pb.ModelProto.SentencePiece.BYTE else len(p.piece.encode()) for p in proto.pieces], np.int32
        )
        self.unknown = proto.trainer_spec.unk_id
        self._forget()

    def _forget(self) -> None:
        self.index: dict = {}
        self.starts, self.counts = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.ids, self.sizes = np.zeros(4096, np.int32), np.zeros(4096, np.int32)
        self.used = 0

    def normalise(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Normalised bytes of consecutive texts, their offsets, and the alignment: for each byte,
        and for the end of each text, the byte of its own source text."""
        n, texts = len(data), len(offsets) - 1
        counts = np.ones(n, np.int64)  # bytes that each source byte gives
        replaced = np.zeros(n, bool)
        new, done, raw = [], 0, None
        for at in np.flatnonzero(self.map.starts[data]).tolist():
            if at < done or data[at] & 0xC0 == 0x80:
                continue
            raw = data.tobytes() if raw is None else raw
            hit = self.map.longest(raw, at, int(offsets[np.searchsorted(offsets, at, side="right")]))
            if hit is not None and raw[at : at + hit[1]] == hit[0]:
                done = at + hit[1]
            elif hit is not None:
                new.append(hit[0])
                done = at + hit[1]
                counts[at:done] = 0
                counts[at], replaced[at] = len(hit[0]), bool(hit[0])
        source, text = np.arange(n), np.repeat(np.arange(texts), np.diff(offsets))
        out = data
        if done:
            source = np.repeat(source, counts)
            out, text = data[source], text[source]
            out[replaced[source]] = np.frombuffer(b"".join(new), np.uint8)
        ends = np.diff(offsets).copy()  # by text, the source byte behind its last
        filled = ends > 0
        if self.squeeze:  # spaces at either end go, and runs of them become one
            space = out == 32
            first = np.cumsum(counts)[source] - counts[source]  # where what the source byte gave starts
            solid = np.concatenate([[0], np.cumsum(~space)])
            leading = solid[np.arange(len(out)) + 1] == solid[first]
            begin = np.searchsorted(text, np.arange(texts))
            after_space = (first == begin[text]) | space[first - 1]
            kept = ~(space & leading & after_space)
            out, source, text = out[kept], source[kept], text[kept]
            filled = np.bincount(text, minlength=texts) > 0
        align = source - offsets[text]
        if self.prefix:
            at = np.searchsorted(text, np.flatnonzero(filled))
            has = (at < len(text)) & (np.append(text, -1)[at] == np.flatnonzero(filled))
            align = np.insert(align, at, np.where(has, np.append(align, 0)[at], 0))
            out, text = np.insert(out, at, 32), np.insert(text, at, np.flatnonzero(filled))
        space = out == 32
        sizes = np.where(space, 3, 1)
        marks = np.repeat(space, sizes)
        out, align, text = np.repeat(out, sizes), np.repeat(align, sizes), np.repeat(text, sizes)
        out[marks] = np.tile(np.frombuffer(MARK.encode(), np.uint8), int(space.sum()))
        if self.squeeze:  # marks at the end go, also those that the text itself held
            first = np.flatnonzero((out[:-2] == 0xE2) & (out[1:-1] == 0x96) & (out[2:] == 0x81)) if len(out) > 2 else np.zeros(0, np.int64)
            mark = np.zeros(len(out), bool)
            mark[(first[:, None] + np.arange(3)).ravel()] = True
            solid, last = np.flatnonzero(~mark), np.full(texts, -1)
            last[text[solid]] = solid
            tail = np.flatnonzero(np.arange(len(out)) > last[text])[::-1]
            ends[text[tail]] = align[tail]  # the first mark that goes counts
            out, align, text = (np.delete(x, tail) for x in (out, align, text))
        bounds = np.searchsorted(text, np.arange(texts + 1))
        return out, bounds, np.insert(align, bounds[1:], ends)

    def segments(self, norm: str) -> list:
        """Keys of the independent segments of a normalised text, in order.

        A key is a word without its mark, a longer segment that starts with marks, or, for a
        text that starts without a mark, a tuple.
        """
        if not norm:
            return []
        if not self.split:
            return [("", norm)]
        keys = norm.split(MARK)
        first = keys.pop(0)
        if "" in keys:
            keys = [s[1:] if s[1:2] != MARK and len(s) > 1 else s for s in re.findall(f"{MARK}+[^{MARK}]*", norm)]
        return [("", first), *keys] if first else keys

    @staticmethod
    def surface(key) -> str:
        if isinstance(key, tuple):
            return key[1]
        return key if key.startswith(MARK) else MARK + key

    def _learn(self, keys: list) -> None:
        surfaces = list(map(self.surface, keys))
        found = self.plain.encode(surfaces, num_threads=1)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum()))
        sizes, starts = self.lengths[ids], np.cumsum(counts) - counts
        odd = np.unique(np.searchsorted(starts, np.flatnonzero(ids == self.unknown), side="right") - 1)
        for i in odd.tolist():  # a piece of its own length stands for what is unknown
            own = [len(p.encode()) for p in self.plain.encode(surfaces[i], out_type=str)]
            sizes[starts[i] : starts[i] + counts[i]] = own
        at, n = len(self.index), len(keys)
        self.starts, self.counts = (_room(x, at + n) for x in (self.starts, self.counts))
        self.ids, self.sizes = (_room(x, self.used + len(ids)) for x in (self.ids, self.sizes))
        self.starts[at : at + n], self.counts[at : at + n] = starts + self.used, counts
        self.ids[self.used : self.used + len(ids)], self.sizes[self.used : self.used + len(ids)] = ids, sizes
        self.index.update(zip(keys, range(at, at + n), strict=True))
        self.used += len(ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, begins and ends (source bytes) of all texts, and the ids in each text."""
        return self.encode_bytes(*text_buffer(pa.array(texts, pa.string())))

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if len(self.index) > KEPT_SEGMENTS or self.used > KEPT_PIECES:
            self._forget()
        norm, bounds, align = self.normalise(data, offsets)
        raw, cuts = norm.tobytes(), bounds.tolist()
        keys = [self.segments(raw[a:b].decode()) for a, b in zip(cuts, cuts[1:], strict=False)]
        new = [k for k in dict.fromkeys(chain.from_iterable(keys)) if k not in self.index]
        if new:
            self._learn(new)
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(keys)), np.int64)
        counts = self.counts[at]
        total = int(counts.sum())
        where = np.repeat(self.starts[at] - (np.cumsum(counts) - counts), counts) + np.arange(total)
        ids, sizes = self.ids[where], self.sizes[where].astype(np.int64)
        owner = np.repeat(np.arange(len(keys)), [len(ks) for ks in keys])
        per = np.bincount(owner, weights=counts, minlength=len(keys)).astype(np.int64)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        # one more alignment entry than bytes in each text
        shift = np.repeat(np.arange(len(keys)), per)
        return ids, align[begins + shift], align[ends + shift], per

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.whole.decode(ids, num_threads=1) if ids else []


_codecs: dict[bytes, Codec] = {}


def codec(blob: bytes) -> Codec:
    if blob not in _codecs:
        _codecs.clear()
        _codecs[blob] = Codec(blob)
    return _codecs[blob]


def encode_decode(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """docs with ids, begins and ends (byte spans in the source text), and the decoded text."""
    kept = [f for f in docs.schema.fields if f.name not in OUTPUTS]
    if text not in [f.name for f in kept]:
        raise ValueError(f"no usable text column {text}")
    ints = T.ArrayType(T.IntegerType(), False)
    schema = T.StructType(
        [*kept, *(T.StructField(c, ints) for c in OUTPUTS[:3]), T.StructField("decoded", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            for part in slices(batch, text, SLICE):
                ids, begins, ends, per = own.encode_bytes(*text_buffer(part.column(text)))
                cuts = np.cumsum(per)[:-1]
                decoded = own.decode([a.tolist() for a in np.split(ids, cuts)])
                lists = [list_array(a.astype(np.int32), per, pa.int32()) for a in (ids, begins, ends)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *lists, pa.array(decoded, pa.string())], names=[f.name for f in schema.fields]
                )

    return docs.select([F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    """n_tokens, SHA-256 of the ids (decimal, joined by commas) and of the decoded text, a hash of
    all spans, and the bytes that they cover; more columns on demand."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.xxhash64("begins", "ends").alias("spans_hash"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)) - F.try_element_at("begins", F.lit(1)), F.lit(0)).cast("long").alias("covered_bytes"),
        *more,
    )
