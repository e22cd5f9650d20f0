"""Vectors: a model-free embedder, exhaustive search in blocks, cosines."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from plumbline.operators.sparse import top

DIM = 64
#: Texts that a worker cuts at once; tokens that it digests at once.
TEXTS, BLOCK = 500, 4096
#: Bytes of vectors that a task holds, of queries and, where these are more, of rows.
QUERY_BYTES = 32 << 20
#: Tiles of many queries and rows, at least, and shuffle partitions for each, so that few tiles meet in one task.
TILES, SPREAD = 64, 4
#: Scores that a task holds at once.
HELD = 2 << 20
#: Rows that are scored in full before others are screened; queries and rows of a block of the screen; pairs whose vectors are held.
FIRST, QUERIES, ROWS, PAIRS = 256, 1024, 512, 1 << 16
#: Rows, about, by which many queries learn in advance what a hit must reach; so many queries are many. Of large tables
#: up to LEARN times as many rows, one in SHARE.
SAMPLE, LEARN, SHARE = 8192, 8, 32
#: Lengths up to which queries of whole numbers are screened together, two rows to a number, if they are as many as PACKED;
#: their products are under ROOM.
LENGTHS, PACKED, ROOM = (3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 16, 20, 24, 32), 256, 2048
#: Queries whose best products are looked at before each of them is.
TOGETHER = 8


def bucket(token: str) -> int:
    return hashlib.md5(token.encode()).digest()[-1] % DIM  # the low bits of the whole digest


#: MD5 (RFC 1321): rotations of its four rounds, constants, order of the words.
TURNS = np.repeat(np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], np.uint32), 4, axis=0).ravel()
SINES = (np.abs(np.sin(np.arange(1, 65))) * 2**32).astype(np.uint32)
WORDS = np.concatenate([(a * np.arange(16) + b) % 16 for a, b in ((1, 0), (5, 1), (3, 5), (7, 0))])


def buckets(tokens: pa.Array) -> np.ndarray:
    """`bucket` of each token. Those of one block of MD5 (up to 55 bytes) are digested together, a step of all at a time."""
    size = pc.binary_length(tokens).to_numpy().astype(np.int64)
    out = np.zeros(len(tokens), np.int64)
    for a in range(0, len(tokens), BLOCK):
        part, n = tokens.slice(a, BLOCK), size[a : a + BLOCK]
        short, long = np.flatnonzero(n < 56), np.flatnonzero(n >= 56)
        out[a + long] = [bucket(t) for t in part.take(pa.array(long)).to_pylist()]
        n = n[short]
        data = part.take(pa.array(short)).buffers()[2] if n.any() else b""
        held = np.zeros((len(short), 64), np.uint8)
        row = np.repeat(np.arange(len(short)), n)
        held[row, np.arange(len(row)) - (np.cumsum(n) - n)[row]] = np.frombuffer(data, np.uint8, len(row))
        held[np.arange(len(short)), n] = 0x80
        x = np.ascontiguousarray(held.view("<u4").T)
        x[14] = 8 * n
        p, q, r, s = (np.full(len(short), v, np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
        for i in range(64):
            mixed = _mixed(i // 16, q, r, s)
            mixed += p
            mixed += SINES[i]
            mixed += x[WORDS[i]]
            p, q, r, s = s, q + ((mixed << TURNS[i]) | (mixed >> (32 - TURNS[i]))), q, r
        out[a + short] = ((s + np.uint32(0x10325476)) >> np.uint32(24)) % DIM
    return out


def _mixed(stage: int, q: np.ndarray, r: np.ndarray, s: np.ndarray) -> np.ndarray:
    if stage == 0:
        return s ^ (q & (r ^ s))
    if stage == 1:
        return r ^ (s & (q ^ r))
    return q ^ r ^ s if stage == 2 else r ^ (q | ~s)


#: A character that Arrow may lower-case, or take for white space, otherwise than Python does (a sigma's form depends on what is around it).
UNLIKE = r"[^\x{0}-\x{12f}\x{131}-\x{36f}\x{400}-\x{1c7f}\x{1e00}-\x{1eff}\x{2000}-\x{30ff}]"


def bucket_counts(texts: pa.Array) -> np.ndarray:
    """Text x bucket: how many white-space tokens of each lower-cased text fall into each bucket; null as empty.

    Texts are cut by Arrow, and each distinct token of them is looked up once; texts with rare characters are cut by Python.
    """
    texts = pc.fill_null(texts, "")
    unlike = pc.match_substring_regex(texts, UNLIKE)
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.if_else(unlike, "", texts)))
    flat = lists.flatten().dictionary_encode()
    of = buckets(flat.dictionary)
    of[pc.equal(flat.dictionary, "").to_numpy(zero_copy_only=False)] = -1
    at = of[flat.indices.to_numpy()] if len(of) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    out = np.bincount((row * DIM + at)[at >= 0], minlength=len(texts) * DIM).reshape(len(texts), DIM)
    for i in np.flatnonzero(unlike.to_numpy(zero_copy_only=False)):
        out[i] = np.bincount(list(map(bucket, texts[i].as_py().lower().split())), minlength=DIM)
    return out


def hash_counts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, vec: how often each of DIM buckets has a white-space token of the lower-cased text, by
    MD5. Texts without token have no row. It stands where a model's embedder would, in Arrow batches."""
    slim = rows.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T_.StructType([T_.StructField(key, slim.schema["key"].dataType), T_.StructField("vec", T_.ArrayType(T_.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(a, TEXTS) for a in range(0, batch.num_rows, TEXTS)):
                counts = bucket_counts(part.column("text"))
                kept = np.flatnonzero(counts.any(axis=1))
                flat = counts[kept].astype(np.float64).ravel()
                vec = pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1, dtype=np.int32) * DIM), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(kept)), vec], names=[key, "vec"])

    return slim.mapInArrow(run, schema)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.try_divide(dot(a, b), size), F.lit(0.0))


def normalised(v: Column) -> Column:
    size = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(size == 0, 1.0).otherwise(size))


def scored(q: np.ndarray, m: np.ndarray, metric: str) -> np.ndarray:
    """Query x row: cosine or inner product, or squared distance, rounded to 9 places."""
    inner = q @ m.T
    if metric == "dot":
        return np.round(inner, 9)
    q2, m2 = (q * q).sum(axis=1), (m * m).sum(axis=1)
    if metric == "l2":
        return np.round(np.maximum(q2[:, None] + m2[None, :] - 2 * inner, 0), 9)
    length = np.sqrt(q2)[:, None] * np.sqrt(m2)[None, :]
    return np.round(np.divide(inner, length, out=np.zeros_like(inner), where=length > 0), 9)


def _pairs_scored(q: np.ndarray, m: np.ndarray, metric: str) -> np.ndarray:
    """Of each row of q and the same row of m, as `scored`."""
    inner = np.einsum("ij,ij->i", q, m)
    if metric == "dot":
        return np.round(inner, 9)
    q2, m2 = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", m, m)
    if metric == "l2":
        return np.round(np.maximum(q2 + m2 - 2 * inner, 0), 9)
    length = np.sqrt(q2) * np.sqrt(m2)
    return np.round(np.divide(inner, length, out=np.zeros_like(inner), where=length > 0), 9)


class _Screen:
    """Bounds of scores (the larger the better) by a product in single precision.

    Another column holds what rounding can take from a product, |q| |m| (dimensions + 16) / 2 ** 22 at
    most, so no pair's bound is below its score; for `l2` a last one holds the row's square. Lengths that single precision has no room for are left in double.
    """

    def __init__(self, q: np.ndarray, metric: str) -> None:
        self.metric, self.slack = metric, (q.shape[1] + 16) * 2.0**-22
        self.q2 = (q * q).sum(axis=1)
        x, length = self._scaled(q, np.sqrt(self.q2))
        scale, beside = (2.0, -1.0) if metric == "l2" else (1.0, 0.0)
        self.double = np.concatenate([scale * x, (scale * self.slack * length)[:, None], np.full((len(x), 1), beside)], axis=1)
        self.fits = self._fits(np.sqrt(self.q2))
        self.single = self.double.astype(np.float32) if self.fits else self.double

    @staticmethod
    def _fits(length: np.ndarray) -> bool:
        return bool(((length == 0) | ((length > 1e-8) & (length < 1e8))).all())

    def _scaled(self, x: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.metric != "cosine":
            return x, length
        return x / np.where(length > 0, length, 1)[:, None], np.where(length > 0, 1.0, 0.0)

    def rows(self, m: np.ndarray) -> np.ndarray:
        m2 = (m * m).sum(axis=1)
        x, length = self._scaled(m, np.sqrt(m2))
        beside = m2 * (1 - self.slack) if self.metric == "l2" else np.zeros(len(m))
        out = np.concatenate([x, length[:, None], beside[:, None]], axis=1)
        return out.astype(np.float32) if self.fits and self._fits(np.sqrt(m2)) else out

    def bar(self, least: np.ndarray) -> np.ndarray:
        """What a bound must reach for its score, rounded to 9 places, to reach least."""
        low = least - 1e-9
        if self.metric == "l2":
            low = low + self.q2 - self.slack * (self.q2 + np.abs(np.where(np.isfinite(least), least, 0)))
        else:
            low = low - np.abs(np.where(np.isfinite(least), least, 0)) * 1e-6
        return low

    def reach(self, at: slice, rows: np.ndarray, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries (from the slice's start) and rows whose bound reaches the query's bar."""
        if rows.dtype == np.float32:
            ours, low = self.single[at], np.nextafter(bar[at].astype(np.float32), np.float32(-np.inf))
        else:
            ours, low = self.double[at], bar[at]
        return _places(ours @ rows.T >= low[:, None])


def _places(fit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a matrix, of which little is true, is true."""
    width, fit = fit.shape[1], fit.ravel()
    if len(fit) % 8 == 0:  # eight are looked at at once
        at = (np.flatnonzero(fit.view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
        return np.divmod(at[fit[at]], width)
    return np.divmod(np.flatnonzero(fit), width)


class _Packed:
    """Bounds of cosines of queries of whole numbers, none below 0, and rows without a value below 0.

    Queries stand as they are. Rows of length 1 are rounded to whole numbers, of a size at which no product p with a query
    reaches ROOM, and two of them are packed into one number. With a column for the query's bar, a product is
    16 (p - bar) + 65536 (p' - bar): a whole number that single precision holds exactly, whichever way it is added up. Its halves of 16 bits
    are at least -1 wherever a row's product reaches the bar, which is lowered by what rounding the row can take from it.
    """

    def __init__(self, q: np.ndarray, most: int) -> None:
        self.length = np.sqrt((q * q).sum(axis=1))
        self.scale = self.size(most, q.shape[1])
        self.held = np.concatenate([q, np.zeros((len(q), 1))], axis=1).astype(np.float32)

    @staticmethod
    def size(most: int, dim: int) -> float:
        """Of a row's whole numbers; rounding makes a row longer by half the root of its dimensions at most."""
        return (ROOM - 1) / most - np.sqrt(dim) / 2

    @staticmethod
    def fit(m: np.ndarray) -> bool:
        return bool(len(m)) and bool((m >= 0).all()) and _Screen._fits(np.sqrt((m * m).sum(axis=1)))

    def bar(self, least: np.ndarray) -> np.ndarray:
        return least - 1e-9 - np.abs(np.where(np.isfinite(least), least, 0)) * 1e-6

    def rows(self, m: np.ndarray, bar: np.ndarray) -> np.ndarray:
        """The packed rows; queries take their bars."""
        length = np.sqrt((m * m).sum(axis=1))
        full = m * (self.scale / np.where(length > 0, length, 1))[:, None]
        whole = np.rint(full)
        lost = np.sqrt(((full - whole) ** 2).sum(axis=1)).max() * (1 + 1e-9)
        self.held[:, -1] = -np.clip(np.ceil((bar * self.scale - lost) * self.length), 0, ROOM - 1)
        if len(m) % 2:
            whole = np.concatenate([whole, np.zeros((1, m.shape[1]))])
        two = 16 * whole[::2] + 65536 * whole[1::2]
        return np.concatenate([two, np.full((len(two), 1), 16.0 + 65536.0)], axis=1).astype(np.float32)

    def reach(self, at: slice, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries (from the slice's start) and rows whose bound reaches the query's bar, and maybe one row more than there are."""
        halves = (self.held[at] @ rows.T).astype("<i4").view("<i2")
        n, width = halves.shape[0] - halves.shape[0] % TOGETHER, halves.shape[1]
        i, c = _places(halves[:n].reshape(-1, TOGETHER, width).max(axis=1) >= np.int16(-1))
        i, c = (i[:, None] * TOGETHER + np.arange(TOGETHER)).ravel(), np.repeat(c, TOGETHER)
        fit = halves[i, c] >= -1
        if n == len(halves):
            return i[fit], c[fit]
        last, there = _places(halves[n:] >= np.int16(-1))
        return np.concatenate([i[fit], last + n]), np.concatenate([c[fit], there])


def _together(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of small parts put together, up to about PAIRS."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= PAIRS:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


class _Screens:
    """The queries by the screen that they have: packed ones where queries and rows allow it."""

    def __init__(self, q: np.ndarray, metric: str) -> None:
        self.q, self.metric, self.known = q, metric, {}

    def of(self, m: np.ndarray) -> list[tuple[np.ndarray, _Screen | _Packed]]:
        """Places of queries, and their screen, for rows like these."""
        packed = self.metric == "cosine" and len(self.q) >= PACKED and _Packed.fit(m)
        if packed not in self.known:
            self.known[packed] = self._made(packed)
        return self.known[packed]

    def reached(self, m: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Queries and rows whose bound reaches what the query must, a block of queries at a time."""
        for at, screen in self.of(m):
            bar = screen.bar(least[at])
            packed = isinstance(screen, _Packed)
            bounds = screen.rows(m, bar) if packed else screen.rows(m)
            for b in range(0, len(at), QUERIES):
                some = slice(b, b + QUERIES)
                r, c = screen.reach(some, bounds) if packed else screen.reach(some, bounds, bar)
                if packed and len(m) % 2:
                    r, c = r[c < len(m)], c[c < len(m)]
                if len(r):
                    yield at[r + b], c

    def _made(self, packed: bool) -> list[tuple[np.ndarray, _Screen | _Packed]]:
        rest, out = np.ones(len(self.q), bool), []
        if packed:
            length = np.sqrt((self.q * self.q).sum(axis=1))
            whole = ((self.q >= 0) & (self.q == np.rint(self.q))).all(axis=1) & (length > 0)
            for most in LENGTHS:
                at = np.flatnonzero(rest & whole & (length <= most))
                if len(at) >= PACKED and _Packed.size(most, self.q.shape[1]) > most:
                    out.append((at, _Packed(self.q[at], most)))
                    rest[at] = False
        at = np.flatnonzero(rest)
        return [*out, (at, _Screen(self.q[at], self.metric))] if len(at) else out


def _slack(q: np.ndarray, most: float, metric: str) -> np.ndarray | float:
    """More than the rounding of a score may differ from one way of adding to another; most: the largest square of a row."""
    return 1e-8 if metric == "cosine" else 1e-8 + 1e-9 * ((q * q).sum(axis=1) + most)


def _as_batches(keys: np.ndarray, m: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(m), SAMPLE):
        x = m[a : a + SAMPLE]
        vec = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * m.shape[1]), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + SAMPLE]), vec], names=["key", "vec"])


def _few_copies(rows: np.ndarray, m: np.ndarray, k: int) -> np.ndarray:
    """Places of rows without those that k rows of the same vector and a smaller key stand before."""
    if len(m) <= k or not m.shape[1]:
        return np.arange(len(m))
    _, group = np.unique(np.ascontiguousarray(m).view(np.dtype((np.void, m.dtype.itemsize * m.shape[1]))).ravel(), return_inverse=True)
    order = np.lexsort((rows, group))
    sorted_ = group[order]
    return np.sort(order[np.arange(len(order)) - np.searchsorted(sorted_, sorted_) < k])


def reached(q: np.ndarray, names: np.ndarray, m: np.ndarray, rows: np.ndarray, k: int, metric: str, skip_same: bool) -> np.ndarray:
    """What k of these rows reach for each query (the larger the better), and so the k best of any table that has them.

    It is lowered by more than the rounding of a score may differ from one way of adding to another.
    """
    out = np.full(len(q), -np.inf)
    if len(m) < k:
        return out
    step = max(1, HELD // len(m))
    most = (m * m).sum(axis=1).max()
    for a in range(0, len(q), step):
        x = q[a : a + step]
        v = scored(x, m, metric) * (-1.0 if metric == "l2" else 1.0)
        v[~np.isfinite(v)] = -np.inf
        if skip_same:
            v[names[a : a + step, None] == rows[None, :]] = -np.inf
        low = np.partition(v, len(m) - k, axis=1)[:, len(m) - k]
        out[a : a + step] = low - _slack(x, most, metric)
    out[~np.isfinite(out)] = -np.inf
    return out


def nearest(q: np.ndarray, names: np.ndarray, batches: Iterator[pa.RecordBatch], k: int, metric: str, skip_same: bool, bars: np.ndarray | None = None) -> pa.RecordBatch | None:
    """qid, key, score: each query's k best of the rows (key, vec) that stream by, without those that don't reach its bar.

    The first rows are scored against all queries, unless these have bars. Of the others, a product in single precision
    (`_Screen`; of counts, one for two rows, `_Packed`) rules out what can't reach the k-th score so far; the rest is scored pair by pair, and put in order
    whenever the rows seen have doubled or the pairs found are many.
    """
    best, least = _best(q, names, batches, k, metric, skip_same, bars)
    if best is None:
        return None
    score = best[2] if metric != "l2" else -best[2]
    return pa.RecordBatch.from_arrays([pa.array(names[best[0]], pa.int64()), pa.array(best[1], pa.int64()), pa.array(score)], names=["qid", "key", "score"])


def _best(q: np.ndarray, names: np.ndarray, batches: Iterator[pa.RecordBatch], k: int, metric: str, skip_same: bool, bars: np.ndarray | None) -> tuple[tuple | None, np.ndarray]:
    """The places of queries, keys and scores (the larger the better) of `nearest`, and what a row must now reach for each query."""
    sign = 1.0 if metric == "l2" else -1.0
    screens = _Screens(q, metric)
    best, least = None, np.full(len(q), -np.inf) if bars is None else bars.copy()  # least: what a row must reach for each query
    waiting, held, seen, ordered = [], 0, 0, 0
    first = 0 if np.isfinite(least).all() else FIRST

    def merge() -> None:
        nonlocal best, waiting, held, ordered
        found = tuple(np.concatenate(x) for x in zip(*(waiting if best is None else [best, *waiting]), strict=True))
        order = np.lexsort((found[1], -found[2], found[0]))
        group = found[0][order]
        place = np.arange(len(order)) - np.searchsorted(group, group)
        least[group[place == k - 1]] = found[2][order[place == k - 1]]
        best = tuple(x[order[place < k]] for x in found)
        waiting, held, ordered = [], 0, seen

    for batch in batches:
        if not batch.num_rows:
            continue
        m = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        rows = batch.column("key").to_numpy()
        some = _few_copies(rows, m, k + skip_same)
        m, rows = m[some], rows[some]
        step = max(1, min(FIRST, HELD // max(1, len(q))))
        a = 0
        while seen < first and a < len(m):
            there = rows[a : a + step]
            v = -sign * scored(q, m[a : a + step], metric)  # the larger the better
            if skip_same:
                v[names[:, None] == there[None, :]] = -np.inf
            bar = least if len(there) <= k else np.maximum(least, np.partition(v, len(there) - k, axis=1)[:, len(there) - k])
            r, c = np.nonzero((v >= bar[:, None]) & (v > -np.inf))
            waiting.append((r, there[c], v[r, c]))
            a, seen = a + len(there), seen + len(there)
            merge()
        m, rows = m[a:], rows[a:]
        for a in range(0, len(m), ROWS):
            there, block = rows[a : a + ROWS], m[a : a + ROWS]
            for pairs in _together(screens.reached(block, least)):
                for x in range(0, len(pairs[0]), PAIRS):  # the two vectors of each pair are held
                    i, j = (y[x : x + PAIRS] for y in pairs)
                    v = -sign * _pairs_scored(q[i], block[j], metric)
                    fit = (v >= least[i]) & (v > -np.inf)
                    if skip_same:
                        fit &= names[i] != there[j]
                    waiting.append((i[fit], there[j[fit]], v[fit]))
                    held += int(fit.sum())
                    if held >= max(k * len(q), HELD):
                        merge()
            seen += len(there)
            if seen >= 2 * ordered and waiting:
                merge()
    if waiting:
        merge()
    return best, least


def search(
    vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", key: str = "doc_id", qid: str = "qid", skip_same: bool = False
) -> DataFrame:
    """qid, key, score, rank: each query's k best rows, exhaustively; ties go to the smaller key.

    metric: `cosine` or `dot` (largest first), or `l2` (squared distance, smallest first). Query
    vectors that are counted to be at most QUERY_BYTES go along with the scan of the rows. More are
    dealt, by a hash, to groups of that size, and the rows to shards; a task gets one group and one
    shard; partitions are more than tiles, and their number is fixed, so tiles are neither put together
    nor left to one task. Either way a task keeps each query's k best of its rows, and only those are shuffled. More than SAMPLE
    queries are first scored against about so many of the rows, so that tasks leave out from the start what
    those beat. k beyond the rows gives all rows.
    """
    if metric not in ("cosine", "dot", "l2"):
        raise ValueError("metric is cosine, dot or l2")
    kept = vectors.select(F.col(key).cast("long").alias("key"), F.col("vec").cast("array<double>").alias("vec")).filter("vec is not null")
    asked = queries.select(F.col(qid).cast("long").alias("qid"), F.col("vec").cast("array<double>").alias("vec")).filter("vec is not null")
    n, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("vec")), F.lit(0))).first()
    out = "qid long, key long, score double"
    if not n:
        return vectors.sparkSession.createDataFrame([], f"{qid} long, {key} long, score double, rank int")
    many, there = n > SAMPLE, None
    if many:
        there = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("vec")), F.lit(0))).first()
        asked = _with_bars(asked, kept, there[0], k, metric, skip_same)
    bars_of = lambda table: table.column("bar").to_numpy() if many else None
    if 8 * size <= QUERY_BYTES:
        held = asked.toArrow()
        q, names, bars = _matrix(held), held.column("qid").to_numpy(), bars_of(held)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = nearest(q, names, batches, k, metric, skip_same, bars)
            if found is not None:
                yield found

        found = kept.mapInArrow(run, out)
    else:
        there = there or kept.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("vec")), F.lit(0))).first()
        groups = _parts(n, size)
        shards = max(_parts(*there), min(there[0], -(-TILES // groups)), 1)
        spread = lambda side: side.repartition(SPREAD * groups * shards, "grp", "shard").groupBy("grp", "shard")
        each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>"))
        left = asked.withColumn("grp", F.pmod(F.xxhash64("qid", "vec"), F.lit(groups))).withColumn("shard", each(shards))
        right = kept.withColumn("shard", F.pmod(F.xxhash64("key", "vec"), F.lit(shards))).withColumn("grp", each(groups))

        def tile(ours: pa.Table, theirs: pa.Table) -> pa.Table:
            found = nearest(_matrix(ours), ours.column("qid").to_numpy(), theirs.to_batches(), k, metric, skip_same, bars_of(ours)) if ours.num_rows else None
            empty = pa.schema([("qid", pa.int64()), ("key", pa.int64()), ("score", pa.float64())]).empty_table()
            return empty if found is None else pa.Table.from_batches([found])

        found = spread(left).cogroup(spread(right)).applyInArrow(tile, out)
    order = F.asc("score") if metric == "l2" else F.desc("score")
    return top(found, k, "qid", order, F.asc("key")).select(F.col("qid").alias(qid), F.col("key").alias(key), "score", "rank")


def _with_bars(asked: DataFrame, kept: DataFrame, rows: int, k: int, metric: str, skip_same: bool) -> DataFrame:
    """asked (qid, vec) with bar: what about SAMPLE rows, by a hash of their keys, let a hit reach at least, or, of
    large tables, one row in SHARE."""
    wanted = min(max(SAMPLE, rows // SHARE), LEARN * SAMPLE)
    some = kept.filter(F.pmod(F.xxhash64("key"), F.lit(max(1, rows // wanted))) == 0).limit(2 * wanted).toArrow()
    room = max(2 * SAMPLE, QUERY_BYTES * some.num_rows // max(1, some.column("vec").nbytes))
    some = some.select(["key", "vec"]).slice(0, room)
    m, keys = _matrix(some), some.column("key").to_numpy()
    most = (m * m).sum(axis=1).max() if len(m) else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q = _matrix(pa.Table.from_batches([batch]))
                bar = _best(q, batch.column("qid").to_numpy(), _as_batches(keys, m), k, metric, skip_same, None)[1]
                bar = np.where(np.isfinite(bar), bar - _slack(q, most, metric), -np.inf)
                yield pa.RecordBatch.from_arrays([batch.column("qid"), batch.column("vec"), pa.array(bar)], names=["qid", "vec", "bar"])

    return asked.mapInArrow(run, "qid long, vec array<double>, bar double")


def _matrix(rows: pa.Table) -> np.ndarray:
    flat = rows.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows.num_rows, -1) if rows.num_rows else flat.reshape(0, 1)


def _parts(n: int, size: int) -> int:
    """Parts of at most about QUERY_BYTES of vectors, and no more than there are rows."""
    return max(1, min(n, -(-8 * size // QUERY_BYTES)))
