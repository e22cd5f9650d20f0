"""What the training-data operators share: table access, shared storage, text slices."""

from __future__ import annotations

import threading
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources import shared
from plumbline.sources.shared import shared_dir

__all__ = ["shared_dir"]
#: Bytes of text that one numpy step holds at once (a longer text comes alone).
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class _Made(threading.local):
    """Folders that `stored` and `scratch` made in this thread and `discard` hasn't removed, in order."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_made = _Made()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; nothing is there yet. What is left there goes with the session."""
    path = shared.scratch(spark, name)
    _made.paths.append(path)
    return path


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, outlives executors."""
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._stored_at = path
    return made


def taken(since: int) -> list[str]:
    """What was stored after the mark, for the caller to remove: `discard` forgets it."""
    paths = _made.paths[since:]
    del _made.paths[since:]
    return paths


def made_so_far() -> int:
    """A mark for `discard`, which holds in this thread."""
    return len(_made.paths)


def discard(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Removes what was stored after the mark, but for the last `keep`: nothing may read it again."""
    stop = max(since, len(_made.paths) - keep)
    remove(spark, _made.paths[since:stop])
    del _made.paths[since:stop]


def discard_but(spark: SparkSession, since: int, *frames: DataFrame) -> None:
    """Removes what was stored after the mark, but for these frames, as `stored` gave them."""
    kept = [p for p in _made.paths[since:] if p in {f._stored_at for f in frames}]
    remove(spark, [p for p in _made.paths[since:] if p not in kept])
    _made.paths[since:] = kept


def remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        shared.remove(spark, path)


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string or binary column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = int(offsets[0]) if n else 0
    last = int(offsets[-1]) if n else 0
    return raw[first:last], offsets - first


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch, each with at most `most` bytes of text, or one row."""
    n = batch.num_rows
    if not n:
        return
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths.astype(np.int64))
    start = 0
    while start < n:
        base = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and the number of values in each row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def free_prefix(columns: list[str]) -> str:
    """Underscores that none of the columns starts with."""
    prefix = "_"
    while any(c.startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


#: A key of more rows may be hot; of these, the MOST_HOT largest are. Any other key then holds less
#: than a MOST_HOT-th of all rows.
HOT_ROWS, MOST_HOT = 1000, 1000


def hot_keys(left: DataFrame, keys: list[str]) -> list[tuple]:
    """The hot keys, by sums made in each task first; at most MOST_HOT come to the driver."""
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > HOT_ROWS)
    return [tuple(r)[:-1] for r in counts.orderBy(F.desc("_n"), *keys).limit(MOST_HOT).collect()]


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", salts: int = 16, hot: list[tuple] | None = None) -> DataFrame:
    """left joined to right, of which each key has few rows: rows of a hot key are dealt to `salts`
    tasks by a hash of the row (the same when a task runs again), against copies of the few rows
    that right has for it. Keys that aren't hot are joined as they are."""
    hot = hot_keys(left, keys) if hot is None else hot
    if not hot:
        return left.join(right, keys, how)
    own = free_prefix([*left.columns, *right.columns])
    salt, flag = f"{own}salt", f"{own}hot"
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in left.select(*keys).schema.fields]
    marks = F.broadcast(left.sparkSession.createDataFrame([(*k, True) for k in hot], ", ".join([*fields, f"`{flag}` boolean"])))
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(salts))
    spread = left.join(marks, keys, "left").withColumn(salt, F.when(F.col(flag), part).otherwise(F.lit(0))).drop(flag)
    dealt = F.when(F.col(flag), F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>")).otherwise(F.array(F.lit(0).cast("long")))
    copies = right.join(marks, keys, "left").withColumn(salt, F.explode(dealt)).drop(flag)
    return spread.join(copies, [*keys, salt], how).drop(salt)


#: ASCII white space: the bytes 0x09 to 0x0D and 0x20.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: A-Z to a-z; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(1 << 16, np.uint64(0xD6E8FEB86659FD93), np.uint64), dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of text whose words are found at once (a longer word comes alone).
WORD_WINDOW = 1 << 18


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of other than ASCII white space) of consecutive texts: start, length, hash."""
    found, a, n = [], 0, len(data)
    while a < n:
        b = min(n, a + WORD_WINDOW)
        while b < n:  # a window ends behind a space or where a text begins
            spaces = np.flatnonzero(SPACES[data[a:b]])
            head = int(offsets[np.searchsorted(offsets, b, side="right") - 1])
            cut = max(a + int(spaces[-1]) + 1 if len(spaces) else 0, head)
            if cut > a:
                b = cut
                break
            b = min(n, 2 * b - a)
        heads = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)]
        found.append(_words(data[a:b], heads - a, a))
        a = b
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _words(data: np.ndarray, heads: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    solid = ~SPACES[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    first[heads] = solid[heads]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    lengths = np.add.reduceat(solid, starts, dtype=np.int64)
    begin = np.repeat(starts, np.diff(starts, append=len(data)))  # from the first word's start on
    data, solid = data[starts[0] :], solid[starts[0] :]
    within = np.arange(starts[0], starts[0] + len(data)) - begin
    weight = _POWERS[within & 0xFFFF]
    if int(lengths.max()) > 0xFFFF:
        weight = weight * ((within >> 16).astype(np.uint64) * np.uint64(2) * _ODD + np.uint64(1))
    terms = (data.astype(np.uint64) + np.uint64(1)) * weight
    terms[~solid] = 0
    hashes = np.add.reduceat(terms, starts - starts[0]) + lengths.astype(np.uint64) * _ODD
    return starts + base, lengths, mixed(hashes)
