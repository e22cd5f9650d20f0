"""Exact top-k search by inner product, in tiles.

Queries and candidates are dealt evenly (by a hash of the row) to query groups and candidate shards,
as large as a task's memory allows (GROUP_ROWS, SHARD_ROWS, SIDE_BYTES), so that a candidate is
copied once for every GROUP_ROWS queries; each pair of a group and a shard is one tile, in one task:
a matrix product, a partial selection of each query's k best, and one packed list for the group.
Lists of a group are then merged as a tree, FAN at a time, so no task reads more than FAN packed
lists. Work is queries times candidates, which exact search needs; memory is that of one tile.

Cases: rows whose id or vector is null, whose vector is empty or holds a null or non-finite
component take no part; vectors of other lengths than a query's are no candidates of it; ties go
to the smaller id; a repeated id counts as often as it occurs, and is never a candidate of a
query of the same id; with a scale, scores that don't fit 64 bits raise OverflowError; fewer candidates than k give all; empty tables give an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import salted_join, stored

#: Rows of a tile on either side, bytes of vectors on either, and packed lists that one merge reads.
GROUP_ROWS, SHARD_ROWS, SIDE_BYTES, FAN = 16384, 65536, 64 << 20, 16
#: Scores of a tile that are held at once.
HELD = 4 << 20

PACKED = "qgroup long, shard long, qkeys binary, qids binary, ids binary, scores binary"


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return rows.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & finite).select(
        F.col(key).cast("long").alias("id"), F.col(vector).alias("vec")
    )


def by_length(part: pa.Table) -> dict[int, pa.Table]:
    lengths = pc.list_value_length(part.column("vec"))
    return {n: part.filter(pc.equal(lengths, n)) for n in pc.unique(lengths).to_pylist()}


def matrix(part: pa.Table, scale: float | None) -> np.ndarray:
    """One row for each vector; all have one length. With a scale, floor(scale * x)."""
    flat = part.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    made = flat.reshape(part.num_rows, -1)
    return np.floor(scale * made) if scale else made


def product(q: np.ndarray, c: np.ndarray, whole: bool) -> np.ndarray:
    """q times c transposed, exact for whole numbers."""
    if not whole:
        return q @ c.T
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if most < 2**24:
        return q.astype(np.float32) @ c.astype(np.float32).T
    if most < 2**53:
        return q @ c.T
    if most < 2**63:
        return q.astype(np.int64) @ c.astype(np.int64).T
    raise OverflowError("scores don't fit 64 bits")


def best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Where each row's k best by (score down, id up) stand, in that order."""
    order = np.lexsort((ids, -scores, rows))
    ordered = rows[order]
    rank = np.arange(len(order)) - np.searchsorted(ordered, ordered)
    return order[rank < k]


def tile(q: np.ndarray, qids: np.ndarray, c: np.ndarray, cids: np.ndarray, k: int, whole: bool):
    """(row of q, id, score) of each query's k best candidates of a tile."""
    rows, ids, scores = [], [], []
    step = max(1, HELD // max(1, len(cids)))
    for a in range(0, len(qids), step):
        s = product(q[a : a + step], c, whole)
        own = cids[None, :] == qids[a : a + step, None]
        if s.dtype.kind == "f":
            s[own] = -np.inf
        if s.dtype.kind == "f" and s.shape[1] > k:  # partial selection: what reaches the k-th score
            floor = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            r, j = np.nonzero((s >= floor[:, None]) & ~own)
        else:
            r, j = np.nonzero(~own)
        kept = best(r, cids[j], s[r, j].astype(np.int64 if whole else np.float64), k)
        rows.append(r[kept] + a)
        ids.append(cids[j[kept]])
        scores.append(s[r[kept], j[kept]].astype(np.int64 if whole else np.float64))
    return np.concatenate(rows), np.concatenate(ids), np.concatenate(scores)


def packed(qgroup: int, shard: int, qkeys, qids, ids, scores) -> pa.Table:
    blobs = [pa.array([x.tobytes()], pa.binary()) for x in (qkeys, qids, ids, scores)]
    return pa.table([pa.array([qgroup], pa.int64()), pa.array([shard], pa.int64()), *blobs], names=[x.split()[0] for x in PACKED.split(", ")])


def top_k(
    rows: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", scale: float | None = None
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k rows of the largest inner product.

    With a scale, vectors become floor(scale * x) and scores are whole numbers. k is at least 1.
    """
    if k < 1:
        raise ValueError("k is at least 1")
    whole = scale is not None
    number = np.int64 if whole else np.float64
    names = [x.split()[0] for x in PACKED.split(", ")]
    spark = rows.sparkSession
    c = usable(rows, key, vector)
    # equal queries are asked once, so that a query's key is a hash of its row
    q = usable(queries, key, vector).groupBy("id", "vec").agg(F.count(F.lit(1)).alias("copies"))
    q = stored(spark, q.withColumn("qkey", F.xxhash64("id", "vec")), "queries")
    n_q, size_q, most = q.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("vec")), F.lit(0)), F.coalesce(F.max("copies"), F.lit(0))).first()
    n_c, size_c = c.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("vec")), F.lit(0))).first()
    groups = max(1, math.ceil(n_q / GROUP_ROWS), math.ceil(8 * size_q / SIDE_BYTES))
    shards = max(1, math.ceil(n_c / SHARD_ROWS), math.ceil(8 * size_c / SIDE_BYTES))
    shards = max(shards, min(n_c // 4096, math.ceil(2 * spark.sparkContext.defaultParallelism / groups)))  # work for all cores
    asked = q.select("id", "vec", "qkey", F.pmod(F.col("qkey"), F.lit(groups)).alias("qgroup"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>")))
    c = c.withColumn("shard", F.pmod(F.xxhash64("id", "vec"), F.lit(shards)))
    c = c.withColumn("qgroup", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>")))

    def run(at: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        others = by_length(right)
        for n, own in by_length(left).items():
            if n in others:
                there = others[n].sort_by("id")
                qids, qkeys = own.column("id").to_numpy(), own.column("qkey").to_numpy()
                r, ids, scores = tile(matrix(own, scale), qids, matrix(there, scale), there.column("id").to_numpy(), k, whole)
                found.append((qkeys[r], qids[r], ids, scores))
        if not found:
            return pa.table({n: pa.array([], t) for n, t in zip(names, [pa.int64()] * 2 + [pa.binary()] * 4, strict=True)})
        whole_list = [np.concatenate(x) for x in zip(*found, strict=True)]
        order = np.argsort(whole_list[0], kind="stable")  # lists stand in order of their query's key
        return packed(at[0].as_py(), at[1].as_py(), *(x[order] for x in whole_list))

    def merge(at: tuple, lists: pa.Table) -> pa.Table:
        qkeys, qids, ids, scores = (
            np.concatenate([np.frombuffer(x, t) for x in lists.column(n).to_pylist()])
            for n, t in (("qkeys", np.int64), ("qids", np.int64), ("ids", np.int64), ("scores", number))
        )
        kept = best(qkeys, ids, scores, k)
        return packed(at[0].as_py(), at[1].as_py(), qkeys[kept], qids[kept], ids[kept], scores[kept])

    tiles = asked.groupBy("qgroup", "shard").cogroup(c.groupBy("qgroup", "shard")).applyInArrow(run, PACKED)
    while shards > 1:
        shards = math.ceil(shards / FAN)
        tiles = tiles.withColumn("shard", F.floor(F.col("shard") / FAN)).groupBy("qgroup", "shard").applyInArrow(merge, PACKED)

    def unpack(batches):
        for batch in batches:
            for qkeys, qids, ids, scores in zip(*(batch.column(n).to_pylist() for n in names[2:]), strict=True):
                qkeys, qids, ids = (np.frombuffer(x, np.int64) for x in (qkeys, qids, ids))
                rank = np.arange(len(qkeys)) - np.searchsorted(qkeys, qkeys) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qkeys), pa.array(qids), pa.array(rank.astype(np.int32)), pa.array(ids), pa.array(np.frombuffer(scores, number))],
                    names=["qkey", "query_id", "rank", "vec_id", "score"],
                )

    out = tiles.mapInArrow(unpack, f"qkey long, query_id long, rank int, vec_id long, score {'long' if whole else 'double'}")
    if most > 1:
        again = q.filter("copies > 1").select("qkey", F.col("id").alias("query_id"), "copies")
        out = salted_join(out, again, ["qkey", "query_id"])
        out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("copies", F.lit(1).cast("long")))))
    return out.select("query_id", "rank", "vec_id", "score")
