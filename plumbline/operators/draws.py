"""Replicates of resampled rows, drawn in ranges that merge.

What is resampled is tallied first: each distinct row of a group and how often it occurs, in order, with
the rows that come before it. A group is cut into leaves, ranges of that order, and a task draws some
replicates of one leaf; sums over leaves make a replicate whole. So nothing but a few numbers a
leaf (of groups that have several) comes to the driver, and no task holds a group.

Rows of a stratum of up to DIGEST_ROWS rows draw by digest: draw j of replicate r is the row at
digest(r, j) * rows / 2 ** 32 of the order, whichever task asks. Of larger strata, the draws of a
replicate are split over the leaves by conditional binomials down a binary tree, each seeded by
(seed, stratum, replicate, node), and within a leaf by a multinomial; jointly that is the
multinomial over all rows. Coins of a permutation are bits of digests by the place of a row.

Replicate -1 stands for the rows as they are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.order import running
from plumbline.operators.sparse import small
from plumbline.operators.stats import tallies

#: Rows of a leaf, about, and leaves at most; rows of a stratum that draw by digest.
LEAF, MOST_LEAVES, DIGEST_ROWS = 100_000, 65_536, 20_000
#: Counts that a step holds, and replicates that are worth a task.
CELLS, LEAST_REPLICATES = 1 << 22, 250
#: Fixed values of the digest: its multiplier, and what keeps replicates and draws apart.
MULTIPLIER, REPLICATES, DRAWS = 73_244_475, 2_654_435_769, 2_246_822_519
_LOW = np.uint64(0xFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers (held in 64 bits) that spreads all bits."""
    for _ in range(2):
        x = ((x ^ (x >> np.uint64(16))) * np.uint64(MULTIPLIER)) & _LOW
    return x ^ (x >> np.uint64(16))


def digest(seed: int, replicates: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Replicate x draw: 32 bits each, the same wherever they are asked for."""
    a = mix((replicates.astype(np.uint64) + np.uint64(seed * REPLICATES % (1 << 32))) & _LOW)
    b = mix((draws.astype(np.uint64) + np.uint64(DRAWS)) & _LOW)
    return mix(a[:, None] ^ b[None, :])


def split(seed: int, stratum: int, replicate: int, cuts: np.ndarray, leaf: int) -> int:
    """How many of a replicate's draws fall in a leaf; cuts are the rows before each leaf, and all rows."""
    low, high, draws = 0, len(cuts) - 1, int(cuts[-1])
    while high - low > 1:
        middle = (low + high) // 2
        share = (cuts[middle] - cuts[low]) / max(cuts[high] - cuts[low], 1)
        left = int(np.random.default_rng([seed, stratum, replicate, low, high]).binomial(draws, share))
        low, high, draws = (low, middle, left) if leaf < middle else (middle, high, draws - left)
    return draws


def times(seed: int, stratum: int, replicates: np.ndarray, counts: np.ndarray, starts: np.ndarray, rows: int, cuts: np.ndarray | None, leaf: int) -> np.ndarray:
    """Replicate x distinct row of a leaf: how often it is drawn. rows: of the whole stratum."""
    out = np.zeros((len(replicates), len(counts)), np.int64)
    real = replicates < 0
    out[real] = counts
    some = np.flatnonzero(counts)
    if not len(some) or real.all():
        return out
    if rows <= DIGEST_ROWS:
        at = (digest(seed, replicates[~real], 2 * np.arange(rows) + stratum) * np.uint64(rows)) >> np.uint64(32)
        first, last = int(starts[some[0]]), int(starts[some[-1]] + counts[some[-1]])
        place = some[np.clip(np.searchsorted(starts[some], at, side="right") - 1, 0, None)]
        place += np.arange(len(at))[:, None] * len(counts)
        inside = (at >= first) & (at < last)
        out[~real] = np.bincount(place[inside], minlength=len(at) * len(counts)).reshape(len(at), -1)
        return out
    share = counts / counts.sum()
    for i in np.flatnonzero(~real).tolist():
        r = int(replicates[i])
        draws = rows if cuts is None else split(seed, stratum, r, cuts, leaf)
        out[i] = np.random.default_rng([seed, stratum, r, leaf]).multinomial(draws, share)
    return out


def swaps(seed: int, replicates: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Replicate x distinct row: for how many of its copies a coin says to swap."""
    first, last = starts >> 5, (starts + counts - 1) >> 5
    many = last - first + 1
    heads = np.cumsum(many) - many
    owner = np.repeat(np.arange(len(counts)), many)
    word = np.arange(int(many.sum())) - heads[owner] + first[owner]
    begin, end = np.maximum(starts[owner] - 32 * word, 0), np.minimum(starts[owner] + counts[owner] - 32 * word, 32)
    masks = ((np.uint64(1) << end.astype(np.uint64)) - np.uint64(1)) ^ ((np.uint64(1) << begin.astype(np.uint64)) - np.uint64(1))
    bits = np.bitwise_count(digest(seed, replicates, word) & masks).astype(np.int64)
    out = np.add.reduceat(bits, heads, axis=1)
    out[replicates < 0] = 0
    return out


def _steps(replicates: np.ndarray, cells: int):
    size = max(1, CELLS // max(cells, 1))
    for a in range(0, len(replicates), size):
        yield replicates[a : a + size]


def _each(units: DataFrame, by: tuple, n: int, solve: Callable[[pa.Table, np.ndarray], list[np.ndarray]], names: list[str], kind: str) -> DataFrame:
    """by, _r, _leaf and names: solve's numbers for the replicates (-1 to n - 1) of each leaf (by, _leaf)."""
    spark = units.sparkSession
    n_units = units.select(*by, "_leaf").distinct().count()
    chunks = max(1, min(-(-2 * spark.sparkContext.defaultParallelism // max(n_units, 1)), -(-n // LEAST_REPLICATES)))
    keys = [f for f in units.schema.fields if f.name in by]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keys] + ["_leaf long", "_r long", *(f"{c} {kind}" for c in names)])

    def run(table: pa.Table) -> pa.Table:
        c = table.column("_chunk")[0].as_py()
        mine = np.arange(-1, n)[c::chunks]
        found = solve(table, mine)
        columns = {k.name: pa.repeat(table.column(k.name)[0], len(mine)) for k in keys}
        columns |= {"_leaf": pa.repeat(table.column("_leaf")[0], len(mine)), "_r": pa.array(mine)}
        return pa.table(columns | {c: pa.array(x) for c, x in zip(names, found, strict=True)})

    dealt = units.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    return dealt.groupBy(*by, "_leaf", "_chunk").applyInArrow(run, schema)


def _leaf_rows(total: int) -> int:
    return max(LEAF, -(-total // MOST_LEAVES))


def _cuts(units: DataFrame, by: tuple, counts: list[str]) -> dict[tuple, list[np.ndarray]]:
    """Of the groups with several leaves, for each count: the rows before each leaf, and all rows."""
    leaves = units.groupBy(*by, "_leaf").agg(*(F.sum(c).alias(c) for c in counts))
    several = leaves.withColumn("_leaves", F.count(F.lit(1)).over(Window.partitionBy(*by))).filter("_leaves > 1")
    found: dict[tuple, dict[int, list[int]]] = {}
    for r in several.collect():  # about MOST_LEAVES rows at most, of all groups together
        found.setdefault(tuple(r[c] for c in by), {})[r["_leaf"]] = [r[c] for c in counts]
    out = {}
    for key, parts in found.items():
        sums = np.zeros((max(parts) + 1, len(counts)), np.int64)
        for leaf, values in parts.items():
            sums[leaf] = values
        out[key] = [np.concatenate([[0], np.cumsum(x)]) for x in sums.T]
    return out


def _wins(pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
    """By replicate: pairs in which a positive stands above a negative, ties half; values in order."""
    below = np.cumsum(neg, axis=1) - neg
    return (pos * (2 * below + neg)).sum(axis=1)


def _above(found: DataFrame, by: tuple, sides: tuple) -> DataFrame:
    """by, _r, and an AUC for each side, whose positives (p), negatives (n) and doubled wins (w) stand in
    leaves; NaN where a class is missing."""
    before = Window.partitionBy(*by, "_r").orderBy("_leaf").rowsBetween(Window.unboundedPreceding, -1)
    whole = found.select(*by, "_r", *(F.col(f"{x}{s}") for s in sides for x in "pn"), *((F.col(f"w{s}") + 2 * F.col(f"p{s}") * F.coalesce(F.sum(f"n{s}").over(before), F.lit(0))).alias(f"w{s}") for s in sides))
    sums = whole.groupBy(*by, "_r").agg(*(F.sum(f"{x}{s}").alias(f"{x}{s}") for s in sides for x in "pnw"))
    auc = lambda s: F.when((F.col(f"p{s}") > 0) & (F.col(f"n{s}") > 0), F.col(f"w{s}") / (2.0 * F.col(f"p{s}") * F.col(f"n{s}"))).otherwise(F.lit(float("nan")))
    return sums.select(*by, F.col("_r").alias("replicate"), *(auc(s).alias(f"auc{s}") for s in sides))


def aucs(rows: DataFrame, score: str, label: str, n: int, seed: int, by: tuple = ()) -> DataFrame:
    """by, replicate, value: the AUC with each class resampled apart."""
    t = running(tallies(rows, by, score, label), [F.col("score")], {"_sp": F.col("pos"), "_sn": F.col("neg")}, by)
    size = _leaf_rows(t.agg(F.coalesce(F.sum(F.col("pos") + F.col("neg")), F.lit(0))).first()[0])
    t = t.withColumn("_leaf", F.floor((F.col("_sp") + F.col("_sn")) / size))
    totals = t.groupBy(*by).agg(F.sum("pos").alias("_np"), F.sum("neg").alias("_nn"))
    t = t.join(small(totals), list(by)) if by else t.join(small(totals))
    cuts = _cuts(t, by, ["pos", "neg"])

    def solve(table: pa.Table, replicates: np.ndarray) -> list[np.ndarray]:
        table = table.sort_by("score")
        key, leaf = tuple(table.column(c)[0].as_py() for c in by), table.column("_leaf")[0].as_py()
        sides = [(table.column(c).to_numpy(), table.column(at).to_numpy(), table.column(all_)[0].as_py()) for c, at, all_ in (("pos", "_sp", "_np"), ("neg", "_sn", "_nn"))]
        out = []
        for some in _steps(replicates, max(table.num_rows, *(min(x[2], DIGEST_ROWS) for x in sides))):
            p, q = (times(seed, s, some, counts, starts, total, cuts[key][s] if key in cuts else None, leaf) for s, (counts, starts, total) in enumerate(sides))
            out.append((p.sum(axis=1), q.sum(axis=1), _wins(p, q)))
        return [np.concatenate(x) for x in zip(*out, strict=True)]

    return _above(_each(t, by, n, solve, ["p", "n", "w"], "long"), by, ("",)).withColumnRenamed("auc", "value")


def sums(rows: DataFrame, amounts: dict[str, Column], n: int, seed: int, by: tuple = (), stratum: Column | None = None) -> DataFrame:
    """by, stratum, replicate, rows, and the sum of each amount over as many draws as the stratum has rows.
    Rows that lack an amount drop out."""
    names = list(amounts)
    some = rows.select(*by, (F.lit(0) if stratum is None else stratum.cast("int")).alias("_s"), *(c.cast("double").alias(x) for x, c in amounts.items()))
    t = some.dropna(subset=names).filter(~F.greatest(*(F.isnan(x) for x in names), F.lit(False))).groupBy(*by, "_s", *names).agg(F.count(F.lit(1)).alias("_n"))
    own = (*by, "_s")
    t = running(t, [F.col(x) for x in names], {"_at": F.col("_n")}, own)
    size = _leaf_rows(t.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0])
    t = t.withColumn("_leaf", F.floor(F.col("_at") / size))
    t = t.join(small(t.groupBy(*own).agg(F.sum("_n").alias("_rows"))), list(own))
    cuts = _cuts(t, own, ["_n"])

    def solve(table: pa.Table, replicates: np.ndarray) -> list[np.ndarray]:
        table = table.sort_by([(x, "ascending") for x in names])
        key, leaf = tuple(table.column(c)[0].as_py() for c in own), table.column("_leaf")[0].as_py()
        counts, starts, total = table.column("_n").to_numpy(), table.column("_at").to_numpy(), table.column("_rows")[0].as_py()
        values = np.stack([table.column(x).to_numpy() for x in names], axis=1)
        out = [times(seed, key[-1], some, counts, starts, total, cuts[key][0] if key in cuts else None, leaf) @ values for some in _steps(replicates, max(len(counts), min(total, DIGEST_ROWS)))]
        return list(np.concatenate(out).T)

    found = _each(t, own, n, solve, names, "double").groupBy(*own, "_r").agg(*(F.sum(x).alias(x) for x in names))
    sizes = small(t.groupBy(*own).agg(F.first("_rows").alias("rows")))
    return found.join(sizes, list(own)).withColumnRenamed("_s", "stratum").withColumnRenamed("_r", "replicate")


def differences(rows: DataFrame, first: tuple[Column, Column], second: tuple[Column, Column], n: int, seed: int, by: tuple = ()) -> DataFrame:
    """by, replicate, value: AUC of (score, label) `first` less that of `second`, each row's two swapped by
    a coin. Rows that lack any of them drop out."""
    names = ["_x", "_lx", "_y", "_ly"]
    some = rows.select(*by, *(c.cast("double").alias(x) for x, c in zip(names, (*first, *second), strict=True)))
    t = some.dropna(subset=names).filter(~F.greatest(*(F.isnan(x) for x in names))).groupBy(*by, *names).agg(F.count(F.lit(1)).alias("_n"))
    t = running(t, [F.col(x) for x in names], {"_at": F.col("_n")}, by)
    # a row stands at both its scores: on side a with the first of them, unless the coin swaps it to side b
    event = lambda v, label, is_first: F.struct(F.col(v).alias("_v"), (F.col(label) == 1).alias("_pos"), F.lit(is_first).alias("_first"))
    t = t.select(*by, "_at", "_n", F.explode(F.array(event("_x", "_lx", True), event("_y", "_ly", False))).alias("e")).select(*by, "_at", "_n", "e.*")
    total = t.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    leaves = -(-total // _leaf_rows(total)) if total else 1
    cut = sorted(set(t.agg(F.percentile_approx("_v", F.lit([i / leaves for i in range(1, leaves)]), F.lit(10 * leaves))).first()[0])) if leaves > 1 else []
    leaf = F.size(F.filter(F.lit(cut), lambda c: c <= F.col("_v"))) if cut else F.lit(0)  # equal scores stay together
    t = t.withColumn("_leaf", leaf.cast("long"))

    def solve(table: pa.Table, replicates: np.ndarray) -> list[np.ndarray]:
        table = table.sort_by("_v")
        v, counts, starts = (table.column(c).to_numpy() for c in ("_v", "_n", "_at"))
        pos, is_first = (table.column(c).to_numpy(zero_copy_only=False) for c in ("_pos", "_first"))
        heads = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        out = []
        for some in _steps(replicates, len(v) + int(counts.sum()) // 32):
            swap = swaps(seed, some, counts, starts)
            a = np.where(is_first, counts - swap, swap)
            row = []
            for side in (a, counts - a):
                p, q = (np.add.reduceat(np.where(kind, side, 0), heads, axis=1) for kind in (pos, ~pos))
                row += [p.sum(axis=1), q.sum(axis=1), _wins(p, q)]
            out.append(row)
        return [np.concatenate(x) for x in zip(*out, strict=True)]

    found = _above(_each(t, by, n, solve, ["pa", "na", "wa", "pb", "nb", "wb"], "long"), by, ("a", "b"))
    return found.select(*by, "replicate", (F.col("auca") - F.col("aucb")).alias("value"))
