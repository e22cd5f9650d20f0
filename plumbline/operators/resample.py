"""Bootstrap intervals, permutation tests, weight draws: replicates are dealt to tasks (`draws`).

Rows without what a statistic needs drop out; a group without rows, or of one class, has NaN.
Replicate r of a seed always draws the same numbers, whichever task runs it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import draws, stats
from plumbline.operators.sparse import small
from plumbline.sources.shared import stored

#: Numbers that a step of a matrix product holds.
CELLS = 1 << 22
#: Rows of a block of a ranking; a task counts the discordant pairs of two blocks.
BLOCK_ROWS = 2_000_000


def auc(scores: np.ndarray, labels: np.ndarray, counts: np.ndarray | None = None) -> float:
    """Area under the ROC curve by average ranks, of rows that occur counts times; NaN with one class."""
    pos = labels == 1
    counts = np.ones(len(scores)) if counts is None else counts.astype(float)
    n_pos, n_neg = counts[pos].sum(), counts[~pos].sum()
    if not n_pos or not n_neg:
        return float("nan")
    values, place = np.unique(scores, return_inverse=True)
    each = np.bincount(place, counts, len(values))
    ranks = (np.cumsum(each) - (each - 1) / 2)[place]
    return float(((ranks * counts)[pos].sum() - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg))


NAN = float("nan")


def _missing(c: str) -> Column:
    return F.col(c).isNull() | F.isnan(c)


def interval(values: DataFrame, alpha: float = 0.05, by: tuple = ()) -> DataFrame:
    """by, point (replicate -1), ci_lo, ci_hi of the replicates that are defined; NaN without any."""
    ok = F.when((F.col("replicate") >= 0) & ~_missing("value"), F.col("value"))
    bounds = [F.coalesce(F.percentile(ok, F.lit(p)), F.lit(NAN)).alias(c) for c, p in (("ci_lo", alpha / 2), ("ci_hi", 1 - alpha / 2))]
    return values.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("replicate") < 0, F.col("value"))), F.lit(NAN)).alias("point"), *bounds)


def _p_value(values: DataFrame, n: int, by: tuple) -> DataFrame:
    """by, difference, p: (as extreme + 1) / (n + 1); an undefined replicate counts as extreme."""
    real = values.filter("replicate < 0").select(*by, F.col("value").alias("difference"))
    both = values.filter("replicate >= 0").join(small(real), list(by)) if by else values.filter("replicate >= 0").join(small(real))
    extreme = F.count_if(_missing("value") | (F.abs("value") >= F.abs("difference") - 1e-12))
    found = both.groupBy(*by).agg(F.max("difference").alias("difference"), extreme.alias("extreme"))
    p = F.when(_missing("difference"), F.lit(NAN)).otherwise((F.col("extreme") + 1) / (n + 1))
    return found.select(*by, F.coalesce("difference", F.lit(NAN)).alias("difference"), p.alias("p"))


def bootstrap_auc(rows: DataFrame, score: str = "score", label: str = "label", n: int = 10_000, seed: int = 0, alpha: float = 0.05, by: tuple = ()) -> DataFrame:
    """Interval of the AUC; each class is resampled apart, so no replicate lacks one."""
    return interval(draws.aucs(rows, score, label, n, seed, by), alpha, by)


def _of_sums(rows: DataFrame, amounts: dict[str, Column], value: Column, n: int, seed: int, alpha: float, by: tuple) -> DataFrame:
    return interval(draws.sums(rows, amounts, n, seed, by).select(*by, "replicate", value.alias("value")), alpha, by)


def bootstrap_mean(rows: DataFrame, value: str, n: int = 10_000, seed: int = 0, alpha: float = 0.05, by: tuple = ()) -> DataFrame:
    return _of_sums(rows, {"_v": F.col(value)}, F.col("_v") / F.col("rows"), n, seed, alpha, by)


def bootstrap_paired_difference(rows: DataFrame, a: str, b: str, n: int = 10_000, seed: int = 0, alpha: float = 0.05, by: tuple = ()) -> DataFrame:
    """Interval of mean(a) - mean(b), rows resampled together; those that lack one of them drop out."""
    return _of_sums(rows, {"_v": F.col(a).cast("double") - F.col(b).cast("double")}, F.col("_v") / F.col("rows"), n, seed, alpha, by)


def bootstrap_ratio(rows: DataFrame, a: str, b: str, n: int = 10_000, seed: int = 0, alpha: float = 0.05, by: tuple = ()) -> DataFrame:
    """Interval of sum(a) / sum(b); replicates with an empty denominator drop out."""
    return _of_sums(rows, {"_a": F.col(a), "_b": F.col(b)}, F.try_divide("_a", "_b"), n, seed, alpha, by)


def bootstrap_sum_of_means(one: DataFrame, other: DataFrame, value: str, n: int = 10_000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """Interval of the sum of the means of two sets of rows that share none, resampled apart."""
    both = one.select(F.col(value).alias("v"), F.lit(0).alias("s")).unionByName(other.select(F.col(value).alias("v"), F.lit(1).alias("s")))
    found = draws.sums(both, {"_v": F.col("v")}, n, seed, stratum=F.col("s"))
    means = found.groupBy("replicate").agg(F.when(F.count(F.lit(1)) == 2, F.sum(F.col("_v") / F.col("rows"))).alias("value"))
    return interval(means, alpha)


def bootstrap_ratio_difference(rows: DataFrame, part: str, a: str, b: str, n: int = 10_000, seed: int = 0, alpha: float = 0.05, by: tuple = ()) -> DataFrame:
    """Interval of sum(part * a) / sum(a) - sum(part * b) / sum(b), rows resampled together;
    replicates in which a or b sums to 0 drop out."""
    p, x, y = (F.col(c).cast("double") for c in (part, a, b))
    return _of_sums(rows, {"_px": p * x, "_x": x, "_py": p * y, "_y": y}, F.try_divide("_px", "_x") - F.try_divide("_py", "_y"), n, seed, alpha, by)


def permutation_test(rows: DataFrame, a: str, b: str, label: str, n: int = 10_000, seed: int = 0, by: tuple = ()) -> DataFrame:
    """difference, p: is the AUC of score a from that of score b? Each row's two scores are swapped
    by a coin in each replicate; p is (as extreme + 1) / (n + 1)."""
    return _p_value(draws.differences(rows, (F.col(a), F.col(label)), (F.col(b), F.col(label)), n, seed, by), n, by)


def label_permutation_test(rows: DataFrame, score: str, label_a: str, label_b: str, n: int = 10_000, seed: int = 0, by: tuple = ()) -> DataFrame:
    """As permutation_test, with one score and two labellings that are swapped."""
    return _p_value(draws.differences(rows, (F.col(score), F.col(label_a)), (F.col(score), F.col(label_b)), n, seed, by), n, by)


def validation(rows: DataFrame, by: tuple, score: str, baseline: str, label: str, n: int = 10_000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """by, n_pos, n_neg, auc, ci_lo, ci_hi, baseline_auc, difference, p: how well a score does in each group,
    and against a baseline there, which is turned round where it does worse than chance. All groups'
    replicates are drawn in one pass."""
    rows = stored(rows.select(*by, F.col(score).cast("double").alias("score"), F.col(baseline).cast("double").alias("baseline"), F.col(label).alias("label")), "scored")
    usable = rows.filter(~_missing("score") & ~_missing("baseline") & F.col("label").isNotNull())
    base = stats.roc_auc(usable, by, "baseline")
    signs = stored(base.select(*by, stats.best_sign(F.col("auc")).alias("sign"), F.when(F.col("auc") < 0.5, 1 - F.col("auc")).otherwise(F.col("auc")).alias("baseline_auc"), "n_pos", "n_neg"), "signs")
    turned = usable.join(small(signs.select(*by, "sign")), list(by)).withColumn("baseline", F.col("baseline") * F.col("sign"))
    sure = bootstrap_auc(usable, n=n, seed=seed, alpha=alpha, by=by).withColumnRenamed("point", "auc")
    tested = permutation_test(turned, "score", "baseline", "label", n, seed, by)
    return signs.drop("sign").join(sure, list(by)).join(tested, list(by)).select(*by, "n_pos", "n_neg", "auc", "ci_lo", "ci_hi", "baseline_auc", "difference", "p")


def dirichlet_weights(spark: SparkSession, names: tuple, n: int = 10_000, seed: int = 0) -> DataFrame:
    """sample, and a weight for each name: even draws from the simplex, as exponential numbers that are
    made to sum to 1. The numbers come from the MD5 of seed, sample and name."""
    salt = lambda c: F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string"), F.lit(c))
    first = lambda c: F.conv(F.substring(F.md5(salt(c).cast("binary")), 1, 8), 16, 10).cast("long")
    drawn = spark.range(n).select(F.col("id").alias("sample"), *((-F.ln((first(c) + 0.5) / 4294967296.0)).alias(c) for c in names))
    total = sum((F.col(c) for c in names), F.lit(0.0))
    return drawn.select("sample", *((F.col(c) / total).alias(c) for c in names))


def weight_sensitivity(rows: DataFrame, weights: DataFrame, names: tuple, key: str = "qid") -> DataFrame:
    """key, sample, t_arith, t_geom under each drawn weighting; a metric at or below 0 makes t_geom 0."""
    w = weights.select("sample", *[F.col(c).alias(f"w_{c}") for c in names])
    both = rows.select(key, *names).join(F.broadcast(w))
    arith = sum((F.col(f"w_{c}") * F.col(c) for c in names), F.lit(0.0))
    logs = sum((F.col(f"w_{c}") * F.ln(F.col(c)) for c in names), F.lit(0.0))
    geom = F.when(F.least(*names) <= 0, 0.0).otherwise(F.exp(logs))
    return both.select(key, "sample", arith.alias("t_arith"), geom.alias("t_geom"))


MOMENTS = "sample long, n long, sum_a double, squares_a double, least_a double, most_a double, sum_g double, masked long"


def weight_moments(rows: DataFrame, weights: DataFrame, names: tuple, floor: float = 0.5) -> DataFrame:
    """sample, n, mean_arith, std_arith, least_arith, most_arith, mean_geom, masked: over all rows, under each
    weighting; masked is how often t_arith reaches the floor where t_geom is 0.

    Each batch of rows is multiplied with the matrix of weightings (which is collected: as many rows as
    samples), and a task hands on one row of moments a weighting, whatever rows it read. Means are merged
    by their counts, spreads about one centre, so no digits cancel.
    """
    drawn = weights.orderBy("sample").select("sample", *names).toPandas()
    samples, w = drawn["sample"].to_numpy(), drawn[list(names)].to_numpy().T
    slim = rows.select(*(F.col(c).cast("double").alias(c) for c in names)).dropna()
    middle = slim.agg(*(F.avg(c) for c in names)).first()
    centre = np.array([x or 0.0 for x in middle]) @ w

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, masked = 0, np.zeros(len(samples), np.int64)
        sum_a, squares, sum_g = (np.zeros(len(samples)) for _ in range(3))
        least, most = np.full(len(samples), np.inf), np.full(len(samples), -np.inf)
        step = max(1, CELLS // max(len(samples), 1))
        for batch in batches:
            m = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1)
            for x in (m[a : a + step] for a in range(0, len(m), step)):
                arith = x @ w
                some = x.min(axis=1) > 0
                n += len(x)
                off = arith - centre
                sum_a, squares = sum_a + off.sum(axis=0), squares + (off * off).sum(axis=0)
                least, most = np.minimum(least, arith.min(axis=0)), np.maximum(most, arith.max(axis=0))
                sum_g += np.exp(np.log(x[some]) @ w).sum(axis=0)
                masked += (arith[~some] >= floor).sum(axis=0)
        if n:
            columns = [samples, np.full(len(samples), n), sum_a, squares, least, most, sum_g, masked]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in MOMENTS.split(", ")])

    parts = slim.mapInArrow(run, MOMENTS)
    sums = parts.groupBy("sample").agg(*(F.sum(c).alias(c) for c in ("n", "sum_a", "squares_a", "sum_g", "masked")), F.min("least_a").alias("least_arith"), F.max("most_a").alias("most_arith"))
    centres = rows.sparkSession.createDataFrame([(int(s), float(c)) for s, c in zip(samples, centre, strict=True)], "sample long, centre double")
    spread = F.greatest(F.col("squares_a") - F.col("sum_a") * F.col("sum_a") / F.col("n"), F.lit(0.0))
    return sums.join(small(centres), "sample").select(
        "sample", "n", (F.col("centre") + F.col("sum_a") / F.col("n")).alias("mean_arith"), F.sqrt(F.try_divide(spread, F.col("n") - 1)).alias("std_arith"), "least_arith", "most_arith",
        (F.col("sum_g") / F.col("n")).alias("mean_geom"), (F.col("masked") / F.col("n")).alias("masked"),
    )


#: Places of a run whose pairs are compared; runs that a step of counting inversions merges are 4.
RUN = 64
#: Places that are merged at once.
MERGED = 1 << 16


def inversions(ranks: np.ndarray) -> int:
    """Pairs of which the earlier one is larger: within runs of RUN places by comparing, then between
    runs, of which each step merges 4 by a sort of whole numbers, some groups of them at a time."""
    r = np.asarray(ranks, np.int64)
    if len(r) < 2:
        return 0
    last = int(r.max())
    whole = np.full(-(-len(r) // RUN) * RUN, last, np.int32 if 0 <= r.min() and last < 1 << 29 else np.int64)
    whole[: len(r)] = r  # what is added last is no smaller
    runs, n = np.ascontiguousarray(whole.reshape(-1, RUN).T), len(whole)
    total, width = sum(int(np.count_nonzero(runs[:-d] > runs[d:])) for d in range(1, RUN)), RUN
    while width < n:
        step = 4 * width
        full, some = n - n % step, max(1, MERGED // step) * step
        for a in range(0, full, some):
            total += _between(whole[a : min(a + some, full)].reshape(-1, step), width)
        if n - full > width:
            total += _between(whole[full:].reshape(1, -1), width)
        width = step
    return total


def _between(groups: np.ndarray, width: int) -> int:
    """Inversions between the runs, 4 at most, of each group (row)."""
    # by rank; equal ranks in the order of their runs, so that they are no inversion
    keys = groups << 2 | (np.arange(groups.shape[1]) // width).astype(groups.dtype)
    keys.sort(axis=1)
    c, total = (keys & 3).astype(np.int8), 0
    for v in range(3):  # places of run v, and those of later runs with a smaller rank
        later = np.cumsum(c > v, axis=1, dtype=np.int32)
        total += int((later * (c == v)).sum(dtype=np.int64))
    return total


def _order(x: np.ndarray) -> np.ndarray:
    """As argsort: a sort of whole numbers, of a value's upper bits and its place, and then of the few that are still out of order."""
    x = x + 0.0  # one zero
    bits = x.view(np.int64)
    bits = bits ^ ((bits >> 63) & np.iinfo(np.int64).max)  # in the order of the values
    low = (1 << len(x).bit_length()) - 1
    order = np.sort((bits & ~low) | np.arange(len(x))) & low
    y = x[order]
    return order if (y[1:] >= y[:-1]).all() else order[np.argsort(y, kind="stable")]


def _dense(x: np.ndarray) -> np.ndarray:
    """The place of each value among the distinct ones."""
    order = _order(np.asarray(x, float))
    y = x[order]
    out = np.empty(len(x), np.int64)
    out[order] = np.concatenate([[0], np.cumsum(y[1:] != y[:-1])]) if len(x) else 0
    return out


def discordant(a: np.ndarray, g: np.ndarray) -> int:
    """Pairs that a and g order differently; a pair that either ties isn't one."""
    # by a, and by g where a ties
    return inversions(np.sort(_dense(a) << 31 | _dense(g)) & ((1 << 31) - 1))


def _tile(repeated: list[np.ndarray], left: np.ndarray, a: np.ndarray, g: np.ndarray, own: bool) -> int:
    """Discordant pairs of rows of unlike keys: in one block (own), or between left and the others.
    repeated: the places of each key that the block has more than once."""
    if not own:
        return discordant(a, g) - discordant(a[left], g[left]) - discordant(a[~left], g[~left])
    found = discordant(a, g)
    for at in repeated:
        found -= discordant(a[at], g[at])
    return found


def _repeated(keys: np.ndarray) -> list[np.ndarray]:
    """The places of each key that occurs more than once."""
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.diff(keys[order], prepend=keys[order][:1] - 1)) if len(keys) else np.zeros(0, int)
    size = np.diff(first, append=len(keys))
    return [order[f : f + n] for f, n in zip(first[size > 1], size[size > 1], strict=True)]


def _pairs(keys: np.ndarray, left: np.ndarray, own: bool) -> int:
    if not own:
        return int(left.sum()) * int((~left).sum())
    return len(keys) * (len(keys) - 1) // 2 - sum(len(p) * (len(p) - 1) // 2 for p in _repeated(keys))


def _tiles(rows: DataFrame, blocks: Column) -> DataFrame:
    """rows (with key) once for each tile (row, col) of two blocks that they are in."""
    dealt = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
    each = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return each.withColumn("row", F.least("block", "other")).withColumn("col", F.greatest("block", "other")).drop("blocks", "other")


def _rate(counted: DataFrame) -> DataFrame:
    total = counted.agg(F.sum("discordant").alias("d"), F.coalesce(F.sum("pairs"), F.lit(0)).cast("long").alias("pairs"))
    return total.select(F.try_divide("d", "pairs").alias("rate"), "pairs")


def disagreement(sampled: DataFrame, key: str = "qid") -> DataFrame:
    """rate: how often two rows of a sample are ordered differently by the two aggregates; pairs.

    Pairs aren't made: a task counts the inversions between two blocks of at most about BLOCK_ROWS
    rows, exactly. Rows without key or aggregate are left out; rows of one key are no pair.
    """
    rows = sampled.select("sample", F.col(key).cast("long").alias("key"), "t_arith", "t_geom").dropna()
    sizes = rows.groupBy("sample").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("blocks"))
    tiled = _tiles(rows.join(small(sizes), "sample").withColumnRenamed("blocks", "n"), F.col("n"))

    def count(table: pa.Table) -> pa.Table:
        keys, a, g, block = (table.column(c).to_numpy() for c in ("key", "t_arith", "t_geom", "block"))
        row, col = table.column("row")[0].as_py(), table.column("col")[0].as_py()
        left, own = block == row, row == col
        return pa.table({"discordant": [_tile(_repeated(keys) if own else [], left, a, g, own)], "pairs": [_pairs(keys, left, own)]})

    return _rate(tiled.groupBy("sample", "row", "col").applyInArrow(count, "discordant long, pairs long"))


def weight_disagreement(rows: DataFrame, weights: DataFrame, names: tuple, key: str = "qid") -> DataFrame:
    """rate, pairs: disagreement(weight_sensitivity(...)) of all rows under all weightings.

    The rows are dealt once to tiles and groups of weightings, not once a weighting; a task ranks its
    tile under each weighting of its group. The weightings are collected.
    """
    spark = rows.sparkSession
    w = weights.orderBy("sample").select(*names).toPandas().to_numpy()
    slim = rows.select(F.col(key).cast("long").alias("key"), *[F.col(c).cast("double").alias(c) for c in names]).dropna()
    blocks = max(1, -(-slim.count() // BLOCK_ROWS))
    groups = max(1, min(len(w), -(-8 * spark.sparkContext.defaultParallelism // (blocks * (blocks + 1) // 2))))
    tiled = _tiles(slim, F.lit(blocks).cast("long")).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def count(table: pa.Table) -> pa.Table:
        keys, block = table.column("key").to_numpy(), table.column("block").to_numpy()
        row, col, grp = (table.column(c)[0].as_py() for c in ("row", "col", "grp"))
        left, own = block == row, row == col
        m = [table.column(c).to_numpy() for c in names]
        some = np.minimum.reduce(m) > 0
        logs = [np.log(np.where(some, x, 1.0)) for x in m]
        found, mine, repeated = 0, w[grp::groups], _repeated(keys) if own else []
        for weighting in mine:  # added in the order of names, so equal rows tie
            a = sum((x * c for c, x in zip(weighting, m, strict=True)), np.zeros(len(keys)))
            g = np.where(some, np.exp(sum((x * c for c, x in zip(weighting, logs, strict=True)), np.zeros(len(keys)))), 0.0)
            found += _tile(repeated, left, a, g, own)
        return pa.table({"discordant": [found], "pairs": [_pairs(keys, left, own) * len(mine)]})

    return _rate(tiled.groupBy("grp", "row", "col").applyInArrow(count, "discordant long, pairs long"))
