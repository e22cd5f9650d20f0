"""Whole rankings, draws and tables in resample and its queries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import draws, resample, stats
from plumbline.plans import queries_stats, queries_trust


def plain(keys, a, g):
    """Discordant pairs, and pairs, of unlike keys."""
    i, j = np.triu_indices(len(a), 1)
    unlike = keys[i] != keys[j]
    return int((((a[i] - a[j]) * (g[i] - g[j]) < 0) & unlike).sum()), int(unlike.sum())


def test_discordant_pairs():
    r = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 17, 200):
        a, g = r.integers(0, 9, n) / 10, r.integers(0, 1 + n // 2, n) / 10
        assert resample.discordant(a, g) == plain(np.arange(n), a, g)[0]
        ranks = r.permutation(n)
        assert resample.inversions(ranks) == sum(int((ranks[:i] > x).sum()) for i, x in enumerate(ranks))


@pytest.mark.parametrize("block", [250_000, 30])
def test_disagreement_of_all_rows(spark, monkeypatch, block):
    monkeypatch.setattr(resample, "BLOCK_ROWS", block)
    r = np.random.default_rng(1)
    keys = np.append(np.arange(110), [3, 4, 4])
    m = np.round(r.random((len(keys), 3)), 1)
    names = ("x", "y", "z")
    rows = spark.createDataFrame([(int(k), *map(float, v)) for k, v in zip(keys, m)], "qid long, x double, y double, z double")
    weights = resample.dirichlet_weights(spark, names, 25)
    w = weights.orderBy("sample").toPandas()[list(names)].to_numpy()
    want = np.zeros(2, int)
    for row in w:
        a = row[0] * m[:, 0] + row[1] * m[:, 1] + row[2] * m[:, 2]
        some = m.min(axis=1) > 0
        safe = np.log(np.where(some[:, None], m, 1))
        g = np.where(some, np.exp(row[0] * safe[:, 0] + row[1] * safe[:, 1] + row[2] * safe[:, 2]), 0)
        want += plain(keys, a, g)
    got = resample.weight_disagreement(rows, weights, names).first()
    assert got.pairs == want[1] and round(got.rate * got.pairs) == want[0]
    again = resample.disagreement(resample.weight_sensitivity(rows, weights, names)).first()
    assert (again.rate, again.pairs) == (got.rate, got.pairs)
    assert tuple(resample.disagreement(resample.weight_sensitivity(rows.limit(0), weights, names)).first()) == (None, 0)
    assert tuple(resample.weight_disagreement(rows.limit(0), weights, names).first()) == (None, 0)


def test_moments_of_all_weightings(spark, monkeypatch):
    monkeypatch.setattr(resample, "CELLS", 100)
    r = np.random.default_rng(7)
    m = np.round(r.random((90, 3)), 1)
    names = ("x", "y", "z")
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(m)] + [(99, None, 0.5, 0.5)], "qid long, x double, y double, z double").repartition(4)
    weights = resample.dirichlet_weights(spark, names, 30)
    found = resample.weight_moments(rows, weights, names)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[1]
    s = resample.weight_sensitivity(rows.dropna(), weights, names)
    masked = ((F.col("t_arith") >= 0.5) & (F.col("t_geom") == 0)).cast("double")
    want = {x["sample"]: x for x in s.groupBy("sample").agg(F.avg("t_arith").alias("a"), F.stddev_samp("t_arith").alias("s"), F.min("t_arith").alias("l"), F.max("t_arith").alias("m"), F.avg("t_geom").alias("g"), F.avg(masked).alias("k")).collect()}
    got = {x["sample"]: x for x in found.collect()}
    assert set(got) == set(want) == set(range(30))
    for i, x in got.items():
        w = want[i]
        assert (x.n, x.mean_arith, x.std_arith, x.least_arith, x.most_arith, x.mean_geom, x.masked) == pytest.approx((90, w.a, w.s, w.l, w.m, w.g, w.k))
    assert resample.weight_moments(rows.limit(0), weights, names).count() == 0


def test_query_compares_all_documents_under_all_draws(spark):
    data = "/root/testdata/sf0.001"
    n = queries_trust.rated(spark, data).count()
    assert queries_trust.ranking_disagreement(spark, data).first().pairs == 10_000 * n * (n - 1) // 2
    assert queries_trust.weight_sensitivity(spark, data).count() == 10_000


def noise(spark, n=3000):
    return spark.range(n).select((F.pmod(F.xxhash64("id"), F.lit(17)) / 10.0).alias("score"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2))).cast("int").alias("label"))


def plain_auc(s, y, times=None):
    return resample.auc(np.asarray(s), np.asarray(y), times)


@pytest.mark.parametrize(("leaf", "digest"), [(100_000, 20_000), (100_000, 0), (200, 0)])
def test_the_law_is_that_of_drawing_rows(spark, monkeypatch, leaf, digest):
    """By digest, by one multinomial, and split over leaves."""
    monkeypatch.setattr(draws, "LEAF", leaf)
    monkeypatch.setattr(draws, "DIGEST_ROWS", digest)
    rows = noise(spark)
    got = resample.bootstrap_auc(rows, n=400).first()
    s, y = (np.array(x) for x in zip(*rows.collect()))
    assert got.point == pytest.approx(plain_auc(s, y)) and got.ci_lo < got.point < got.ci_hi
    r = np.random.default_rng(5)
    pos, neg = s[y == 1], s[y != 1]
    plain = [plain_auc(np.concatenate([r.choice(pos, len(pos)), r.choice(neg, len(neg))]), np.repeat([1, 0], [len(pos), len(neg)])) for _ in range(400)]
    assert got.ci_hi - got.ci_lo == pytest.approx(np.quantile(plain, 0.975) - np.quantile(plain, 0.025), rel=0.25)
    mean = resample.bootstrap_mean(rows, "score", 400).first()
    assert mean.point == pytest.approx(s.mean()) and mean.ci_hi - mean.ci_lo == pytest.approx(2 * 1.96 * s.std() / len(s) ** 0.5, rel=0.25)
    both = rows.withColumn("other", 1.7 - F.col("score"))
    tested = resample.permutation_test(both, "score", "other", "label", 200).first()
    assert tested.difference == pytest.approx(plain_auc(s, y) - plain_auc(1.7 - s, y))
    assert 0 < resample.label_permutation_test(rows.withColumn("toxic", 1 - F.col("label")), "score", "label", "toxic", 200).first().p <= 1


def test_splits_add_up_and_have_the_variance_of_a_binomial():
    cuts = np.array([0, 10, 10, 400, 1000])
    for r in range(20):
        assert sum(draws.split(1, 0, r, cuts, leaf) for leaf in range(4)) == 1000
        assert draws.split(1, 0, r, cuts, 1) == 0
    x = np.array([draws.split(2, 1, r, cuts, 2) for r in range(2000)])
    assert x.mean() == pytest.approx(390, abs=2) and x.var() == pytest.approx(1000 * 0.39 * 0.61, rel=0.15)


def test_leaves_share_what_a_digest_draws(monkeypatch):
    counts = np.array([3, 0, 5, 1, 11])
    starts = np.cumsum(counts) - counts
    r = np.arange(-1, 30)
    whole = draws.times(7, 1, r, counts, starts, 20, None, 0)
    assert (whole.sum(axis=1) == 20).all() and (whole[0] == counts).all()
    parts = [draws.times(7, 1, r, counts[a:b], starts[a:b], 20, None, i) for i, (a, b) in enumerate([(0, 2), (2, 5)])]
    assert (np.concatenate(parts, axis=1) == whole).all()
    plain = np.array([[int(d) * 20 >> 32 for d in row] for row in draws.digest(7, r[1:], 2 * np.arange(20) + 1)])
    assert (whole[1:] == [[((x >= s) & (x < s + c)).sum() for s, c in zip(starts, counts)] for x in plain]).all()
    coins = draws.swaps(7, r, counts[counts > 0], starts[counts > 0])
    bits = np.array([[int(w) >> i & 1 for w in row for i in range(32)] for row in draws.digest(7, r[1:], np.arange(1))])
    assert (coins[1:] == [[x[s : s + c].sum() for s, c in zip(starts, counts) if c] for x in bits]).all() and not coins[0].any()


def test_permutations_in_leaves_are_those_of_one(spark, monkeypatch):
    rows = noise(spark, 700).withColumn("other", F.pmod(F.xxhash64("score", "label", F.rand(1)), F.lit(40)) / 20.0)
    whole = draws.differences(rows, (F.col("score"), F.col("label")), (F.col("other"), F.col("label")), 60, 3)
    want = {r.replicate: r.value for r in whole.collect()}
    monkeypatch.setattr(draws, "LEAF", 50)
    got = draws.differences(rows, (F.col("score"), F.col("label")), (F.col("other"), F.col("label")), 60, 3)
    assert {r.replicate: pytest.approx(r.value) for r in got.collect()} == want and len(want) == 61


def test_nulls_drop_out_everywhere(spark):
    rows = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.2, 0), (0.1, 0), (None, 1), (0.95, None), (float("nan"), 0)], "score double, label int")
    assert resample.bootstrap_auc(rows, n=50).first().point == stats.roc_auc(rows).first().auc == 1.0
    assert resample.bootstrap_mean(rows, "score", 50).first().point == pytest.approx((0.9 + 0.8 + 0.2 + 0.1 + 0.95) / 5)
    assert resample.bootstrap_ratio(rows, "score", "label", 50).first().point == pytest.approx(2.0 / 2)
    assert resample.permutation_test(rows.withColumn("o", 1 - F.col("score")), "score", "o", "label", 20).first().difference == 1.0


def test_nothing_is_nan(spark):
    none = spark.createDataFrame([], "score double, label int, other double, s int")
    nan = lambda r: all(x != x for x in r)
    for found in (
        resample.bootstrap_auc(none, n=5), resample.bootstrap_mean(none, "score", 5), resample.bootstrap_paired_difference(none, "score", "other", 5), resample.bootstrap_ratio(none, "score", "other", 5),
        resample.bootstrap_sum_of_means(none, none, "score", 5), resample.bootstrap_ratio_difference(none, "score", "score", "other", 5), resample.permutation_test(none, "score", "other", "label", 5),
    ):
        rows = found.collect()
        assert len(rows) <= 1 and all(nan(r) for r in rows)


def test_groups_are_as_each_alone(spark, monkeypatch):
    rows = noise(spark, 900).withColumn("g", F.when(F.rand(2) < 0.2, F.lit(None).cast("string")).otherwise(F.concat(F.lit("g"), F.pmod(F.xxhash64(F.rand(3)), F.lit(3)))))
    rows = rows.withColumn("other", F.round(F.rand(4), 1)).filter("g is not null")
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    got = {r.g: r for r in resample.validation(rows, ("g",), "score", "other", "label", 100).collect()}
    assert sorted(got) == ["g0", "g1", "g2"]
    for g, r in got.items():
        one = rows.filter(F.col("g") == g)
        alone = resample.bootstrap_auc(one, n=100).first()
        assert (r.auc, r.ci_lo, r.ci_hi) == tuple(alone)
        base = stats.roc_auc(one, score="other").first().auc
        assert r.baseline_auc == pytest.approx(max(base, 1 - base)) and r.difference == pytest.approx(r.auc - r.baseline_auc)
        assert (r.n_pos, r.n_neg) == (one.filter("label = 1").count(), one.filter("label = 0").count())


def test_queries_have_the_operators_draws(spark, monkeypatch):
    seen = []
    real = draws._each
    monkeypatch.setattr(draws, "_each", lambda units, by, n, *a: (seen.append(n), real(units, by, n, *a))[1])
    for q in (queries_stats.bootstrap_ci, queries_stats.bootstrap_means, queries_stats.paired_permutation, queries_stats.label_permutation):
        q(spark, "/root/testdata/sf0.001")
    assert seen == [10_000] * 6
