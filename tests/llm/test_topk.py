import math
import random

import pytest

from plumbline.llm import topk


def brute(rows, k):
    ok = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in ok:
        if i % 20 == 0:
            q = [math.floor(64 * x) for x in v]
            scored = sorted((-sum(a * b for a, b in zip(q, [math.floor(64 * x) for x in w])), j) for j, w in ok if j != i and len(w) == len(v))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, k):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df = df.selectExpr("*", "1 as score", "'x' as id", "2 as shard")
    return sorted(map(tuple, topk.top_k(df, df.filter("vec_id % 20 = 0"), k, scale=64.0).collect()))


@pytest.mark.parametrize("sizes", [(1024, 16384), (3, 7)])
def test_equals_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(topk, "GROUP_ROWS", sizes[0])
    monkeypatch.setattr(topk, "SHARD_ROWS", sizes[1])
    monkeypatch.setattr(topk, "FAN", 2)
    r = random.Random(1)
    rows = [(i, [r.choice([0.25, -0.5, 0.015625, 0.7]) for _ in range(4)]) for i in range(120)]
    rows += [(200, [0.5, None, 0.1, 0.2]), (220, None), (240, []), (260, [float("nan")] * 4), (280, [float("inf")] * 4), (None, [0.1] * 4), (300, [0.5, 0.25]), (301, [0.5, 0.25])]
    assert run(spark, rows, 5) == brute(rows, 5)


def test_few_rows_large_values_and_empty(spark):
    rows = [(0, [1e6, 2e6]), (1, [3e6, -1e6]), (2, [3e6, -1e6])]
    assert run(spark, rows, 20) == brute(rows, 20)
    assert run(spark, [], 20) == []
    assert run(spark, [(20, [0.5])], 3) == []


def test_repeated_queries_and_rows(spark, monkeypatch):
    """Rows of one id count as often as they occur, as queries and as candidates."""
    monkeypatch.setattr(topk, "GROUP_ROWS", 3)
    monkeypatch.setattr(topk, "SHARD_ROWS", 4)
    r = random.Random(5)
    rows = [(i % 50, [r.choice([0.25, -0.5]), r.choice([1.5, 0.125])]) for i in range(60)]
    rows += [(20, [0.25, 1.5])] * 3 + [(3, [0.5, 0.5])] * 4
    assert run(spark, rows, 7) == brute(rows, 7)


def test_candidates_are_copied_once_a_query_group(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(100)], "vec_id long, embedding array<float>")
    plan = topk.top_k(df, df, 3, scale=1.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(0, 0" in plan or "[0]" in plan  # one group for a hundred queries


def test_scores_beyond_64_bits(spark):
    rows = [(0, [1e30]), (1, [1e30])]
    with pytest.raises(Exception, match="64 bits"):
        run(spark, rows, 1)
