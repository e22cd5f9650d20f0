"""Bulk embedding, white space and tiles of the search against plain ways."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import dense


def plain(text: str | None) -> list[int]:
    return np.bincount([dense.bucket(t) for t in (text or "").lower().split()], minlength=dense.DIM).tolist()


def test_buckets_of_many_tokens():
    rng = np.random.default_rng(3)
    tokens = ["".join(rng.choice(list("abé x1 "), n)) for n in rng.integers(0, 70, 9000)]
    for some in (tokens, tokens[:1], [""], []):
        array = pa.array(some, pa.string())
        assert dense.buckets(array).tolist() == [dense.bucket(t) for t in some]
    assert dense.buckets(pa.array(tokens).slice(17, 5000)).tolist() == [dense.bucket(t) for t in tokens[17:5017]]


def test_bucket_counts_of_every_character():
    chars = [chr(i) for i in range(0x3100) if not 0xD800 <= i < 0xE000]
    texts = [f"A{c}B{c} {c}" for c in chars] + [None, "", "  ", "ΟΔΟΣ ΟΔΟΣΑ", "İ I", "x" * 300 + " y"]
    assert dense.bucket_counts(pa.array(texts)).tolist() == [plain(t) for t in texts]
    assert dense.bucket_counts(pa.array(texts).slice(5, 40)).tolist() == [plain(t) for t in texts[5:45]]


def test_strip_is_unicode(spark):
    rows = [(f"{chr(i)}a{chr(i)}b{chr(i)}\n",) for i in range(1, 0x3100)] + [("",), (None,), (" \n\n",)]
    found = spark.createDataFrame(rows, "s string").select("s", T.strip(F.col("s")).alias("got"), F.regexp_replace("s", r"(?U)^\s+|\s+$", "").alias("want"))
    assert found.filter(~F.col("got").eqNullSafe(F.col("want"))).count() == 0


def test_tiles_are_dealt_evenly(spark, monkeypatch):
    """Partitions of the tiles are of a fixed number, which isn't made smaller for little data."""
    rng = np.random.default_rng(5)
    m = rng.integers(0, 9, (400, 4)).astype(float)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "doc_id long, vec array<double>")
    whole = sorted(map(tuple, dense.search(rows, rows.withColumnRenamed("doc_id", "qid"), 3, skip_same=True).collect()))
    monkeypatch.setattr(dense, "QUERY_BYTES", 4 * 8 * 100)
    tiled = dense.search(rows, rows.withColumnRenamed("doc_id", "qid"), 3, skip_same=True)
    assert sorted(map(tuple, tiled.collect())) == whole
    plan = tiled._jdf.queryExecution().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 2
