"""Reciprocal-rank fusion, reranking, collapsing to documents, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.sparse import top


def depth(k: int) -> int:
    """How deep each leg is searched for k fused results."""
    return max(4 * k, 20)


def rrf(dense: DataFrame, sparse: DataFrame, k: int, rrf_k: int = 60, qid: str = "qid", key: str = "doc_id") -> DataFrame:
    """qid, key, score, rank: sum of 1 / (rrf_k + rank); ties: the dense leg's order, then the
    sparse leg's. One union and one grouped sum in place of an outer join."""
    legs = dense.select(qid, key, F.col("rank").alias("d"), F.lit(None).cast("int").alias("s")).unionByName(
        sparse.select(qid, key, F.lit(None).cast("int").alias("d"), F.col("rank").alias("s"))
    )
    part = F.coalesce(1 / (rrf_k + F.col("d")), F.lit(0.0)) + F.coalesce(1 / (rrf_k + F.col("s")), F.lit(0.0))
    fused = legs.groupBy(qid, key).agg(F.round(F.sum(part), 12).alias("score"), F.min("d").alias("d"), F.min("s").alias("s"))
    return top(fused, k, qid, F.desc("score"), F.asc_nulls_last("d"), F.asc_nulls_last("s")).select(qid, key, "score", "rank")


def rerank(hits: DataFrame, score: Column, k: int, qid: str = "qid") -> DataFrame:
    """hits with a pair score, the k best of each query; ties keep the base order."""
    return top(hits.withColumnRenamed("rank", "base_rank").withColumn("rerank_score", score), k, qid, F.desc("rerank_score"), F.asc("base_rank"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def collapse(hits: DataFrame, parent: str, k: int, qid: str = "qid") -> DataFrame:
    """qid, parent, rank: chunk rankings as document rankings, each at its best chunk's place."""
    best = hits.groupBy(qid, parent).agg(F.min("rank").alias("best"))
    return top(best, k, qid, F.asc("best")).select(qid, parent, "rank")


def route(similarity: Column, gate: float = 0.30, margin: float = 0.15) -> Column:
    return F.when(similarity < gate, "abstain").when(similarity >= gate + margin, "single").otherwise("iterative")

