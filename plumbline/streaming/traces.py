"""Traces of answered questions: records, the latest ones, their statistics, retention, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from plumbline.functions.text import question_hash
from plumbline.operators.stats import nearest, order_statistics
from plumbline.sources.shared import exists, listed, remove


def records(results: DataFrame, question: str, total_ms: Column, *more: str) -> DataFrame:
    """A question's hash in place of its text; no trust where the answer was declined."""
    return results.select(
        question_hash(F.col(question)).alias("question_hash"), "abstained", F.when(~F.col("abstained"), F.col("t_geom")).alias("trust_geometric"), total_ms.alias("total_ms"), *more
    )


def latest(traces: DataFrame, capacity: int, *order: str) -> DataFrame:
    """The newest `capacity` traces, newest first: a bounded top-n, no global sort."""
    return traces.orderBy(*[F.desc(c) for c in order]).limit(max(capacity, 0))


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The rings that were written whole, the oldest first."""
    names = listed(spark, path)
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch=") and exists(spark, f"{path}/{n}/_SUCCESS"))


def ring(spark: SparkSession, path: str, below: int | None = None) -> DataFrame | None:
    """The newest traces as `ring_stream` last kept them (before a batch), if it has."""
    found = [v for v in _versions(spark, path) if below is None or v < below]
    return spark.read.parquet(f"{path}/batch={found[-1]}") if found else None


def ring_stream(traces: DataFrame, path: str, checkpoint: str, capacity: int, *order: str, at: str | None = None, max_age: str | None = None) -> DataStreamWriter:
    """Keeps the newest `capacity` traces of a stream below path: what `latest` finds in all of them.

    Each batch writes a ring of its own from the last one and what is new, so a batch that runs again
    after a failure gives the same ring, and readers see one ring or the next, never half of it. A trace
    that comes late stands where its time puts it, or nowhere. With max_age, traces that are that much
    older than the newest one (by `at`) expire. Two rings are kept.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = ring(spark, path, number)
        both = batch if before is None else before.unionByName(batch)
        if max_age is not None:
            newest = both.agg(F.max(at)).first()[0]
            both = both.filter(F.col(at) > F.lit(newest) - F.expr(f"interval {max_age}"))
        latest(both, capacity, *order).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={number}")
        for old in [v for v in _versions(spark, path) if v < number][:-1]:
            remove(spark, f"{path}/batch={old}")

    return traces.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def statistics(traces: DataFrame, ms: str = "total_ms", trust: str = "trust_geometric") -> DataFrame:
    """count, abstention_rate, p50_ms, p95_ms (nearest rank), mean_trust; null without traces."""
    counts = traces.agg(F.count(F.lit(1)).alias("count"), F.avg(F.col("abstained").cast("double")).alias("abstention_rate"), F.avg(trust).alias("mean_trust"))
    times = order_statistics(traces, F.col(ms), {"p50_ms": nearest(0.5), "p95_ms": nearest(0.95)})
    return counts.join(F.broadcast(times)).select("count", "abstention_rate", "p50_ms", "p95_ms", "mean_trust")  # a row each


def sweep(corpora: DataFrame, now: Column, ttl_hours: float, cap: int, created: str = "created_at", key: str = "corpus_id") -> DataFrame:
    """corpora with `dropped`: older than the limit (where one is set and the date is known), then
    the oldest beyond the cap.

    The cap-th newest of those that aren't too old is found by a top-n, and the others are compared
    with it; no task orders them all.
    """
    c = F.col(created)
    old = F.coalesce(c < now - F.make_interval(hours=F.lit(int(ttl_hours))), F.lit(False)) if ttl_hours > 0 else F.lit(False)
    newest = corpora.filter(~old).select(c.alias("c"), F.col(key).alias("k")).orderBy(F.desc_nulls_last("c"), F.desc("k")).limit(max(cap, 0))
    if cap <= 0:
        return corpora.withColumn("dropped", F.lit(True))
    if newest.count() < cap:
        return corpora.withColumn("dropped", old)
    least = newest.orderBy(F.asc_nulls_first("c"), F.asc("k")).first()
    kinds = {f.name: f.dataType for f in corpora.schema.fields}
    k, at = F.lit(least.k).cast(kinds[key]), F.lit(least.c).cast(kinds[created])
    if least.c is None:
        beyond = c.isNull() & (F.col(key) < k)
    else:
        beyond = c.isNull() | (c < at) | ((c == at) & (F.col(key) < k))
    return corpora.withColumn("dropped", old | beyond)


def windowed(traces: DataFrame, at: str, width: str, late: str | None = None, *keys: str) -> DataFrame:
    """Statistics of tumbling windows; with `late`, a watermark for streams."""
    rows = traces.withWatermark(at, late) if late else traces
    found = rows.groupBy(F.window(at, width), *keys).agg(F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean_value"))
    return found.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "count", "mean_value")


def sessions(traces: DataFrame, at: str, gap: str, key: str, late: str | None = None) -> DataFrame:
    rows = traces.withWatermark(at, late) if late else traces
    found = rows.groupBy(F.session_window(at, gap), key).agg(F.count(F.lit(1)).alias("count"))
    return found.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "count")
