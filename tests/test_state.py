import random

import pytest
from pyspark.sql import functions as F

from plumbline.streaming import limiter, traces


def plain(events, most, window):
    live, out = {}, {}
    for key, event, at in sorted(events, key=lambda e: (e[2], e[1])):
        own = [t for t in live.get(key, []) if t > at - window]
        out[event] = len(own) < most
        live[key] = [*own, at] if out[event] else own
    return out


EVENTS = [("a", 1, 0.0), ("a", 2, 1.0), ("a", 3, 2.0), ("b", 4, 2.0), ("a", 5, 5.0), ("a", 6, 5.5), ("a", 7, 6.0), ("b", 8, 3.0), ("b", 9, 3.0)]


def test_limiter(spark):
    df = spark.createDataFrame(EVENTS, "key string, event_id long, at double")
    got = {r.event_id: r for r in limiter.limit(df, "key", "at", "event_id", 2, 5.0).collect()}
    assert {i: r.allowed for i, r in got.items()} == plain(EVENTS, 2, 5.0)
    assert got[5].allowed and got[3].retry_after == 3  # the edge of the window has passed
    assert not any(r.allowed for r in limiter.limit(df, "key", "at", "event_id", 0, 5.0).collect())
    with pytest.raises(ValueError):
        limiter.limit(df, "key", "at", "event_id", 1, 0)


def test_two_levels(spark):
    df = spark.createDataFrame(EVENTS, "key string, event_id long, at double")
    got = {r.event_id: r.verdict for r in limiter.two_level(df, "key", "at", "event_id", (2, 5.0), (3, 5.0)).collect()}
    client = plain(EVENTS, 2, 5.0)
    passed = [("all", e, t) for _, e, t in EVENTS if client[e]]
    everyone = plain(passed, 3, 5.0)
    assert got == {e: "client" if not client[e] else "allowed" if everyone[e] else "global" for _, e, _ in EVENTS}


@pytest.mark.parametrize(("most", "window", "spread"), [(3, 40.0, 3000.0), (50, 400.0, 300.0), (2, 5.0, 30.0)])
def test_a_busy_client_is_folded_in_pieces(spark, monkeypatch, most, window, spread):
    """Dense and sparse histories, ties, and pieces shorter than the window."""
    monkeypatch.setattr(limiter, "PIECE", 60)
    r = random.Random(int(window))
    events = [(k, i, round(r.uniform(0, spread), r.choice([0, 2]))) for i, k in enumerate(r.choices("aaaaab", k=900))] + [("c", 10_000, 1.0)]
    df = spark.createDataFrame(events, "key string, event_id long, at double")
    got = {x.event_id: (x.allowed, x.retry_after) for x in limiter.limit(df, "key", "at", "event_id", most, window).collect()}
    assert {i: a for i, (a, _) in got.items()} == plain(events, most, window)
    monkeypatch.setattr(limiter, "PIECE", 10**9)
    whole = {x.event_id: (x.allowed, x.retry_after) for x in limiter.limit(df, "key", "at", "event_id", most, window).collect()}
    assert got == whole


def test_pieces_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(limiter, "PIECE", 100)
    df = spark.range(1000).selectExpr("'hot' as key", "id as event_id", "id * 1.0 as at")
    sizes = []
    real = limiter.stored

    def spy(df, name):
        out = real(df, name)
        if name == "pieces":
            sizes.extend(r["count"] for r in out.groupBy("key", "part").count().collect())
        return out

    monkeypatch.setattr(limiter, "stored", spy)
    assert limiter.limit(df, "key", "at", "event_id", 5, 10.0).filter("allowed").count() == 500
    assert len(sizes) == 10 and max(sizes) < 250


def test_limiter_as_a_stream(spark, tmp_path):
    schema = "key string, event_id long, at double"
    source = tmp_path / "in"
    for i, part in enumerate((EVENTS[:4], EVENTS[4:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(source))
        stream = limiter.limit_stream(spark.readStream.schema(schema).json(str(source)), "key", "at", "event_id", 2, 5.0)
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    got = {r.event_id: r.allowed for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == plain(EVENTS, 2, 5.0)


def test_traces(spark):
    rows = [(i, float(v), v == 3, None if v == 3 else v / 10) for i, v in enumerate((1, 2, 3, 4, 10))]
    df = spark.createDataFrame(rows, "id long, total_ms double, abstained boolean, trust_geometric double")
    s = traces.statistics(df).first()
    assert (s["count"], s.abstention_rate, s.p50_ms, s.p95_ms) == (5, 0.2, 3.0, 10.0) and s.mean_trust == pytest.approx(0.425)
    assert [r.id for r in traces.latest(df, 2, "id").collect()] == [4, 3]
    none = traces.statistics(df.limit(0)).first()
    assert none["count"] == 0 and none.p50_ms is None and none.mean_trust is None


def test_retention(spark):
    days = [(i, f"2024-01-{d:02d}") for i, d in enumerate((1, 5, 9, 10))] + [(9, None)]
    df = spark.createDataFrame(days, "corpus_id long, created string").withColumn("created_at", F.col("created").cast("timestamp"))
    now = F.lit("2024-01-10").cast("timestamp")
    dropped = lambda ttl, cap: {r.corpus_id for r in traces.sweep(df, now, ttl, cap).collect() if r.dropped}
    assert dropped(24 * 6, 10) == {0} and dropped(0, 10) == set() and dropped(0, 2) == {0, 1, 9}


def test_windows_as_a_stream(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", 1.0), ("2024-01-01 00:50:00", 3.0), ("2024-01-01 03:00:00", 5.0)]
    df = spark.createDataFrame(rows, "t string, value double").select(F.col("t").cast("timestamp").alias("ts"), "value")
    batch = traces.windowed(df, "ts", "1 hour").orderBy("window_start").collect()
    assert [(r["count"], r.mean_value) for r in batch] == [(2, 2.0), (1, 5.0)]
    df.write.parquet(str(tmp_path / "in"))
    live = traces.windowed(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", "1 hour", "10 minutes")
    query = live.writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [r["count"] for r in spark.table("windows").collect()] == [2]  # the watermark has passed the first alone


def traced(r, n, start=0):
    return [(start + i, f"2024-01-0{r.randint(1, 9)} 0{r.randint(0, 9)}:00:00", r.random() < 0.3, float(r.randint(1, 50)), None if r.random() < 0.5 else 0.5) for i in range(n)]


@pytest.mark.parametrize("max_age", [None, "3 days"])
def test_trace_ring_as_a_stream(spark, tmp_path, max_age):
    """Late rows, a restart from the checkpoint, and a batch that runs again."""
    schema = "event_id long, ts timestamp, abstained boolean, total_ms double, trust_geometric double"
    r, source, ring, done = random.Random(4), str(tmp_path / "in"), str(tmp_path / "ring"), []
    for i in range(4):
        part = traced(r, 40, 40 * i)
        done += part
        spark.createDataFrame(part, "event_id long, ts string, abstained boolean, total_ms double, trust_geometric double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").json(source)
        if i == 2:
            continue  # the next start finds two parts
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source)
        stream = traces.ring_stream(rows, ring, str(tmp_path / "state"), 25, "ts", "event_id", at="ts", max_age=max_age).trigger(availableNow=True).start()
        stream.awaitTermination(120)
        assert stream.exception() is None
    everything = spark.read.schema(schema).json(source)
    if max_age:
        everything = everything.filter(F.col("ts") > F.lit(everything.agg(F.max("ts")).first()[0]) - F.expr("interval 3 days"))
    want = [tuple(x) for x in traces.latest(everything, 25, "ts", "event_id").collect()]
    kept = traces.ring(spark, ring)
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)
    assert len(traces._versions(spark, ring)) == 2
    assert traces.statistics(kept).first()["count"] == len(want)
    before = traces.ring(spark, ring, traces._versions(spark, ring)[-1])
    assert before is not None and before.count() <= 25


def test_an_unfinished_ring_is_not_read(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "batch=0"))
    (tmp_path / "batch=1").mkdir()
    assert traces._versions(spark, str(tmp_path)) == [0] and traces.ring(spark, str(tmp_path)).count() == 3
    assert traces.ring(spark, str(tmp_path / "none")) is None
