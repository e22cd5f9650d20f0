"""Queries over event streams and stored state: limits, traces, retention, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.plans.queries_text import table
from plumbline.streaming import limiter, traces

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def recorded(spark, sf_dir):
    """events as traces: errors are declined answers."""
    e = table(spark, sf_dir, "events")
    declined = F.col("event_type") == "error"
    return e.select(
        "event_id", "ts", "user_id", declined.alias("abstained"), F.col("value").alias("total_ms"), F.when(~declined, F.pmod("event_id", F.lit(100)) / 100.0).alias("trust_geometric"), "value", "event_type"
    )


TRACED = "traced as (select event_id, ts, user_id, event_type = 'error' as abstained, value as total_ms, case when event_type <> 'error' then (event_id % 100) / 100.0 end as trust_geometric, value, event_type from events)"


@query(f"with {TRACED} select event_id, abstained, round(total_ms, 6) as total_ms from traced order by ts desc, event_id desc limit 100")
def trace_ring_buffer(spark, sf_dir):
    return traces.latest(recorded(spark, sf_dir), 100, "ts", "event_id").select("event_id", "abstained", F.round("total_ms", 6).alias("total_ms"))


@query(f"""with {TRACED} select count(*) as count, round(avg(case when abstained then 1.0 else 0 end), 6) as abstention_rate, round(quantile_disc(total_ms, 0.5), 6) as p50_ms,
round(quantile_disc(total_ms, 0.95), 6) as p95_ms, round(avg(trust_geometric), 6) as mean_trust from traced""")
def trace_stats(spark, sf_dir):
    names = ("abstention_rate", "p50_ms", "p95_ms", "mean_trust")
    return traces.statistics(recorded(spark, sf_dir)).select("count", *(F.round(c, 6).alias(c) for c in names))


@query("select conv_id, turn, left(sha256(text), 12) as question_hash, turn % 3 = 0 as abstained, case when turn % 3 <> 0 then round(turn / 10.0, 6) end as trust_geometric, cast(length(text) as bigint) as total_ms from conversations where role = 'user'")
def trace_record(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    c = c.withColumn("abstained", F.col("turn") % 3 == 0).withColumn("t_geom", F.round(F.col("turn") / 10.0, 6))
    return traces.records(c, "text", F.length("text").cast("long"), "conv_id", "turn")


@query("""with r as (select event_id, ts, case when ts < timestamp '2024-01-31' - interval 240 hour then 1 else 0 end as old from events),
n as (select *, row_number() over (partition by old order by ts desc, event_id desc) as p from r) select event_id, old = 1 or p > 500 as dropped from n""")
def retention_sweep(spark, sf_dir):
    out = traces.sweep(table(spark, sf_dir, "events"), F.lit("2024-01-31").cast("timestamp"), 240, 500, "ts", "event_id")
    return out.select("event_id", "dropped")


SECONDS = "(epoch_us(ts) / 1000000.0)::double"


def limited(most: int, window: float, name: str = "l", source: str = "src") -> str:
    """CTEs of a limiter over source(key, event_id, tm): the fold over each key's requests."""
    return f"""{name}_o as (select *, row_number() over (partition by key order by tm, event_id) as n from {source}),
{name}_f(key, n, event_id, tm, live, allowed, oldest) as (
  select key, n, event_id, tm, cast([tm] as double[]), true, tm from {name}_o where n = 1
  union all
  select o.key, o.n, o.event_id, o.tm, case when len(list_filter(f.live, lambda x: x > o.tm - {window})) < {most} then list_append(list_filter(f.live, lambda x: x > o.tm - {window}), o.tm) else list_filter(f.live, lambda x: x > o.tm - {window}) end,
    len(list_filter(f.live, lambda x: x > o.tm - {window})) < {most}, list_filter(f.live, lambda x: x > o.tm - {window})[1]
  from {name}_f f join {name}_o o on o.key = f.key and o.n = f.n + 1),
{name} as (select key, event_id, allowed, case when allowed then 0 else greatest(1, ceil(oldest + {window} - tm)) end as retry_after from {name}_f)"""


def timed(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    utc = F.to_timestamp(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("Z")))
    return e.select(F.col("user_id").cast("string").alias("key"), "event_id", (F.unix_micros(utc) / 1_000_000.0).alias("at"))


@query(f"with recursive src as (select cast(user_id as varchar) as key, event_id, {SECONDS} as tm from events), {limited(3, 86400.0)} select key, event_id, allowed, cast(retry_after as bigint) as retry_after from l")
def sliding_window_limiter(spark, sf_dir):
    return limiter.limit(timed(spark, sf_dir), "key", "at", "event_id", 3, 86400.0).drop("at")


@query(f"""with recursive src as (select cast(user_id as varchar) as key, event_id, {SECONDS} as tm from events), {limited(3, 86400.0, 'c')},
passed as (select 'all' as key, c.event_id, src.tm from c join src using (event_id) where c.allowed), {limited(5, 3600.0, 'g', 'passed')}
select c.key, c.event_id, case when not c.allowed then 'client' when g.allowed then 'allowed' else 'global' end as verdict from c left join g using (event_id)""")
def two_level_limiter(spark, sf_dir):
    return limiter.two_level(timed(spark, sf_dir), "key", "at", "event_id", (3, 86400.0), (5, 3600.0)).select("key", "event_id", "verdict")


@query("""select event_id, coalesce(nullif(trim(string_split(case when event_id % 3 = 0 then ' 10.0.0.' || user_id || ' , 9.9.9.9' when event_id % 3 = 1 then '' end, ',')[1]), ''), case when event_id % 2 = 0 then 'host' end, 'unknown') as key from events""")
def client_key(spark, sf_dir):
    i = F.col("event_id")
    forwarded = F.when(i % 3 == 0, F.concat(F.lit(" 10.0.0."), F.col("user_id").cast("string"), F.lit(" , 9.9.9.9"))).when(i % 3 == 1, "")
    host = F.when(i % 2 == 0, "host")
    return table(spark, sf_dir, "events").select("event_id", T.client_key(forwarded, host, True).alias("key"))


@query("""select time_bucket(interval 1 day, ts) as window_start, time_bucket(interval 1 day, ts) + interval 1 day as window_end, event_type, count(*) as count, round(avg(value), 6) as mean_value from events group by all""")
def events_windowed_trust(spark, sf_dir):
    out = traces.windowed(table(spark, sf_dir, "events"), "ts", "1 day", None, "event_type")
    naive = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return out.select(naive("window_start"), naive("window_end"), "event_type", "count", F.round("mean_value", 6).alias("mean_value"))


@query("""with o as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 12 hour then 0 else 1 end as new from events),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from o)
select user_id, min(ts) as session_start, max(ts) + interval 12 hour as session_end, count(*) as count from s group by user_id, s""")
def events_sessions(spark, sf_dir):
    out = traces.sessions(table(spark, sf_dir, "events"), "ts", "12 hours", "user_id")
    naive = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return out.select("user_id", naive("session_start"), naive("session_end"), "count")
