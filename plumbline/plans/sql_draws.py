"""SQL of the resampling draws: the same digests, row by row."""

from __future__ import annotations

from plumbline.operators.draws import DRAWS, MULTIPLIER, REPLICATES


def mix(x: str) -> str:
    for _ in range(2):
        x = f"((xor({x}, ({x}) >> 16) * {MULTIPLIER}) % 4294967296)"
    return f"xor({x}, ({x}) >> 16)"


def replicates(n: int = 10_000, seed: int = 0) -> str:
    """CTEs that end in reps(r, a), and as_is: replicate -1."""
    return f"""reps_0 as (select r, (r + {seed * REPLICATES % (1 << 32)}) % 4294967296 as x from range({n}) t(r)), reps as (select r, {mix('x')} as a from reps_0)"""


def drawn(name: str, source: str, order: str, stratum: str = "0", by: str = "") -> str:
    """CTEs that end in name(r, by, s, rows, source's columns): the rows of each replicate, and, as -1, all rows."""
    keys = f"{by}, " if by else ""
    return f"""{name}_r as (select *, {stratum} as s, row_number() over (partition by {keys} {stratum} order by {order}) - 1 as pl, count(*) over (partition by {keys} {stratum}) as rows from {source}),
{name}_z as (select distinct {keys} s, rows from {name}_r),
{name}_j as (select {keys} s, rows, (2 * j + s + {DRAWS}) % 4294967296 as x from (select *, unnest(range(rows)) as j from {name}_z)),
{name}_b as (select {keys} s, rows, {mix('x')} as b from {name}_j),
{name}_d as (select r, {keys} s, ({mix('xor(a, b)')} * rows) >> 32 as pl from reps, {name}_b),
{name} as (select r, {name}_r.* from {name}_d join {name}_r using ({keys} s, pl) union all select -1, * from {name}_r)"""


def coins(name: str, source: str, order: str, by: str = "") -> str:
    """CTEs that end in name(r, swap, source's columns)."""
    part = f"partition by {by}" if by else ""
    return f"""{name}_r as (select *, row_number() over ({part} order by {order}) - 1 as pl from {source}),
{name}_w as (select distinct pl // 32 as w, (pl // 32 + {DRAWS}) % 4294967296 as x from {name}_r),
{name}_b as (select w, {mix('x')} as b from {name}_w),
{name}_h as (select r, w, {mix('xor(a, b)')} as h from reps, {name}_b),
{name} as (select r, (h >> (pl % 32)) & 1 = 1 as swap, {name}_r.* from {name}_r join {name}_h on w = pl // 32 union all select -1, false, * from {name}_r)"""


def auc(name: str, source: str, keys: str, score: str, positive: str) -> str:
    """CTEs that end in name(keys, value)."""
    return f"""{name}_t as (select {keys}, {score} as v, count(*) filter ({positive}) as p, count(*) filter (not ({positive})) as q from {source} group by all),
{name}_w as (select {keys}, p, q, sum(q) over (partition by {keys} order by v) - q as below from {name}_t),
{name} as (select {keys}, case when sum(p) > 0 and sum(q) > 0 then sum(p * (2 * below + q)) / (2.0::double * sum(p) * sum(q)) else 'nan'::double end as value from {name}_w group by {keys})"""


def interval(source: str, keys: str = "", more: str = "") -> str:
    """A select of point, ci_lo, ci_hi."""
    ok = "r >= 0 and value is not null and not isnan(value)"
    return f"""select {keys}{more} round(max(value) filter (r = -1), 6) as point, round(quantile_cont(value, 0.025) filter ({ok}), 6) as ci_lo, round(quantile_cont(value, 0.975) filter ({ok}), 6) as ci_hi from {source}"""
