"""Pieces of the SQL that queries are held against."""

from __future__ import annotations

from plumbline.functions.text import ABBREVIATIONS

ABBREVIATED = ", ".join(f"'{a}'" for a in ABBREVIATIONS)


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def squeeze(x: str) -> str:
    return strip(rf"regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g')")


def tokens(x: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({x}, '')), '[^a-z0-9]+'), lambda t: t <> '')"


def word_set(x: str) -> str:
    return rf"list_distinct(regexp_extract_all(lower(coalesce({x}, '')), '[\p{{L}}\p{{N}}_]+'))"


def esc(x: str) -> str:
    return f"replace(replace({x}, chr(2), chr(2) || 'b'), chr(1), chr(2) || 'a')"


def unesc(x: str) -> str:
    return f"replace(replace({x}, chr(2) || 'a', chr(1)), chr(2) || 'b', chr(2))"


def sentence_ctes(name: str, source: str, keys: str, text: str, min_chars: int = 20) -> str:
    """CTEs that end in name(keys, sentences)."""
    return rf"""
{name}_1 as (select {keys}, list_filter(string_split(regexp_replace({esc(squeeze(text))}, '([.!?])\s+', concat('\1', chr(1)), 'g'), chr(1)), lambda p: p <> '') as p from {source}),
{name}_2 as (select {keys}, case when len(p) = 0 then [] else string_split(array_to_string(list_transform(p, lambda x, i:
    case when i = 1 then '' when lower(regexp_extract(p[i - 1], '[^ ]*$')) in ({ABBREVIATED}) then ' ' else chr(1) end || x), ''), chr(1)) end as w from {name}_1),
{name} as (select {keys}, case when len(w) = 0 then [] else list_transform(string_split(array_to_string(list_transform(w, lambda x, i:
    case when i = 1 then '' when length({unesc('x')}) < {min_chars} then ' ' else chr(1) end || x), ''), chr(1)), lambda x: {unesc('x')}) end as sentences from {name}_2)"""


def chunk_ctes(name: str = "chunks", source: str = "documents", key: str = "doc_id", text: str = "text", w: int = 8, s: int = 4) -> str:
    """CTEs that end in name(key, idx, page, text): windows of lines, each text once a document."""
    return rf"""
{name}_1 as (select {key}, list_filter(list_transform(string_split(coalesce({text}, ''), chr(10)), lambda x: {strip('x')}), lambda x: length(x) > 3) as ls from {source}),
{name}_2 as (select {key}, unnest(case when len(ls) = 0 then [] else range(0, cast(greatest(ceil((len(ls) - {w}) / {s}.0), 0) as bigint) * {s} + 1, {s}) end) as st, ls from {name}_1),
{name}_3 as (select {key}, st, array_to_string(ls[st + 1 : st + {w}], ' ') as text from {name}_2),
{name}_4 as (select {key}, text, min(st) as st from {name}_3 where length(text) >= 30 group by all),
{name} as (select {key}, cast(row_number() over (partition by {key} order by st) - 1 as integer) as idx, cast(1 as integer) as page, text from {name}_4)"""


def bm25_ctes(name: str, passages: str, key: str, text: str, queries: str, qid: str, qtext: str) -> str:
    """CTEs that end in name(qid, key, score, rank): all hits of positive score, ranked."""
    return f"""
{name}_d as (select {key}, {tokens(text)} as t from {passages}),
{name}_p as (select {key}, dl, term, count(*) as tf from (select {key}, len(t) as dl, unnest(t) as term from {name}_d) group by all),
{name}_s as (select count(*) as n, avg(len(t)) as avgdl from {name}_d),
{name}_i as (select term, ln((n - df + 0.5) / (df + 0.5) + 1) as idf from (select term, count(*) as df from {name}_p group by term), {name}_s),
{name}_q as (select {qid} as qid, term, count(*) as qtf from (select {qid}, unnest({tokens(qtext)}) as term from {queries}) group by all),
{name}_x as (select qid, {key}, round(sum(qtf * idf * 2.5 * tf / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) as score
  from {name}_q join {name}_i using (term) join {name}_p using (term), {name}_s group by all),
{name} as (select *, row_number() over (partition by qid order by score desc, {key}) as rank from {name}_x where score > 0)"""


def hash_ctes(name: str, source: str, key: str, text: str) -> str:
    """CTEs that end in name(key, vec)."""
    return f"""
{name}_t as (select {key}, unnest(list_filter(string_split({squeeze(f'lower({text})')}, ' '), lambda x: x <> '')) as token from {source}),
{name}_c as (select {key}, cast(('0x' || right(md5(token), 2)) as integer) % 64 as b, count(*) as n from {name}_t group by all),
{name} as (select {key}, list_transform(range(64), lambda i: cast(coalesce(m[i], 0) as double)) as vec
  from (select {key}, map_from_entries(list((b, n))) as m from {name}_c group by {key}))"""


def cosine(a: str, b: str) -> str:
    return f"coalesce(list_inner_product({a}, {b}) / nullif(sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})), 0), 0)"


#: Questions (user turns) with the assistant turn that follows.
TALK = """
talk as (select a.conv_id * 1000 + a.turn as qid, a.text as question, b.text as answer from conversations a
  join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1 and a.role = 'user' and b.role = 'assistant')"""

#: Documents that hold a benchmark item's text.
RELEVANT = "relevant as (select item_id as qid, doc_id from benchmark b join documents d on contains(d.text, b.text))"

#: A score in [0, 1) and a binary label.
SCORED = "scored as (select doc_id, lang, round(n_chars / (n_chars + 2000.0), 6) as score, quality as label, toxic from documents join labels using (doc_id))"
