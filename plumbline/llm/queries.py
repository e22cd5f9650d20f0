"""Queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import alignment, chat, langid, mixing, near_dedup, quality, repair, sentencepiece_codec, simhash, telephony, topk, url_filter, warc
from plumbline.llm.common import table

#: The rules of the URL query.
URL_RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = sentencepiece_codec.model_bytes(public_tokenizers.path("piece_bpe_32k.model"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.digests(sentencepiece_codec.encode_decode(docs, model))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(rows, rows.filter("vec_id % 20 = 0"), 20, scale=64.0)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = [url_filter.host_rule(*r) for r in URL_RULES] + url_filter.pattern_rules()
    return url_filter.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    archives = warc.write(pages, least=0)
    captures = warc.fetch(archives, warc.find(warc.index(archives), pages))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(docs, F.col("source")).select("doc_id", "size", "source_size", "target", "taken")


def op6_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return telephony.in_shards(telephony.store(docs, "text"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality.posterior(docs, labels, F.col("source"), F.col("lang"), columns=["doc_id"])


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, ~langid.held_out())
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def byte_bpe() -> str:
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = sentencepiece_codec.model_bytes(public_tokenizers.path("piece_bpe_32k.model"))
    return alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"), byte_bpe(), model)


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damage(table(spark, sf_dir, "conversations")))


QUERIES = {
    f.__name__: f
    for f in (op1_sentencepiece, op2_topk_search, op3_url_filter, op4_warc, op5_mixing, op6_telephony, op7_quality, op8_near_dedup, op9_chat, op10_langid, op11_simhash, op12_alignment, op13_repair)
}

ORACLES: dict[str, str] = {
    "op2_topk_search": """
with e as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as v from embeddings
  where vec_id is not null and len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
x as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
  from e q join e c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from x)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 20""",
    "op9_chat": """
with r as (
  select conv_id, turn, coalesce(role, 'unknown') as speaker, replace(coalesce(text, ''), '<|im_', '<| im_') as body from conversations),
p as (select distinct conv_id, speaker as perspective from r where speaker <> 'system'),
x as (
  select r.*, perspective, case when speaker = 'system' then '<|im_start|>system' when speaker = perspective then '<|im_start|>assistant'
    else '<|im_start|>user name=' || replace(speaker, '<|im_', '<| im_') end || chr(10) as head from r join p using (conv_id)),
y as (select *, head || body || '<|im_end|>' || chr(10) as piece from x),
z as (
  select *, row_number() over w - 1 as position, cast(sum(length(piece)) over w as bigint) as e from y
  window w as (partition by conv_id, perspective order by turn rows unbounded preceding))
select conv_id, perspective, turn, position, speaker, piece, e - length(piece) as start, e as "end",
       case when speaker = perspective then e - length(piece) + length(head) end as loss_start,
       case when speaker = perspective then e - 1 end as loss_end
from z""",
    "op3_url_filter": r"""
with urls as (
  select page_id, row_number() over () as n,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
rules(h, p, verdict) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fits as (
  select n, max_by(h || p, length(h || p)) as rule, max_by(verdict, length(h || p)) as verdict
  from urls join rules on host <> '' and (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
  group by n)
select page_id, host, path, rule,
       coalesce(verdict, case when host <> '' and regexp_matches(host || path,
         '/(login|signin|cart|checkout)(/|$)|\.(exe|zip|iso)$') then 'block' else 'allow' end) as verdict
from urls left join fits using (n)""",
}
