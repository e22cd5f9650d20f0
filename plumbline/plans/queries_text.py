"""Queries over texts: passages, sentences, citations, names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import ids
from plumbline.functions import text as T
from plumbline.operators import chunks
from plumbline.plans import sql as S

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def passages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """passage_id, doc_id, text of all documents."""
    found = chunks.chunk_passages(table(spark, sf_dir, "documents"), F.array("text"))
    return found.select(ids.pack(F.col("doc_id"), F.col("idx"), ids.PASSAGES).alias("passage_id"), "doc_id", "text")


PASSAGES = S.chunk_ctes() + ", passages as (select doc_id * 10000 + idx as passage_id, doc_id, text from chunks)"


@query(f"with {S.chunk_ctes()} select doc_id, idx, page, text from chunks")
def chunk_passages(spark, sf_dir):
    return chunks.chunk_passages(table(spark, sf_dir, "documents"), F.array("text"))


@query(f"with {S.chunk_ctes()} select lang, count(*) as passages, sum(length(c.text)) as chars, round(avg(length(c.text)), 6) as mean_chars from chunks c join documents d on c.doc_id = d.doc_id group by lang")
def chunk_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = docs.select("lang", F.explode(chunks.windows(F.array("text"), 8, 4, 30, 3)).alias("w"))
    n = F.length("w.text")
    return found.groupBy("lang").agg(F.count(F.lit(1)).alias("passages"), F.sum(n).alias("chars"), F.round(F.avg(n), 6).alias("mean_chars"))


@query(f"with {S.sentence_ctes('s', 'documents', 'doc_id', 'text')} select doc_id, cast(i - 1 as integer) as claim_idx, sentences[i] as claim from (select doc_id, sentences, unnest(range(1, len(sentences) + 1)) as i from s)")
def segment_sentences(spark, sf_dir):
    return chunks.claims(table(spark, sf_dir, "documents"), F.col("text"), "doc_id")


@query(f"""with {S.sentence_ctes('s', 'documents', 'doc_id, text', 'text')},
g as (select doc_id, text, sentences, unnest(case when len(sentences) <= 3 then [0] else range(0, cast(ceil((len(sentences) - 3) / 2.0) as bigint) * 2 + 1, 2) end) as st from s)
select doc_id, cast(st // 2 as integer) as idx, case when len(sentences) <= 3 then text else array_to_string(sentences[st + 1 : st + 3], ' ') end as text from g""")
def sentence_group_chunks(spark, sf_dir):
    return chunks.sentence_groups(table(spark, sf_dir, "documents"), F.col("text"), 3)


@query(f"""with {S.sentence_ctes('s', 'conversations', 'conv_id, turn, text', 'text')},
w as (select conv_id, turn, case when len(sentences) > 0 then sentences when {S.strip('text')} <> '' then [{S.strip('text')}] else [] end as c from s)
select conv_id, turn, cast(len(c) as integer) as n_claims, c[1] as first_claim from w""")
def claims_or_whole(spark, sf_dir):
    found = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.or_whole(T.sentences(F.col("text")), F.col("text")).alias("c"))
    return found.select("conv_id", "turn", F.size("c").alias("n_claims"), F.get("c", F.lit(0)).alias("first_claim"))


@query(rf"""with p as (select page_id, string_split_regex(coalesce(regexp_replace(html, '(<h1>|<p>)', chr(10) || '## ', 'g'), ''), '(?m)^##\s+') as parts from pages),
t as (select page_id, list_filter(list_transform(case when len(parts) > 1 then parts[2:] else parts end, lambda x: {S.strip('x')}), lambda x: x <> '') as s from p)
select page_id, cast(i as integer) as page, s[i] as section from (select page_id, s, unnest(range(1, len(s) + 1)) as i from t)""")
def markdown_sections(spark, sf_dir):
    marked = F.regexp_replace("html", "(<h1>|<p>)", "\n## ")
    found = table(spark, sf_dir, "pages").select("page_id", F.posexplode(T.markdown_sections(marked)).alias("i", "section"))
    return found.select("page_id", (F.col("i") + 1).alias("page"), "section")


CITED = "text || ' [' || (doc_id % 7) || ']. See [1-4] and [2, 9]; [4-1] [sic] [0]'"


@query(rf"""with m as (select doc_id, regexp_extract_all({CITED}, '\[([0-9][0-9,\s\-]*)\]', 1) as g from documents),
g as (select doc_id, unnest(g) as g from m),
p as (select doc_id, trim(unnest(string_split(g, ','))) as x from g),
n as (select doc_id, unnest(case when regexp_full_match(x, '\d+') then [cast(x as integer)]
  when regexp_full_match(x, '\d+\s*-\s*\d+') and cast(regexp_extract(x, '-\s*(\d+)', 1) as integer) - cast(regexp_extract(x, '^\d+') as integer) between 0 and 50
  then range(cast(regexp_extract(x, '^\d+') as integer), cast(regexp_extract(x, '-\s*(\d+)', 1) as integer) + 1) else [] end) as v from p)
select doc_id, array_to_string(list_sort(list(distinct v)), ',') as markers from n group by doc_id""")
def citation_markers_ranges(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", T.citation_markers(F.expr(CITED.replace("(doc_id % 7)", "cast(doc_id % 7 as string)"))).alias("m"))
    return found.select("doc_id", F.array_join(F.col("m").cast("array<string>"), ",").alias("markers"))


@query(rf"""with r as (select doc_id, string_split(regexp_replace({CITED}, '([.!?])\s+', concat('\1', chr(1)), 'g'), chr(1)) as s from documents),
e as (select doc_id, i - 1 as claim_idx, try_cast(regexp_extract(s[i], '\[(\d+)\]', 1) as integer) as n from (select doc_id, s, unnest(range(1, len(s) + 1)) as i from r))
select doc_id, cast(claim_idx as integer) as claim_idx, n - 1 as passage from e where n >= 1""")
def citation_parse(spark, sf_dir):
    text = F.expr(CITED.replace("(doc_id % 7)", "cast(doc_id % 7 as string)"))
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.citations(text)).alias("c"))
    return found.select("doc_id", F.col("c.claim").alias("claim_idx"), F.col("c.passage").alias("passage"))


@query(rf"""with n as (select page_id, regexp_extract(url, '([^/]*)/*$', 1) as base from pages)
select page_id, coalesce(nullif(left({S.squeeze('base')}, 128), ''), 'document') as name from n""")
def safe_display_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.display_name(F.col("url")).alias("name"))


@query(rf"""select doc_id, array_to_string(list_filter(list_transform(string_split_regex(text, '\r\n|[\n\r]'),
  lambda x: {S.strip(r"regexp_replace(" + S.strip('x') + r", '^\s*(\d+[.)]|[-*•])\s*', '')")}), lambda x: x <> '')[1:3], chr(10)) as questions from documents""")
def question_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.question_lines(F.col("text"), 3), "\n").alias("questions"))


@query(rf"""with b as (select doc_id, case doc_id % 3 when 0 then 'Context: ' when 1 then 'This chunk is ' else '' end || text as t from documents),
c as (select doc_id, {S.strip('t')} as t from b),
d as (select doc_id, case when regexp_matches(lower(t), '^(context:|this chunk|this passage|this section|here is|here''s|the following)') and contains(left(t, 40), ':')
  then {S.strip("regexp_replace(t, '(?s)^[^:]*:', '')")} else t end as t from c),
e as (select doc_id, t, list_filter(string_split({S.squeeze('t')}, ' '), lambda w: w <> '') as w from d)
select doc_id, case when len(w) > 60 then array_to_string(w[1:60], ' ') else t end as sentence from e""")
def situating_sentences(spark, sf_dir):
    lead = F.when(F.col("doc_id") % 3 == 0, "Context: ").when(F.col("doc_id") % 3 == 1, "This chunk is ").otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", T.situating_sentence(F.concat(lead, F.col("text"))).alias("sentence"))


@query(rf"""select page_id, case when kind not in ('.md', '.txt', '.pdf') then 'unsupported file type ' || coalesce(nullif(kind, ''), '(none)')
  when strlen(html) = 0 then 'empty file' when strlen(html) > 4000 then 'larger than 4000 bytes' when kind = '.pdf' then 'not a PDF' end as reason
from (select page_id, html, case page_id % 4 when 0 then '.md' when 1 then '.pdf' when 2 then '.txt' else lower(regexp_extract(url, '(\.[^./]+)$', 1)) end as kind from pages)""")
def validate_upload(spark, sf_dir):
    from plumbline.sources.store import reject_reason

    p = F.col("page_id") % 4
    name = F.concat(F.col("url"), F.when(p == 0, "/a.md").when(p == 1, "/a.pdf").when(p == 2, "/a.txt").otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", reject_reason(name, F.col("html").cast("binary"), 4000).alias("reason"))
