"""Queries over answers: entailment, metrics, aggregates, gates, edits, rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.config import Config
from plumbline.functions import ids
from plumbline.operators import dense, irmetrics, judge, perturb, resample, reshape, stats, trust
from plumbline.operators.sparse import small
from plumbline.plans import ablation, agentic, answer, sql_rounds
from plumbline.plans import sql as S
from plumbline.plans import sql_draws as Z
from plumbline.plans.engine import arm_metrics, pass_rates
from plumbline.plans.queries_text import PASSAGES, passages_of, table
from plumbline.sources.shared import stored

QUERIES, ORACLES = {}, {}
CONFIG = Config(retrieval_mode="dense", retrieval_gate=0.75, abstain_threshold=0.12, support_threshold=0.12)
NAMES = ("faithfulness", "attribution", "relevance", "conciseness")


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def talk(spark, sf_dir):
    """qid, question, answer: user turns with the assistant turn that follows."""
    t = table(spark, sf_dir, "conversations")
    a = t.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    b = t.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return a.join(b, ["conv_id", "turn"]).select(ids.pack(F.col("conv_id"), F.col("turn"), ids.TURNS).alias("qid"), "question", "answer")


def setting(spark, sf_dir):
    """passages, vectors, questions, and hits with their texts and vectors."""
    t = talk(spark, sf_dir)
    p = stored(passages_of(spark, sf_dir).select("passage_id", "text"), "passages")
    v = stored(dense.hash_counts(p, "passage_id", "text"), "vectors")
    questions = t.select("qid", "question")
    hits = answer.retrieve(p, v, questions, dense.hash_counts(questions, "qid", "question"), CONFIG)
    full = answer.hit_rows(stored(hits, "ranked"), p.withColumnRenamed("text", "passage"), v).join(questions, "qid")
    return p, v, t, stored(full, "hits")


def nli_of(spark, sf_dir):
    _, _, t, hits = setting(spark, sf_dir)
    claims = answer.T.sentences(F.col("answer"))
    claims = t.select("qid", F.posexplode(claims).alias("claim_idx", "claim"))
    return t, trust.nli_matrix(claims, hits)


def put(spark, sf_dir):
    """questions with their vectors, questions with answers, and hits."""
    _, _, t, hits = setting(spark, sf_dir)
    qvec = dense.hash_counts(t, "qid", "question").withColumnRenamed("vec", "qvec")
    return t.select("qid", "question").join(qvec, "qid", "left"), t, hits


def scorecard(spark, sf_dir):
    asked, t, hits = put(spark, sf_dir)
    return answer.measure(asked, hits, t.select("qid", "answer"), CONFIG)


HITS = f"""{PASSAGES}, {S.TALK}, {S.hash_ctes('pv', 'passages', 'passage_id', 'text')}, {S.hash_ctes('qv', 'talk', 'qid', 'question')},
sim as (select q.qid, p.passage_id, round({S.cosine('q.vec', 'p.vec')}, 9) as score from qv q, pv p),
hits as (select * from (select *, row_number() over (partition by qid order by score desc, passage_id) as rank from sim) where rank <= 5)"""
NLI = f"""{HITS}, {S.sentence_ctes('cs', 'talk', 'qid', 'answer')},
claims as (select qid, i - 1 as claim_idx, sentences[i] as claim from (select qid, sentences, unnest(range(1, len(sentences) + 1)) as i from cs)),
pairs as (select c.qid, claim_idx, rank, {S.word_set('p.text')} as a, {S.word_set('c.claim')} as b from claims c join hits h on c.qid = h.qid join passages p on p.passage_id = h.passage_id),
nli as (select qid, claim_idx, rank, coalesce(len(list_intersect(a, b)) / cast(nullif(len(list_distinct(list_concat(a, b))), 0) as double), 0) as e from pairs),
support as (select qid, claim_idx, max(e) as s, max((1 - e) / 2) as c, min_by(rank, {{'e': -e, 'r': rank}}) as r from nli group by all)"""
SCORES = f"""{NLI}, faith as (select qid, avg(s) as f, avg(c) as k, max(s) as m from support group by qid),
recalled as (select qid, 0.0 as recall from support where s >= 0.12 group by qid),
rel as (select qid, avg(greatest(0, round_free)) as r, max(greatest(0, round_free)) as top from (select h.qid, {S.cosine('q.vec', 'p.vec')} as round_free from hits h join qv q on q.qid = h.qid join pv p on p.passage_id = h.passage_id) group by qid),
{S.hash_ctes('cv', "(select qid * 1000 + claim_idx as id, claim from claims)", 'id', 'claim')},
conc as (select a.id // 1000 as qid, 1 - avg(greatest(0, {S.cosine('a.vec', 'b.vec')})) as c from cv a join cv b on a.id // 1000 = b.id // 1000 and a.id < b.id group by 1),
metrics as (select t.qid, coalesce(f, 0) as faithfulness, coalesce(k, 0) as contradiction_rate, coalesce(m, 0) as best_support, 1.0 as precision, coalesce(recall, 1.0) as recall,
  2 * coalesce(recall, 1.0) / (1 + coalesce(recall, 1.0)) as attribution, coalesce(r, 0) as relevance, coalesce(top, 0) as top_similarity, conc.c as conciseness
  from talk t left join faith using (qid) left join recalled using (qid) left join rel using (qid) left join conc on conc.qid = t.qid),
aggregated as (select *, (0.4 * faithfulness + 0.2 * attribution + 0.2 * relevance + coalesce(0.2 * conciseness, 0)) / (0.8 + case when conciseness is null then 0 else 0.2 end) as t_arith,
  case when least(faithfulness, attribution, relevance, coalesce(conciseness, 1)) = 0 then 0 else exp((0.4 * ln(faithfulness) + 0.2 * ln(attribution) + 0.2 * ln(relevance) + coalesce(0.2 * ln(conciseness), 0)) / (0.8 + case when conciseness is null then 0 else 0.2 end)) end as t_geom from
  (select * replace (case when faithfulness = 0 then 0 else faithfulness end as faithfulness) from metrics))"""


@query(f"with {NLI} select qid, cast(claim_idx as integer) as claim_idx, cast(rank as integer) as rank, round(e, 6) as entailment, round((1 - e) / 2, 6) as contradiction from nli")
def nli_matrix(spark, sf_dir):
    _, nli = nli_of(spark, sf_dir)
    return nli.select("qid", "claim_idx", "rank", F.round("entailment", 6).alias("entailment"), F.round("contradiction", 6).alias("contradiction"))


@query(f"with {NLI} select qid, cast(claim_idx as integer) as claim_idx, round(s, 6) as support, cast(r as integer) as support_rank from support")
def support_index(spark, sf_dir):
    _, nli = nli_of(spark, sf_dir)
    return trust.claim_support(nli).select("qid", "claim_idx", F.round("support", 6).alias("support"), "support_rank")


@query(f"with {NLI} select talk.qid, round(coalesce(avg(s), 0), 6) as faithfulness, round(coalesce(avg(c), 0), 6) as contradiction_rate from talk left join support using (qid) group by talk.qid")
def faithfulness(spark, sf_dir):
    t, nli = nli_of(spark, sf_dir)
    out = trust.faithfulness(t, trust.claim_support(nli))
    return out.select("qid", F.round("faithfulness", 6).alias("faithfulness"), F.round("contradiction_rate", 6).alias("contradiction_rate"))


EXTRACT = f"""{HITS}, full_hits as (select h.qid, t.question, h.rank, p.text from hits h join talk t using (qid) join passages p using (passage_id)),
tops as (select qid, question, min_by(text, rank) as a, max_by(text, rank) as b, count(*) as n from full_hits group by all),
chosen as (select qid, case when n >= 2 and list_sum(list_transform(string_split(sha1(question), ''), lambda d: cast('0x' || d as integer))) % 3 = 1 then b else a end as text from tops),
{S.sentence_ctes('fs', 'chosen', 'qid, text', 'text')},
answers as (select qid, case when len(sentences) > 0 then sentences[1] else {S.strip('text')} end || ' [1]' as answer from fs)"""


@query(f"with {EXTRACT} select qid, answer from answers")
def extractive_answers(spark, sf_dir):
    return answer.extractive(setting(spark, sf_dir)[3])


@query(rf"""with {EXTRACT}, {S.sentence_ctes('cs', 'answers', 'qid, answer', 'answer')},
claims as (select qid, i - 1 as claim_idx, sentences[i] as claim from (select qid, sentences, unnest(range(1, len(sentences) + 1)) as i from cs)),
nli as (select c.qid, claim_idx, rank, len(list_intersect({S.word_set('h.text')}, {S.word_set('c.claim')})) / cast(len(list_distinct(list_concat({S.word_set('h.text')}, {S.word_set('c.claim')}))) as double) as e from claims c join full_hits h using (qid)),
support as (select qid, claim_idx, max(e) as s from nli group by all),
cites as (select qid, 0 as claim_idx, 1 as rank from answers),
p as (select cites.qid, avg(case when e >= 0.12 then 1.0 else 0 end) as p from cites left join nli using (qid, claim_idx, rank) group by 1),
r as (select support.qid, avg(case when cites.qid is not null then 1.0 else 0 end) as r from support left join cites using (qid, claim_idx) where s >= 0.12 group by 1),
m as (select qid, coalesce(p, 1) as p, coalesce(r, 1) as r from talk left join p using (qid) left join r using (qid))
select qid, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r = 0 then 0 else 2 * p * r / (p + r) end, 6) as f1 from m""")
def attribution_prf(spark, sf_dir):
    _, _, t, hits = setting(spark, sf_dir)
    answers = answer.extractive(hits)
    claims = answers.select("qid", F.posexplode(answer.T.sentences(F.col("answer"))).alias("claim_idx", "claim"))
    nli = trust.nli_matrix(claims, hits)
    out = trust.attribution(t, trust.claim_support(nli), nli, answer.own_citations(answers), CONFIG.support_threshold)
    return out.select("qid", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(f"with {SCORES} select qid, round(relevance, 6) as context_relevance, round(top_similarity, 6) as top_similarity from metrics")
def context_relevance(spark, sf_dir):
    asked, _, hits = put(spark, sf_dir)
    return trust.relevance(asked, hits).select("qid", F.round("context_relevance", 6).alias("context_relevance"), F.round("top_similarity", 6).alias("top_similarity"))


@query(f"with {SCORES} select qid, round(conciseness, 6) as conciseness from metrics")
def conciseness(spark, sf_dir):
    t = talk(spark, sf_dir)
    claims = t.select("qid", F.posexplode(answer.T.sentences(F.col("answer"))).alias("claim_idx", "claim"))
    vectors = dense.hash_counts(claims.select(F.struct("qid", "claim_idx").alias("id"), "claim"), "id", "claim")
    return trust.conciseness(t, vectors.select("id.qid", "id.claim_idx", "vec")).select("qid", F.round("conciseness", 6).alias("conciseness"))


@query(f"""with {S.TALK}, {S.hash_ctes('qv', 'talk', 'qid', 'question')}, {S.hash_ctes('av', 'talk', 'qid', 'answer')}
select qid, round(case when qv.vec is null or av.vec is null then null else {S.cosine('qv.vec', 'av.vec')} end, 6) as answer_relevance from talk left join qv using (qid) left join av using (qid)""")
def answer_relevance(spark, sf_dir):
    t = talk(spark, sf_dir)
    asked = t.select("qid").join(dense.hash_counts(t, "qid", "question").withColumnRenamed("vec", "qvec"), "qid", "left")
    out = trust.answer_relevance(asked, dense.hash_counts(t, "qid", "answer"))
    return out.select("qid", F.round("answer_relevance", 6).alias("answer_relevance"))


@query("""with m as (select doc_id, n_chars, least(1, n_chars / 4000.0) as f, case when doc_id % 5 = 0 then 0 else (doc_id % 5) / 4.0 end as a, cast(null as double) as n from documents)
select doc_id, round((0.4 * f + 0.2 * a) / 0.6, 6) as t_arith, round(case when least(f, a) = 0 then 0 else exp((0.4 * ln(f) + 0.2 * ln(a)) / 0.6) end, 6) as t_geom from
  (select doc_id, f, case when a = 0 then 0 else a end as a from m) where a > 0 union all
select doc_id, round((0.4 * f + 0.2 * a) / 0.6, 6), 0 from m where a = 0""")
def trust_aggregates(spark, sf_dir):
    d = F.col("doc_id") % 5
    m = table(spark, sf_dir, "documents").select(
        "doc_id", F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("faithfulness"), (d / 4.0).alias("attribution"), F.lit(None).cast("double").alias("conciseness")
    )
    out = trust.aggregates(m, Config().weights, "doc_id")
    return out.select("doc_id", F.round("t_arith", 6).alias("t_arith"), F.round("t_geom", 6).alias("t_geom"))


#: What is defined after the gates: relevance alone after the first, faithfulness and the contradiction rate after the second.
GATED = """gated as (select qid, case when not g1 then faithfulness end as faithfulness, case when not g1 then contradiction_rate end as contradiction_rate, case when not g1 and not g2 then attribution end as attribution,
  case when g1 or not g2 then relevance end as relevance, case when not g1 and not g2 then conciseness end as conciseness, g1 or g2 as abstained, t_arith, t_geom
  from (select *, top_similarity < 0.75 as g1, best_support < 0.12 as g2 from aggregated))"""
CARD = f""", {GATED} select qid, round(faithfulness, 6) as faithfulness, round(attribution, 6) as attribution, round(relevance, 6) as relevance, round(conciseness, 6) as conciseness,
  abstained, case when abstained then 0 else round(t_arith, 6) end as t_arith, case when abstained then 0 else round(t_geom, 6) end as t_geom, (not abstained and t_geom >= 0.5) as is_trustworthy from gated"""


_SAFE = SCORES
for _m in ("attribution", "faithfulness", "relevance", "conciseness"):  # the logarithm of 0 is taken for no row that needs it
    _SAFE = _SAFE.replace(f"ln({_m})", f"ln(nullif({_m}, 0))")


@query(f"with {_SAFE} {CARD}")
def trust_scorecard(spark, sf_dir):
    out = scorecard(spark, sf_dir)
    r = [F.round(c, 6).alias(c) for c in ("faithfulness", "attribution", "relevance", "conciseness")]
    return out.select("qid", *r, "abstained", F.round("t_arith", 6).alias("t_arith"), F.round("t_geom", 6).alias("t_geom"), "is_trustworthy")


@query(f"""with {SCORES} select case when top_similarity < 0.75 then 'retrieval' when best_support < 0.12 then 'support' else 'answered' end as gate, count(*) as n from metrics group by 1""")
def abstention_gates(spark, sf_dir):
    out = scorecard(spark, sf_dir)
    gate = F.when(F.startswith("abstain_reason", F.lit("retrieval")), "retrieval").when(F.startswith("abstain_reason", F.lit("support")), "support").otherwise("answered")
    return out.groupBy(gate.alias("gate")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {_SAFE}, {GATED}, l as (select unnest(['faithfulness', 'contradiction_rate', 'relevance', 'conciseness']) as metric, unnest([faithfulness, contradiction_rate, relevance, conciseness]) as v from gated)
select metric, count(v) as n, round(avg(v), 6) as mean, round(median(v), 6) as median from l group by metric""")
def metric_summary_mean_median(spark, sf_dir):
    names = ["faithfulness", "contradiction_rate", "relevance", "conciseness"]
    long = stored(scorecard(spark, sf_dir).select(*names).unpivot([], names, "metric", "v"), "measures")
    middle = stats.order_statistics(long, F.col("v"), {"median": stats.linear(0.5)}, ("metric",)).select("metric", F.round("median", 6).alias("median"))
    return long.groupBy("metric").agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean")).join(middle, "metric", "left")


_ROWS = "rated as (select doc_id as qid, least(1, n_chars / 4000.0) as a, (doc_id % 7) / 7.0 as b, (doc_id % 11 + 1) / 12.0 as c, (doc_id % 13 + 1) / 14.0 as d from documents join labels using (doc_id))"
_EXP = ", ".join(f"-ln((cast('0x' || left(md5('0|' || i || '|{n}'), 8) as bigint) + 0.5) / 4294967296.0) as e{x}" for x, n in zip("abcd", NAMES, strict=True))
_SAMPLED = f"""drawn as (select i as sample, {_EXP} from range(10000) t(i)),
w as (select sample, ea / (ea + eb + ec + ed) as wa, eb / (ea + eb + ec + ed) as wb, ec / (ea + eb + ec + ed) as wc, ed / (ea + eb + ec + ed) as wd from drawn), {_ROWS},
s as (select qid, sample, wa * a + wb * b + wc * c + wd * d as ta, case when least(a, b, c, d) <= 0 then 0 else exp(wa * ln(nullif(a, 0)) + wb * ln(nullif(b, 0)) + wc * ln(nullif(c, 0)) + wd * ln(nullif(d, 0))) end as tg from rated, w)"""


def rated(spark, sf_dir):
    """qid and its four metrics, of all labelled documents."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    share = lambda m, plus, of: (F.col("doc_id") % m + plus) / float(of)
    return d.select(F.col("doc_id").alias("qid"), F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias(NAMES[0]), share(7, 0, 7).alias(NAMES[1]), share(11, 1, 12).alias(NAMES[2]), share(13, 1, 14).alias(NAMES[3]))


@query(f"""with {_SAMPLED} select sample, round(avg(ta), 6) as mean_arith, round(stddev_samp(ta), 6) as std_arith, round(min(ta), 6) as least_arith, round(max(ta), 6) as most_arith, round(avg(tg), 6) as mean_geom,
  round(avg(case when ta >= 0.5 and tg = 0 then 1.0 else 0 end), 6) as masked from s group by sample""")
def weight_sensitivity(spark, sf_dir):
    """All labelled documents under 10,000 weightings."""
    out = resample.weight_moments(rated(spark, sf_dir), resample.dirichlet_weights(spark, NAMES), NAMES)
    return out.select("sample", *(F.round(c, 6).alias(c) for c in ("mean_arith", "std_arith", "least_arith", "most_arith", "mean_geom", "masked")))


@query(f"""with {_SAMPLED}, x as (select sample, qid, round(ta, 12) as ta, round(tg, 12) as tg from s),
pairs as (select (a.ta - b.ta) * (a.tg - b.tg) < 0 as differ from x a join x b on a.sample = b.sample and a.qid < b.qid)
select round(avg(case when differ then 1.0 else 0 end), 6) as rate, count(*) as pairs from pairs""")
def ranking_disagreement(spark, sf_dir):
    """All pairs of labelled documents under 10,000 weightings."""
    found = resample.weight_disagreement(rated(spark, sf_dir), resample.dirichlet_weights(spark, NAMES), NAMES)
    return found.select(F.round("rate", 6).alias("rate"), "pairs")


def _paraphrased() -> str:
    """CTEs that end in told(key, answer, text): each rule replaces its first match, with its capital."""
    steps, last = [], "answers_"
    for i, (old, new) in enumerate(perturb.SYNONYMS):
        steps.append(rf"""para_{i} as (select key, answer, regexp_replace(text, '(?i)\b{old}\b', case when regexp_matches(regexp_extract(text, '(?i)\b{old}\b'), '^[A-Z]') then '{new[0].upper() + new[1:]}' else '{new}' end) as text from {last})""")
        last = f"para_{i}"
    opened = f"'In other words, ' || lower(left({S.strip('answer')}, 1)) || substr({S.strip('answer')}, 2)"
    return "answers_ as (select key, answer, answer as text from edited), " + ", ".join(steps) + f", told as (select key, case when text = answer then {opened} else text end as text from {last} where {S.strip('answer')} <> '')"


_CLOSED = rf"(regexp_replace(answer, '\s+$', '') || case when regexp_matches(regexp_replace(answer, '\s+$', ''), '[.!?]$') then '' else '.' end)"
def _names(x: str) -> str:
    return rf"list_distinct(regexp_extract_all({x}, '\b({perturb.NAME})\b', 1))"



def _digest(edit: str, name: str) -> str:
    return f"md5('{edit}|' || seed || '|' || key || '|' || {name})"


def _drawn(edit: str, below: str, what: str = "") -> str:
    return f"(cast('0x' || left({_digest(edit, chr(39) + what + chr(39))}, 8) as bigint) % ({below}))"


def _values(pairs) -> str:
    return ", ".join("(" + ", ".join("'" + x + "'" for x in (p if isinstance(p, tuple) else (p,))) + ")" for p in pairs)


#: Passages that a question's padding is chosen from.
DISTRACTORS = 8
EDITED = rf"""{HITS},
lists as (select h.qid, list(p.text order by rank) as passages from hits h join passages p using (passage_id) group by h.qid),
ring as (select passage_id, row_number() over (order by md5('0|' || passage_id), passage_id) - 1 as p from passages), ring_size as (select count(*) as n from passages),
ring_from as (select qid, coalesce(r, 0) as r, cast('0x' || left(md5('1|' || qid), 8) as bigint) % n as s, n from (select distinct qid from talk) left join (select qid, count(distinct passage_id) as r from hits group by qid) using (qid), ring_size),
ring_want as (select qid, i, (s + i) % n as p from (select *, unnest(range(0, least({DISTRACTORS} + r, n))) as i from ring_from)),
ring_free as (select w.qid, i, ring.passage_id from ring_want w join ring using (p) where (w.qid, ring.passage_id) not in (select qid, passage_id from hits)),
ring_best as (select *, row_number() over (partition by qid order by i) as place from ring_free),
pool_texts as (select distinct text from passages where passage_id in (select passage_id from ring_best where place <= {DISTRACTORS})), {S.sentence_ctes('pool_s', 'pool_texts', 'text', 'text')},
pool as (select qid, list({{'t': text, 's': case when len(sentences) > 0 then sentences[1] else {S.strip('text')} end}}) as pool from ring_best join passages using (passage_id) join pool_s using (text) where place <= {DISTRACTORS} group by qid),
edited as (select cast(talk.qid as varchar) as key, coalesce(answer, '') as answer, coalesce(passages, []) as passages,
  list_distinct(list_transform(list_filter(coalesce(pool, []), lambda x: not list_contains(coalesce(passages, []), x.t)), lambda x: x.s)) as others from talk left join lists using (qid) left join pool using (qid)),
each as (select *, unnest([0, 1, 2]) as seed from edited),
named as (select key, seed, answer, {_names('answer')} as own, {_names("array_to_string(passages, chr(10))")} as other from each),
swaps as (select key, seed, answer, a, b from (select *, unnest(other) as b from (select *, unnest(own) as a from named)) where not contains(lower(a), lower(b)) and not contains(lower(b), lower(a))),
swapped as (select key, seed, answer, min_by({{'a': a, 'b': b}}, {_digest('entity_swap', "a || '|' || b")}) as c from swaps group by all),
pieces as (select key, seed, string_split(regexp_replace({S.esc('answer')}, '({perturb.NUMBER})', chr(1) || '\1' || chr(1), 'g'), chr(1)) as p from each),
places as (select *, range(1, len(p), 2) as spots from pieces),
numbers as (select key, seed, p, spots[cast({_drawn('number_corruption', 'len(spots)', 'place')} as integer) + 1] as i from places where len(spots) > 0),
parts as (select *, p[i + 1] as old, case when length(p[i + 1]) <= {perturb.NUMBER_CHARS} then cast(left(replace(p[i + 1], '.', ''), 15) as hugeint) end as n, case when contains(p[i + 1], '.') then length(p[i + 1]) - position('.' in p[i + 1]) else 0 end as d,
  {_drawn('number_corruption', '4', 'factor')} as how, {_drawn('number_corruption', '949', 'zero')} as zero, replace(p[i + 1], '.', '') as digits from numbers),
scaled as (select *, case when n is not null then cast(power(10, d) as hugeint) end as unit, case how when 0 then n * 10 when 1 then n * 100 when 2 then (n + 5) // 10 else (n + 50) // 100 end as m,
  case when regexp_full_match(digits, '0+') then (50 + zero) || repeat('0', d) when how = 0 then digits || '0' when how = 1 then digits || '00' when how = 2 then left(digits, length(digits) - 1) else left(digits, length(digits) - 2) end as raw from parts),
jumped as (select *, case when n = 0 then (50 + zero) * unit when abs(m - n) < 2 * unit then n + (50 + {_drawn('number_corruption', '450', 'jump')}) * unit else m end as new,
  case when length(raw) > d then raw else lpad(raw, cast(d + 1 as integer), '0') end as long from scaled),
shown as (select key, seed, p, i, case when n is null then regexp_replace(left(long, length(long) - d), '^0+([0-9])', '\1') || case when d > 0 then '.' || right(long, d) else '' end
  else cast(new // unit as varchar) || case when d > 0 then '.' || lpad(cast(new % unit as varchar), cast(d as integer), '0') else '' end end as new from jumped),
reversals(phrase, new) as (values {_values(perturb.REVERSALS)}),
reversed as (select key, seed, answer, min_by({{'p': phrase, 'n': new}}, {_digest('negation', "phrase || '|' || new")}) as c from each, reversals where regexp_matches(answer, '(?i)\b' || phrase || '\b') group by all),
stock as (select [{", ".join("'" + x + "'" for x in perturb.UNSUPPORTED)}] as s),
{_paraphrased()},
{S.sentence_ctes('said', 'each', 'key, seed, answer', 'answer')},
again as (select key, seed, answer, sentences[cast({_drawn('duplication', 'len(sentences)')} as integer) + 1] as s from said where len(sentences) > 0),
far as (select key, seed, answer, min_by(o, {_digest('off_topic_padding', 'o')}) as o from (select key, seed, answer, unnest(case when len(others) > 0 then others else passages end) as o from each) where {S.strip('o')} <> '' and {S.strip('answer')} <> '' group by all),
{S.sentence_ctes('off', 'far', 'key, seed, answer, o', 'o')},
made as (
  select key, 'original' as operator, cast(null as bigint) as seed, answer as text from edited
  union all select key, 'entity_swap', seed, regexp_replace(answer, '\b\Q' || c.a || '\E\b', c.b) from swapped
  union all select key, 'number_corruption', seed, array_to_string(list_transform(p, lambda x, j: case when j = i + 1 then new else {S.unesc('x')} end), '') from shown
  union all select key, 'negation', seed, regexp_replace(answer, '(?i)\b' || c.p || '\b', c.n) from reversed
  union all select key, 'unsupported_addition', seed, {_CLOSED} || ' ' || s[cast({_drawn('unsupported_addition', str(len(perturb.UNSUPPORTED)))} as integer) + 1] from each, stock where {S.strip('answer')} <> ''
  union all select told.key, 'paraphrase', seed, told.text from told join each using (key)
  union all select key, 'duplication', seed, case when instr(answer, s) > 0 then substr(answer, 1, instr(answer, s) + length(s) - 1) || ' ' || substr(answer, instr(answer, s)) else {_CLOSED} || ' ' || s end from again
  union all select key, 'off_topic_padding', seed, {_CLOSED} || ' ' || {S.strip("case when len(sentences) > 0 then sentences[1] else " + S.strip('o') + " end")} from off)"""


@query(f"with {EDITED} select key as qid, operator, seed, text, operator in ('entity_swap', 'number_corruption', 'negation', 'unsupported_addition') as hallucinated from made")
def perturbations(spark, sf_dir):
    """Every edit of every recorded answer, with retrieved passages; what is padded comes from first
    sentences of passages that weren't retrieved, drawn from the whole corpus for each question."""
    p, _, t, hits = setting(spark, sf_dir)
    lists = hits.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "passage"))).alias("p"))
    free = stored(irmetrics.random_negatives(t.select("qid").distinct(), p, hits.select("qid", "passage_id"), DISTRACTORS, key="passage_id"), "free")
    texts = p.join(small(free.select("passage_id").distinct()), "passage_id", "left_semi").select("passage_id", F.struct("text", answer.T.first_sentence(F.col("text")).alias("s")).alias("x"))
    pools = free.join(texts, "passage_id").groupBy("qid").agg(F.collect_list("x").alias("pool"))
    passages = F.coalesce("p.passage", F.array().cast("array<string>"))
    unlike = lambda own: F.array_distinct(F.transform(F.filter("pool", lambda x: ~F.array_contains(own, x["text"])), lambda x: x["s"]))
    others = F.coalesce(answer.T.let(passages, unlike), F.array().cast("array<string>"))
    rows = t.join(lists, "qid", "left").join(pools, "qid", "left").select("qid", "answer", passages.alias("passages"), others.alias("distractors"))
    return perturb.apply_all(rows)


DECLINED = answer.DECLINED
ROUNDS = sql_rounds.iterated(f"{PASSAGES}, {S.TALK}", "select qid, question from talk", declined=DECLINED)


def _rounds(spark, sf_dir):
    p = passages_of(spark, sf_dir).select("passage_id", "text")
    v, t = dense.hash_counts(p, "passage_id", "text"), talk(spark, sf_dir)
    return agentic.iterate(p, v, t.select("qid", "question"), CONFIG)


@query(f"with {ROUNDS} select qid, round, query, round(top_similarity, 6) as top_similarity, n_passages, round(trust, 6) as trust, abstained, stop_reason, calls from rounds")
def agentic_rounds(spark, sf_dir):
    return _rounds(spark, sf_dir)[0].withColumn("top_similarity", F.round("top_similarity", 6)).withColumn("trust", F.round("trust", 6))


@query(f"with {ROUNDS} select qid, best_round, round(best_trust, 6) as best_trust, abstained, answer, cast(calls as bigint) as calls from results")
def agentic_results(spark, sf_dir):
    return _rounds(spark, sf_dir)[1].select("qid", "best_round", F.round("best_trust", 6).alias("best_trust"), "abstained", "answer", "calls")


#: Benchmark items as questions: those that a document holds can be answered, the others can't.
ASKED = "select item_id as qid, text as question from benchmark"
RECORDS = f"""{sql_rounds.iterated(PASSAGES, ASKED, declined=DECLINED)}, answerables as (select distinct item_id as qid from benchmark b join documents d on contains(d.text, b.text)),
arms as (select 'single' as arm, qid, abstained, trust, case when top_similarity >= 0.75 then 1 else 0 end as calls from row1 union all select 'iterative', qid, abstained, best_trust, calls from results
  union all select 'routed', r.qid, case when top_similarity < 0.75 then true when top_similarity >= 0.9 then r.abstained else x.abstained end, case when top_similarity < 0.75 then 0 when top_similarity >= 0.9 then r.trust else best_trust end,
    case when top_similarity < 0.75 then 0 when top_similarity >= 0.9 then 1 else x.calls end from row1 r join results x on x.qid = r.qid),
records as (select arm, qid, qid in (select qid from answerables) as answerable, abstained, trust, calls from arms)"""


def arms(spark, sf_dir):
    p = stored(passages_of(spark, sf_dir).select("passage_id", "text"), "passages")
    v = stored(dense.hash_counts(p, "passage_id", "text"), "vectors")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    held = judge.containing(table(spark, sf_dir, "documents"), items, qtext="question").select("qid").distinct().withColumn("held", F.lit(True))
    asked = stored(items.join(held, "qid", "left").select("qid", "question", F.coalesce("held", F.lit(False)).alias("answerable")), "asked")
    return stored(ablation.records(p, v, asked, CONFIG), "arms")


@query(f"with {RECORDS} select arm, qid, answerable, abstained, round(trust, 6) as trust, cast(calls as bigint) as calls from records")
def arm_records(spark, sf_dir):
    """Every benchmark item by each of the three arms."""
    return arms(spark, sf_dir).withColumn("trust", F.round("trust", 6))


@query(f"""with {RECORDS} select arm, count(*) as n, round(avg(case when answerable then case when abstained then 0.0 else 1 end end), 6) as answered_rate, round(avg(case when not answerable then case when abstained then 1.0 else 0 end end), 6) as abstention_rate,
  round(avg(case when abstained then case when answerable then 0.0 else 1 end end), 6) as abstention_precision, round(avg(case when not abstained then trust end), 6) as mean_trust, round(avg(calls), 6) as mean_calls,
  round(avg(case when answerable then case when abstained then 0.0 else 1 end end) + avg(case when not answerable then case when abstained then 1.0 else 0 end end) - 1, 6) as youden_j from records group by arm""")
def arm_comparison(spark, sf_dir):
    names = ("answered_rate", "abstention_rate", "abstention_precision", "mean_trust", "mean_calls", "youden_j")
    return arm_metrics(arms(spark, sf_dir)).select("arm", "n", *(F.round(c, 6).alias(c) for c in names))


@query(f"""with {RECORDS}, p as (select case when answerable then 'in_corpus' else 'out_of_corpus' end as class, answerable, trust, case when answerable then not abstained else abstained end as ok from records where arm = 'single')
select class || '_pass_rate' as metric, round(avg(case when ok then 1.0 else 0 end), 6) as value from p group by class union all
select 'overall_pass_rate', round(avg(case when ok then 1.0 else 0 end), 6) from p union all select 'mean_geometric_trust', round(avg(trust), 6) from p where answerable""")
def golden_pass_rates(spark, sf_dir):
    one = arms(spark, sf_dir).filter("arm = 'single'")
    yes = F.col("answerable")
    cases = one.select(F.when(yes, "in_corpus").otherwise("out_of_corpus").alias("class"), F.when(yes, "answer").otherwise("abstain").alias("expect"), "abstained", F.col("trust").alias("trust_geometric"))
    return pass_rates(cases).select("metric", F.round("value", 6).alias("value"))


def _rates(arm: str) -> str:
    return f"""select case when answerable then 'in_corpus' else 'out_of_corpus' end || '_pass_rate' as metric, avg(case when abstained <> answerable then 1.0 else 0 end) as value from records where arm = '{arm}' group by 1
  union all select 'overall_pass_rate', avg(case when abstained <> answerable then 1.0 else 0 end) from records where arm = '{arm}' union all select 'mean_geometric_trust', avg(trust) from records where arm = '{arm}' and answerable"""


@query(f"""with {RECORDS}, c as ({_rates('single')}), b as ({_rates('iterative')})
select metric, round(b.value, 6) as baseline, round(c.value, 6) as current, round(c.value - b.value, 6) as delta,
  case when c.value is null or b.value is null then '--' when metric = 'mean_geometric_trust' then (case when c.value - b.value >= -0.05 then 'PASS' else 'FAIL' end)
  else (case when c.value >= b.value then 'PASS' else 'FAIL' end) end as verdict from c full outer join b using (metric)""")
def baseline_compare(spark, sf_dir):
    """Answering once against answering in rounds, as a change is held against a baseline."""
    found = arms(spark, sf_dir)
    yes = F.col("answerable")
    cases = found.select("arm", F.when(yes, "in_corpus").otherwise("out_of_corpus").alias("class"), F.when(yes, "answer").otherwise("abstain").alias("expect"), "abstained", F.col("trust").alias("trust_geometric"))
    now, then = (pass_rates(cases.filter(F.col("arm") == x)) for x in ("single", "iterative"))
    return reshape.compare(now, then).select("metric", *(F.round(c, 6).alias(c) for c in ("baseline", "current", "delta")), "verdict")


@query(f"""with {RECORDS}, paired as (select a.answerable, a.abstained as xa, b.abstained as xb, a.calls as ca, b.calls as cb from records a join records b on a.qid = b.qid where a.arm = 'iterative' and b.arm = 'single'),
points as (select avg(case when answerable then (case when xb then 1.0 else 0 end) - (case when xa then 1.0 else 0 end) end) as a, avg(case when not answerable then (case when xa then 1.0 else 0 end) - (case when xb then 1.0 else 0 end) end) as d,
  avg(case when xa then case when answerable then 0.0 else 1 end end) - avg(case when xb then case when answerable then 0.0 else 1 end end) as p, avg(ca - cb) as c from paired)
select unnest(['answered_rate', 'abstention_rate', 'youden_j', 'abstention_precision', 'mean_calls']) as statistic, round(unnest([a, d, a + d, p, c]), 6) as point from points""")
def arm_differences(spark, sf_dir):
    """Of answering in rounds against once, the points alone; arm_intervals has their intervals."""
    return _differences(spark, sf_dir).select("statistic", F.round("point", 6).alias("point"))


def _differences(spark, sf_dir):
    return ablation.differences(arms(spark, sf_dir), "iterative")


_BIT = "(case when {} then 1.0 else 0 end)::double".format
_MEAN = "select '{0}' as statistic, r, sum(d) / count(*) as value from {1} group by r".format


@query(f"""with {RECORDS}, paired as (select a.answerable, a.abstained as xa, b.abstained as xb, a.calls as ca, b.calls as cb from records a join records b on a.qid = b.qid where a.arm = 'iterative' and b.arm = 'single'),
gain as (select {_BIT('not xa')} - {_BIT('not xb')} as d, 0 as half from paired where answerable union all select {_BIT('xa')} - {_BIT('xb')}, 1 from paired where not answerable),
sent as (select (ca - cb)::double as d from paired), held as (select d from gain where half = 0), kept as (select d from gain where half = 1),
quads as (select {_BIT('not answerable')} * {_BIT('xa')} as px, {_BIT('xa')} as x1, {_BIT('not answerable')} * {_BIT('xb')} as py, {_BIT('xb')} as y1 from paired),
{Z.replicates()}, {Z.drawn('h', 'held', 'd')}, {Z.drawn('k', 'kept', 'd')}, {Z.drawn('j', 'gain', 'd', 'half')}, {Z.drawn('q', 'quads', 'px, x1, py, y1')}, {Z.drawn('t', 'sent', 'd')},
halves as (select r, s, sum(d) / count(*) as m from j group by r, s),
v as ({_MEAN('answered_rate', 'h')} union all {_MEAN('abstention_rate', 'k')} union all {_MEAN('mean_calls', 't')}
  union all select 'youden_j', r, sum(m) from halves group by r union all select 'abstention_precision', r, sum(px) / nullif(sum(x1), 0) - sum(py) / nullif(sum(y1), 0) from q group by r)
{Z.interval('v', 'statistic, ')} group by statistic""")
def arm_intervals(spark, sf_dir):
    """arm_differences with bootstrap intervals of 10,000 replicates."""
    return _differences(spark, sf_dir).select("statistic", *(F.round(c, 6).alias(c) for c in ("point", "ci_lo", "ci_hi")))
