"""Queries over scores and labels: curves, thresholds, percentiles, resampling, reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import resample, reshape
from plumbline.operators import stats as D
from plumbline.operators.sparse import small
from plumbline.plans import sql as S
from plumbline.plans import sql_draws as Z
from plumbline.plans.queries_text import table

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def scored(spark, sf_dir):
    """doc_id, lang, score, label, toxic."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.round(F.col("n_chars") / (F.col("n_chars") + 2000.0), 6).alias("score"))
    return d.join(table(spark, sf_dir, "labels").withColumnRenamed("quality", "label"), "doc_id")


def r6(*columns):
    return [F.round(c, 6).alias(c) for c in columns]


def auc_cte(by: str = "", source: str = "scored") -> str:
    """a(by, n_pos, n_neg, auc)."""
    part, keys = (f"partition by {by}", f"{by},") if by else ("", "")
    return f"""ranked as (select {keys} label, rank() over ({part} order by score) + (count(*) over ({part + ',' if by else 'partition by '} score) - 1) / 2.0 as r from {source}),
a as (select {keys} sum(case when label = 1 then 1 else 0 end) as n_pos, sum(case when label <> 1 then 1 else 0 end) as n_neg,
  (sum(case when label = 1 then r end) - sum(case when label = 1 then 1 else 0 end) * (sum(case when label = 1 then 1 else 0 end) + 1) / 2.0)
  / (sum(case when label = 1 then 1 else 0 end) * sum(case when label <> 1 then 1 else 0 end)) as auc from ranked {'group by ' + by if by else ''})""".replace("(partition by lang, score)", "(partition by lang, score)").replace("partition by lang,, score", "partition by lang, score")


TALLY = f"{S.SCORED}, t as (select score, sum(case when label = 1 then 1 else 0 end) as pos, sum(case when label <> 1 then 1 else 0 end) as neg from scored group by score)"
TOTAL = "n as (select sum(pos) as n_pos, sum(neg) as n_neg from t)"
UNIT = "grid as (select i * 0.01::double as tau from range(101) r(i))"
GATE = "grid as (select round(i * 0.01::double, 10) as tau from range(61) r(i))"
SWEEP = f"""{TALLY}, {UNIT}, c as (select tau, sum(case when score >= tau then pos else 0 end) as tp, sum(case when score >= tau then neg else 0 end) as fp,
  sum(case when score < tau then pos else 0 end) as fn, sum(case when score < tau then neg else 0 end) as tn from t, grid group by tau),
pr as (select *, case when tp + fp = 0 then 0 else tp / (tp + fp) end as p, case when tp + fn = 0 then 0 else tp / (tp + fn) end as r from c),
rates as (select *, case when p + r = 0 then 0 else 2 * p * r / (p + r) end as f1, (tp + tn) / (tp + fp + fn + tn) as accuracy from pr)"""


@query(f"with {S.SCORED}, {auc_cte()} select n_pos, n_neg, round(auc, 6) as auc from a")
def roc_auc(spark, sf_dir):
    return D.roc_auc(scored(spark, sf_dir)).select("n_pos", "n_neg", *r6("auc"))


@query(f"with {S.SCORED}, {auc_cte('lang')} select lang, n_pos, n_neg, round(auc, 6) as auc from a")
def auc_by_group(spark, sf_dir):
    return D.roc_auc(scored(spark, sf_dir), ("lang",)).select("lang", "n_pos", "n_neg", *r6("auc"))


@query(f"with {S.SCORED}, {auc_cte('lang')} select lang, case when auc >= 0.5 or isnan(auc) then 1 else -1 end as sign from a")
def best_sign(spark, sf_dir):
    return D.roc_auc(scored(spark, sf_dir), ("lang",)).select("lang", D.best_sign(F.col("auc")).alias("sign"))


@query(f"""with {TALLY}, {TOTAL}, w as (select score, sum(neg) over (order by score desc) as fp, sum(pos) over (order by score desc) as tp from t)
select round(score, 6) as threshold, round(fp / n_neg, 6) as fpr, round(tp / n_pos, 6) as tpr from w, n union all select round(max(score) + 1, 6), 0, 0 from t""")
def roc_curve(spark, sf_dir):
    return D.roc_curve(scored(spark, sf_dir)).select(*r6("threshold", "fpr", "tpr"))


@query(f"with {TALLY}, {TOTAL}, w as (select pos, sum(pos) over (order by score desc) / sum(pos + neg) over (order by score desc) as p from t) select round(sum(p * pos / n_pos), 6) as ap from w, n")
def pr_auc(spark, sf_dir):
    return D.pr_auc(scored(spark, sf_dir)).select(*r6("ap"))


@query(f"with {SWEEP} select tp, fp, fn, tn, round(p, 6) as precision, round(r, 6) as recall, round(f1, 6) as f1, round(accuracy, 6) as accuracy from rates where tau = 0.5")
def confusion_at_tau(spark, sf_dir):
    rows = scored(spark, sf_dir)
    grid = spark.createDataFrame([(0.5,)], "tau double")
    return D.rates(D.sweep(rows, grid)).select("tp", "fp", "fn", "tn", *r6("precision", "recall", "f1", "accuracy"))


def _swept(spark, sf_dir, by=()):
    rows = scored(spark, sf_dir)
    return D.rates(D.sweep(rows, D.unit_grid(rows), by))


@query(f"with {SWEEP} select round(tau, 6) as tau, tp, fp, fn, tn, round(p, 6) as precision, round(r, 6) as recall, round(f1, 6) as f1, round(accuracy, 6) as accuracy from rates")
def threshold_sweep(spark, sf_dir):
    return _swept(spark, sf_dir).select(*r6("tau"), "tp", "fp", "fn", "tn", *r6("precision", "recall", "f1", "accuracy"))


@query(f"with {SWEEP} select round(tau, 6) as tau, round(f1, 6) as f1 from rates order by rates.f1 desc, abs(rates.tau - 0.5), rates.tau limit 1")
def best_tau_f1(spark, sf_dir):
    return D.best_tau_by_f1(_swept(spark, sf_dir)).select(*r6("tau", "f1"))


@query(f"with {SWEEP}, j as (select tau, tp / greatest(tp + fn, 1) as tpr, fp / greatest(fp + tn, 1) as fpr from c) select round(tau, 6) as tau, round(tpr - fpr, 6) as j, round(tpr, 6) as tpr, round(fpr, 6) as fpr from j order by j.tpr - j.fpr desc, j.tau limit 1")
def youden_j(spark, sf_dir):
    return D.youden(_swept(spark, sf_dir)).select(*r6("tau", "j", "tpr", "fpr"))


@query(f"with {S.SCORED}, p as (select sum(label) / greatest(count(*), 1) as p from scored) select round(p, 6) as precision, 1.0::double as recall, round(2 * p / (p + 1), 6) as f1 from p")
def degenerate_f1(spark, sf_dir):
    return D.degenerate_f1(scored(spark, sf_dir)).select(*r6("precision", "recall", "f1"))


RETENTION = f"{S.SCORED}, {GATE}, rate as (select tau, lang, avg(case when score >= tau then 1.0 else 0 end) as rate from scored, grid group by all)"


@query(f"with {RETENTION} select round(tau, 6) as tau, lang, round(rate, 6) as rate, lang = 'en' as is_positive from rate")
def retention_far_sweep(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return D.retention_sweep(rows, D.gate_grid(rows), "lang", "en").select(*r6("tau"), "lang", *r6("rate"), "is_positive")


@query(f"with {RETENTION} select round(coalesce(max(case when rate >= 0.9 then tau end), min(tau)), 6) as tau from rate where lang = 'en'")
def recommended_threshold(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return D.recommended_threshold(D.retention_sweep(rows, D.gate_grid(rows), "lang", "en").filter("is_positive"), 0.9).select(*r6("tau"))


@query(f"""with {S.SCORED}, {UNIT}, c as (select lang, tau, sum(case when score >= tau and label = 1 then 1 else 0 end) as tp, sum(case when score >= tau and label <> 1 then 1 else 0 end) as fp,
  sum(case when score < tau and label = 1 then 1 else 0 end) as fn from scored, grid group by all),
f as (select lang, tau, case when 2 * tp + fp + fn = 0 or tp = 0 then 0 else 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) end as f1 from c),
b as (select lang, tau, f1, row_number() over (partition by lang order by f1 desc, abs(tau - 0.5), tau) as n from f)
select x.lang as source, y.lang as target, round(x.tau, 6) as tau, round(y.f1, 6) as f1 from b x join f y on y.tau = x.tau where x.n = 1""")
def tau_transfer(spark, sf_dir):
    swept = _swept(spark, sf_dir, ("lang",))
    best = D.best_tau_by_f1(swept, ("lang",)).select(F.col("lang").alias("source"), "tau")
    return small(best).join(swept.select(F.col("lang").alias("target"), "tau", "f1"), "tau").select("source", "target", *r6("tau", "f1"))


_P = (0.05, 0.25, 0.5, 0.75, 0.95)


@query("select event_type, " + ", ".join(f"round(quantile_cont(value, {p}), 6) as p{round(p * 100):02d}" for p in _P) + " from events group by event_type")
def percentile_linear(spark, sf_dir):
    names = {f"p{round(p * 100):02d}": D.linear(p) for p in _P}
    return D.order_statistics(table(spark, sf_dir, "events"), F.col("value"), names, ("event_type",)).select("event_type", *r6(*names))


@query("select event_type, round(quantile_disc(value, 0.5), 6) as p50, round(quantile_disc(value, 0.95), 6) as p95 from events group by event_type")
def percentile_nearest_rank(spark, sf_dir):
    names = {"p50": D.nearest(0.5), "p95": D.nearest(0.95)}
    return D.order_statistics(table(spark, sf_dir, "events"), F.col("value"), names, ("event_type",)).select("event_type", *r6(*names))


@query(f"with {S.SCORED} select label, count(*) as n, round(avg(score), 6) as mean, round(min(score), 6) as least, round(max(score), 6) as most, round(quantile_cont(score, 0.5), 6) as p50 from scored group by label")
def score_distribution(spark, sf_dir):
    rows = scored(spark, sf_dir)
    middle = D.order_statistics(rows, F.col("score"), {"p50": D.linear(0.5)}, ("label",)).select("label", *r6("p50"))
    found = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *(F.round(f("score"), 6).alias(n) for n, f in (("mean", F.avg), ("least", F.min), ("most", F.max))))
    return found.join(small(middle), "label")


@query("""with x as (select label, cast(unnest(embedding) as double) as v from embeddings)
select label, count(*) as n, round(avg(case when v < 0 then 1.0 else 0 end), 6) as negative, round(avg(greatest(0, v)), 6) as clamped, round(avg((1 + v) / 2), 6) as affine from x group by label""")
def clamp_vs_affine(spark, sf_dir):
    """All components of all embeddings, as they would be if clamped at 0, or mapped from -1..1 to 0..1."""
    each = table(spark, sf_dir, "embeddings").select("label", F.explode("embedding").alias("v"))
    v = F.col("v").cast("double")
    return each.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((v < 0).cast("double")), 6).alias("negative"), F.round(F.avg(F.greatest(F.lit(0.0), v)), 6).alias("clamped"), F.round(F.avg((1 + v) / 2), 6).alias("affine")
    )


_SIGNED = "shifted as (select label, unnest(['raw', 'affine', 'clamped']) as mapping, unnest([s, (1 + s) / 2, greatest(0, s)]) as score from (select label, round(2 * score - 1, 6) as s from scored))"


@query(f"with {S.SCORED}, {_SIGNED}, {auc_cte('mapping', 'shifted').replace('partition by lang', 'partition by mapping')} select mapping, round(auc, 6) as auc from a")
def mapping_auc(spark, sf_dir):
    """The AUC of signed scores, mapped affinely, which changes no rank, and clamped, which ties the negative ones."""
    s = F.round(2 * F.col("score") - 1, 6)
    kinds = F.array(*(F.struct(F.lit(n).alias("mapping"), x.alias("score")) for n, x in (("raw", s), ("affine", (1 + s) / 2), ("clamped", F.greatest(F.lit(0.0), s)))))
    each = scored(spark, sf_dir).select("label", F.explode(kinds).alias("k")).select("label", "k.mapping", "k.score")
    return D.roc_auc(each, ("mapping",)).select("mapping", *r6("auc"))


@query("select quality, toxic, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from labels group by quality, toxic")
def class_balance(spark, sf_dir):
    from pyspark.sql import Window

    counts = table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query(f"with {S.SCORED} select cast(least(floor((score - 0) / (1.0::double / 20)) + 1, 20) as integer) as bin, count(*) as n from scored where score between 0 and 1 group by 1")
def score_histogram(spark, sf_dir):
    return D.histogram(scored(spark, sf_dir), "score", 0.0, 1.0, 20)


@query("""select user_id, round(max(case when event_type = 'view' then value end), 6) as view, round(max(case when event_type = 'click' then value end), 6) as click,
  round(max(case when event_type = 'purchase' then value end), 6) as purchase from (select user_id, event_type, max(value) as value from events group by all) group by user_id""")
def pivot_long_to_wide(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("value"))
    return reshape.pivot(e, ("user_id",), "event_type", "value", ("view", "click", "purchase")).select("user_id", *r6("view", "click", "purchase"))


@query("""with s as (select *, row_number() over (partition by event_type order by md5(cast(event_id as varchar)), event_id) as n from events),
g as (select event_type, row_number() over (order by event_type) as i from (select distinct event_type from events)),
q as (select event_type, 103 // (select count(*) from g) + case when i <= 103 % (select count(*) from g) then 1 else 0 end as quota from g)
select event_type, event_id from s join q using (event_type) where n <= quota""")
def stratified_quota(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("o", F.struct(F.md5(F.col("event_id").cast("string").cast("binary")), "event_id"))
    return reshape.stratified(e, "event_type", 103, F.col("o")).select("event_type", "event_id")


@query(rf"""with {S.sentence_ctes('s', 'documents', 'doc_id', 'text')},
e as (select doc_id, i - 1 as sentence, sentences[i] || case i % 4 when 0 then '' when 1 then ' [1]' when 2 then ' [2, 7]' else ' [9]' end as text, case i % 5 when 0 then null else i % 2 end as label from (select doc_id, sentences, unnest(range(1, len(sentences) + 1)) as i from s)),
r as (select case when label is null then 'no label' when regexp_matches(text, '\[[12](, 7)?\]') then 'kept' when regexp_matches(text, '\[[0-9]') then 'dangling citation' else 'no citation' end as reason from e)
select reason, count(*) as n from r group by reason""")
def nested_unnest_counts(spark, sf_dir):
    from plumbline.functions import text as T

    mark = lambda i: F.when(i % 4 == 3, "").when(i % 4 == 0, " [1]").when(i % 4 == 1, " [2, 7]").otherwise(" [9]")
    label = lambda i: F.when(i % 5 == 4, F.lit(None).cast("int")).otherwise((i + 1) % 2)
    sents = F.transform(T.sentences(F.col("text")), lambda s, i: F.struct(i.alias("index"), F.concat(s, mark(i)).alias("text"), label(i).alias("attributable")))
    quotes = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit("q").alias("text")) for i in (1, 2, 3)])
    nested = table(spark, sf_dir, "documents").select("doc_id", F.array(F.struct(sents.alias("sentences"))).alias("answers"), quotes.alias("quotes"))
    out = reshape.unnest(nested, "doc_id", "answers", "quotes")
    return out.groupBy(F.coalesce("dropped", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


INTERVAL = ("point", "ci_lo", "ci_hi")
LABELLED = f"{S.SCORED}, labelled as (select *, label = 1 as pos, label::double as y from scored where score is not null and label is not null), {Z.replicates()}"


@query(f"with {LABELLED}, {Z.drawn('d', 'labelled', 'score', 'case when pos then 0 else 1 end')}, {Z.auc('v', 'd', 'r', 'score', 'pos')} {Z.interval('v')}")
def bootstrap_ci(spark, sf_dir):
    return resample.bootstrap_auc(scored(spark, sf_dir)).select(*r6(*INTERVAL))


@query(f"""with {LABELLED}, diffs as (select score - y as d from labelled),
{Z.drawn('a', 'labelled', 'score')}, {Z.drawn('b', 'diffs', 'd')}, {Z.drawn('c', 'labelled', 'score, y')},
v as (select 'mean' as statistic, r, sum(score) / count(*) as value from a group by r union all select 'difference', r, sum(d) / count(*) from b group by r union all select 'ratio', r, sum(score) / nullif(sum(y), 0) from c group by r)
{Z.interval('v', 'statistic, ')} group by statistic""")
def bootstrap_means(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("y", F.col("label").cast("double"))
    parts = [resample.bootstrap_mean(rows, "score"), resample.bootstrap_paired_difference(rows, "score", "y"), resample.bootstrap_ratio(rows, "score", "y")]
    names = ("mean", "difference", "ratio")
    out = None
    for name, part in zip(names, parts, strict=True):
        part = part.select(F.lit(name).alias("statistic"), *r6(*INTERVAL))
        out = part if out is None else out.unionByName(part)
    return out


P_VALUE = """reals as (select value as real from x where r = -1)
select round(any_value(real), 6) as difference, round((count(*) filter (isnan(value) or abs(value) >= abs(real) - 1e-12) + 1) / 10001.0::double, 6) as p from x, reals where r >= 0"""


@query(f"""with {LABELLED}, duo as (select score as x, 1 - score as y2, pos from labelled), {Z.coins('c', 'duo', 'x, pos, y2')},
sides as (select r, 'a' as side, case when swap then y2 else x end as v, pos from c union all select r, 'b', case when swap then x else y2 end, pos from c), {Z.auc('u', 'sides', 'r, side', 'v', 'pos')},
x as (select r, max(value) filter (side = 'a') - max(value) filter (side = 'b') as value from u group by r), {P_VALUE}""")
def paired_permutation(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("other", 1 - F.col("score"))
    return resample.permutation_test(rows, "score", "other", "label").select(*r6("difference", "p"))


@query(f"""with {LABELLED}, duo as (select score, label, toxic from labelled where toxic is not null), {Z.coins('c', 'duo', 'score, label, toxic')},
sides as (select r, 'a' as side, score, case when swap then toxic else label end = 1 as pos from c union all select r, 'b', score, case when swap then label else toxic end = 1 from c), {Z.auc('u', 'sides', 'r, side', 'score', 'pos')},
x as (select r, max(value) filter (side = 'a') - max(value) filter (side = 'b') as value from u group by r), {P_VALUE}""")
def label_permutation(spark, sf_dir):
    return resample.label_permutation_test(scored(spark, sf_dir), "score", "label", "toxic").select(*r6("difference", "p"))


#: A baseline that knows of a text the share of its digits alone.
_BASE = "round(len(regexp_extract_all(coalesce(text, ''), '[0-9]')) / (length(coalesce(text, '')) + 1.0::double), 6)"
_GROUPED = f"""grouped as (select lang, round(n_chars / (n_chars + 2000.0), 6) as score, {_BASE} as base, quality = 1 as pos from documents join labels using (doc_id) where quality is not null and n_chars is not null),
{Z.replicates()}, {Z.drawn('d', 'grouped', 'score', 'case when pos then 0 else 1 end', 'lang')}, {Z.auc('v', 'd', 'r, lang', 'score', 'pos')},
sure as ({Z.interval('v', 'lang, ')} group by lang), {Z.auc('g', 'grouped', 'lang', 'base', 'pos')},
turned as (select lang, score, base * case when value < 0.5 then -1 else 1 end as base, pos from grouped join g using (lang)), {Z.coins('c', 'turned', 'score, pos, base', 'lang')},
sides as (select r, lang, 'a' as side, case when swap then base else score end as v, pos from c union all select r, lang, 'b', case when swap then score else base end, pos from c), {Z.auc('u', 'sides', 'r, lang, side', 'v', 'pos')},
x as (select r, lang, max(value) filter (side = 'a') - max(value) filter (side = 'b') as value from u group by r, lang),
tested as (select x.lang, any_value(real) as difference, (count(*) filter (isnan(x.value) or abs(x.value) >= abs(real) - 1e-12) + 1) / 10001.0::double as p from x join (select lang, value as real from x where r = -1) using (lang) where r >= 0 group by x.lang),
sizes as (select lang, count(*) filter (pos) as n_pos, count(*) filter (not pos) as n_neg from grouped group by lang)"""


@query(f"""with {_GROUPED} select lang, n_pos, n_neg, point as auc, ci_lo, ci_hi, round(case when value < 0.5 then 1 - value else value end, 6) as baseline_auc, round(difference, 6) as difference, round(p, 6) as p
from sizes join sure using (lang) join g using (lang) join tested using (lang)""")
def grouped_validation(spark, sf_dir):
    """One row a group: the score's AUC with its interval, and its test against a baseline of best sign."""
    d = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    base = F.round(F.regexp_count(text, F.lit("[0-9]")) / (F.length(text) + 1.0), 6)
    rows = d.select("doc_id", "lang", F.round(F.col("n_chars") / (F.col("n_chars") + 2000.0), 6).alias("score"), base.alias("base")).join(table(spark, sf_dir, "labels"), "doc_id")
    out = resample.validation(rows, ("lang",), "score", "base", "quality")
    return out.select("lang", "n_pos", "n_neg", *r6("auc", "ci_lo", "ci_hi", "baseline_auc", "difference", "p"))


@query("select source, question_class, count(*) as n from (select source, lang as question_class from documents) group by all")
def class_tallies(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source", F.col("lang").alias("question_class")).agg(F.count(F.lit(1)).alias("n"))
