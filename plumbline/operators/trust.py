"""Entailment, faithfulness, attribution, relevance, conciseness, aggregates and gates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import dense
from plumbline.operators.sparse import small
from plumbline.sources.shared import stored


def entailment(a: Column, b: Column) -> Column:
    """Jaccard similarity of two word sets; 0 where both are empty."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(0.0))


def _all_three(pairs: DataFrame, e: Column) -> DataFrame:
    out = pairs.withColumn("entailment", e)
    return out.withColumn("neutral", (1 - F.col("entailment")) / 2).withColumn("contradiction", (1 - F.col("entailment")) / 2)


def nli_matrix(claims: DataFrame, hits: DataFrame, qid: str = "qid", text: str = "passage") -> DataFrame:
    """qid, claim_idx, rank, entailment, neutral, contradiction: computed once for all metrics.

    Word sets are made before the join, once a text, not once a pair.
    """
    a = hits.select(qid, "rank", T.word_set(F.col(text)).alias("premise"))
    b = claims.select(qid, "claim_idx", T.word_set(F.col("claim")).alias("hypothesis"))
    pairs = _all_three(b.join(a, qid), entailment(F.col("premise"), F.col("hypothesis")))
    return pairs.select(qid, "claim_idx", "rank", "entailment", "neutral", "contradiction")


def claim_support(nli: DataFrame, qid: str = "qid") -> DataFrame:
    """qid, claim_idx, support (most entailment), support_rank (its first rank), opposed."""
    return nli.groupBy(qid, "claim_idx").agg(
        F.max("entailment").alias("support"),
        F.min_by("rank", F.struct(-F.col("entailment"), F.col("rank"))).alias("support_rank"),
        F.max("contradiction").alias("opposed"),
    )


def faithfulness(questions: DataFrame, support: DataFrame, qid: str = "qid") -> DataFrame:
    """qid, faithfulness, contradiction_rate, best_support: 0 where there is no claim or passage."""
    found = support.groupBy(qid).agg(F.avg("support").alias("f"), F.avg("opposed").alias("c"), F.max("support").alias("m"))
    out = questions.select(qid).join(found, qid, "left")
    return out.select(qid, *(F.coalesce(a, F.lit(0.0)).alias(b) for a, b in (("f", "faithfulness"), ("c", "contradiction_rate"), ("m", "best_support"))))


def attribution(questions: DataFrame, support: DataFrame, nli: DataFrame, citations: DataFrame, tau: float = 0.5, qid: str = "qid") -> DataFrame:
    """qid, precision, recall, f1. A cited passage is right where it entails the claim (>= tau);
    without citations precision is 1, without supported claims recall is 1."""
    cell = nli.select(qid, "claim_idx", "rank", "entailment")
    cited = citations.select(qid, "claim_idx", "cited_rank").join(cell.withColumnRenamed("rank", "cited_rank"), [qid, "claim_idx", "cited_rank"], "left")
    p = cited.groupBy(qid).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("entailment") >= tau).alias("right"))
    owners = citations.select(qid, "claim_idx").distinct().withColumn("has", F.lit(True))
    r = support.filter(F.col("support") >= tau).join(owners, [qid, "claim_idx"], "left")
    r = r.groupBy(qid).agg(F.count(F.lit(1)).alias("supported"), F.count_if("has").alias("covered"))
    both = questions.select(qid).join(p, qid, "left").join(r, qid, "left")
    precision = F.coalesce(F.try_divide(F.col("right"), F.col("n")), F.lit(1.0))
    recall = F.coalesce(F.try_divide(F.col("covered"), F.col("supported")), F.lit(1.0))
    out = both.select(qid, precision.alias("precision"), recall.alias("recall"))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return out.withColumn("f1", f1)


def relevance(questions: DataFrame, hits: DataFrame, scaled: bool = True, qid: str = "qid", qvec: str = "qvec", vec: str = "vec") -> DataFrame:
    """qid, context_relevance (mean cosine), top_similarity (the gate's statistic); 0 without hits."""
    cos = dense.cosine(F.col(qvec), F.col(vec))
    each = questions.select(qid, qvec).join(hits.select(qid, vec), qid).select(qid, cos.alias("cos"))
    up = F.greatest(F.lit(0.0), F.col("cos"))
    found = each.groupBy(qid).agg(F.avg(up if scaled else F.col("cos")).alias("r"), F.max(up).alias("m"))
    out = questions.select(qid).join(found, qid, "left")
    return out.select(qid, F.coalesce("r", F.lit(0.0)).alias("context_relevance"), F.coalesce("m", F.lit(0.0)).alias("top_similarity"))


def answer_relevance(questions: DataFrame, generated: DataFrame, qid: str = "qid") -> DataFrame:
    """qid, answer_relevance: mean plain cosine to generated questions; null without any."""
    each = questions.select(qid, "qvec").join(generated.select(qid, F.col("vec").alias("gvec")), qid)
    found = each.groupBy(qid).agg(F.avg(dense.cosine(F.col("qvec"), F.col("gvec"))).alias("answer_relevance"))
    return questions.select(qid).join(found, qid, "left")


#: Claims of an answer up to which its pairs are joined; claims of a block of a longer one.
PAIRED, BLOCK_CLAIMS = 200, 1000


def conciseness(questions: DataFrame, claim_vectors: DataFrame, qid: str = "qid") -> DataFrame:
    """qid, conciseness: 1 less the mean positive cosine of claim pairs; null under two claims.

    The claims of a long answer are dealt to blocks, and each two blocks, as matrices, to a task: its
    pairs are summed where they are made.
    """
    vectors = stored(claim_vectors.select(qid, "claim_idx", "vec"), "claims")
    sizes = vectors.groupBy(qid).agg(F.ceil(F.count(F.lit(1)) / BLOCK_CLAIMS).alias("blocks"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > PAIRED)
    sizes = stored(sizes.select(qid, "blocks"), "long")
    some_long = not sizes.isEmpty()
    short = vectors.join(small(sizes.select(qid)), qid, "left_anti") if some_long else vectors
    a = short.select(qid, F.col("claim_idx").alias("i"), F.col("vec").alias("a"))
    b = short.select(qid, F.col("claim_idx").alias("j"), F.col("vec").alias("b"))
    pairs = a.join(b, qid).filter("i < j").select(qid, F.greatest(F.lit(0.0), dense.cosine(F.col("a"), F.col("b"))).alias("cos"))
    found = pairs.groupBy(qid).agg((1 - F.avg("cos")).alias("conciseness"))
    if some_long:
        found = found.unionByName(_long_answers(vectors.join(small(sizes), qid), qid))
    return questions.select(qid).join(found, qid, "left")


def _long_answers(claims: DataFrame, qid: str) -> DataFrame:
    """qid, conciseness, of claims with the blocks of their answer."""
    dealt = claims.withColumn("block", F.pmod(F.xxhash64("claim_idx"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tiles = dealt.select(qid, F.least("block", "other").alias("row"), F.greatest("block", "other").alias("col"), "block", "vec")

    def gram(table: pa.Table) -> pa.Table:
        x = np.array(table.column("vec").to_pylist(), float).reshape(table.num_rows, -1)
        x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)
        left = table.column("block").to_numpy() == table.column("row")[0].as_py()
        own = table.column("row")[0] == table.column("col")[0]
        y, z = (x, x) if own else (x[left], x[~left])
        total = np.maximum(y @ z.T, 0).sum()
        n, cos = (len(x) * (len(x) - 1) // 2, (total - np.maximum((x * x).sum(axis=1), 0).sum()) / 2) if own else (len(y) * len(z), total)
        return pa.table({qid: table.column(qid)[:1], "cos": [float(cos)], "n": [n]})

    kind = claims.schema[qid].dataType.simpleString()
    sums = tiles.groupBy(qid, "row", "col").applyInArrow(gram, f"`{qid}` {kind}, cos double, n long").groupBy(qid).agg(F.sum("cos").alias("cos"), F.sum("n").alias("n"))
    return sums.select(qid, (1 - F.try_divide("cos", "n")).alias("conciseness"))


def aggregates(metrics: DataFrame, weights: dict, qid: str = "qid") -> DataFrame:
    """qid, t_arith, t_geom over the metrics that are defined, weights made to sum to 1 among them.

    metrics: one wide row a question; null is undefined. A zero makes the geometric one zero; a
    negative value is an error there, and so is a weight that isn't positive.
    """
    if any(w <= 0 for w in weights.values()):
        raise ValueError("weights are positive")
    present = {m: w for m, w in weights.items() if m in metrics.columns}
    values = {m: F.col(m) for m in present}
    on = {m: F.when(v.isNotNull(), F.lit(float(present[m]))).otherwise(F.lit(0.0)) for m, v in values.items()}
    total = sum(on.values(), F.lit(0.0))
    arith = sum((on[m] * F.coalesce(v, F.lit(0.0)) for m, v in values.items()), F.lit(0.0))
    logs = sum((on[m] * F.coalesce(F.ln(F.when(v > 0, v)), F.lit(0.0)) for m, v in values.items()), F.lit(0.0))
    least = F.array_min(F.array(*values.values()))
    geom = (
        F.when(least < 0, F.raise_error(F.lit("a negative metric has no geometric aggregate")).cast("double"))
        .when(least == 0, F.lit(0.0))
        .otherwise(F.coalesce(F.exp(F.try_divide(logs, total)), F.lit(0.0)))
    )
    return metrics.select(qid, F.coalesce(F.try_divide(arith, total), F.lit(0.0)).alias("t_arith"), geom.alias("t_geom"))


def gates(top_similarity: Column, best_support: Column, gate: float = 0.30, threshold: float = 0.5) -> Column:
    """Why a question is declined; null where it is answered."""
    return (
        F.when(top_similarity < gate, F.format_string(f"retrieval too weak (%.3f < {gate})", top_similarity))
        .when(best_support < threshold, F.format_string(f"support too weak (%.3f < {threshold})", best_support))
    )


def trustworthy(abstained: Column, t_geom: Column) -> Column:
    return ~abstained & (t_geom >= 0.5)


def cited_by(citations: DataFrame, qid: str = "qid") -> DataFrame:
    """qid, cited_rank, claims: the claims, in order, that cite each passage, by its rank."""
    return citations.groupBy(qid, "cited_rank").agg(F.array_sort(F.collect_set("claim_idx")).alias("claims"))


def real_answers(answered: DataFrame) -> DataFrame:
    """Rows that were answered, with text."""
    return answered.filter(~F.col("abstained") & (T.strip(F.coalesce("answer", F.lit(""))) != ""))


def attribution_inputs(rows: DataFrame, answer: str = "answer", reference: str = "reference") -> tuple[DataFrame, DataFrame, DataFrame]:
    """claims, hits and citations of rows (qid, answer, reference): the answer as one claim, which
    cites its one passage. Every row must have both texts, or it corresponds to nothing: an error."""
    both = F.col(answer).isNotNull() & F.col(reference).isNotNull()
    sure = lambda c: F.when(both, F.col(c)).otherwise(F.raise_error(F.concat(F.lit("no answer or reference: "), F.col("qid").cast("string"))).cast("string"))
    claims = rows.select("qid", F.lit(0).alias("claim_idx"), sure(answer).alias("claim"))
    hits = rows.select("qid", F.lit(1).alias("rank"), sure(reference).alias("passage"))
    return claims, hits, rows.select("qid", F.lit(0).alias("claim_idx"), F.lit(1).alias("cited_rank"))
