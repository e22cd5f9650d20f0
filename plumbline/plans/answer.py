"""Answering a table of questions: retrieve, gate, generate, measure, aggregate, decline."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.config import Config
from plumbline.functions import text as T
from plumbline.operators import dense, fusion, inverted, sparse, trust
from plumbline.operators.sparse import small
from plumbline.plans.models import Models, extractive, lexical_pair_score
from plumbline.sources.shared import stored

#: Ids of passages up to which they go along with the scan of the texts; beyond, all texts are shuffled.
HIT_IDS = 2_000_000


class Stages:
    """Milliseconds that the stages of a batch of answers took, each until its table was written."""

    def __init__(self) -> None:
        self.took: list[tuple[str, float]] = []

    def keep(self, df: DataFrame, stage: str) -> DataFrame:
        began = time.perf_counter()
        out = stored(df, stage)
        self.took.append((stage, 1000 * (time.perf_counter() - began)))
        return out

    def told(self) -> list[dict]:
        return [{"stage": s, "ms": round(ms, 3)} for s, ms in self.took]

    def column(self) -> Column:
        """For traces: the stages as an array of (stage, ms)."""
        kind = "array<struct<stage:string,ms:double>>"
        return F.array(*(F.struct(F.lit(s).alias("stage"), F.lit(float(ms)).alias("ms")) for s, ms in self.took)).cast(kind)


DECLINED = "Not answerable from this corpus."
__all__ = ["DECLINED", "extractive", "lexical_pair_score"]


def retrieve(passages: DataFrame, vectors: DataFrame, questions: DataFrame, qvectors: DataFrame, config: Config, k: int | None = None, scorer: Callable[[DataFrame], Column] | None = None, index: inverted.Index | None = None) -> DataFrame:
    """qid, passage_id, score, rank by the configured mode, reranked if a pair scorer is given.

    passages: passage_id, text; vectors: passage_id, vec; questions: qid, question. With an inverted
    index, the sparse leg reads no texts.
    """
    k = k or config.k
    ask = config.rerank_candidates if config.rerank else k
    deep = fusion.depth(ask) if config.retrieval_mode == "hybrid" else ask
    asked = questions.select("qid", F.col("question").alias("qtext"))
    if config.retrieval_mode != "sparse":
        d = dense.search(vectors, qvectors, deep, key="passage_id")
    if config.retrieval_mode != "dense":
        s = sparse.search(passages, asked, deep, key="passage_id") if index is None else inverted.search(index, asked, deep)
    hits = {"dense": lambda: d, "sparse": lambda: s, "hybrid": lambda: fusion.rrf(d, s, ask, key="passage_id")}[config.retrieval_mode]()
    if not config.rerank:
        return hits
    pairs = hit_rows(hits, passages.select("passage_id", "text")).join(asked, "qid")
    score = lexical_pair_score() if scorer is None else scorer(pairs)
    return fusion.rerank(pairs, score, k).select("qid", "passage_id", F.col("rerank_score").alias("score"), "rank")


def hit_rows(hits: DataFrame, *tables: DataFrame) -> DataFrame:
    """hits joined to tables by passage_id (the first must have the passage). Few hits name the rows before
    anything moves, so of the tables what is hit alone is shuffled."""
    ids = hits.select("passage_id").distinct()
    marked = small(ids, HIT_IDS)
    out = hits
    for i, t in enumerate(tables):
        out = out.join(t.join(marked, "passage_id", "left_semi"), "passage_id", "left" if i else "inner")
    return out


def own_citations(answers: DataFrame) -> DataFrame:
    """What the extractive generator cites: the top passage, for its one claim."""
    return answers.select("qid", F.lit(0).alias("claim_idx"), F.lit(1).alias("cited_rank"))


def citations_of(answers: DataFrame) -> DataFrame:
    """qid, claim_idx, cited_rank (from 1), as the text's marks say."""
    each = answers.select("qid", F.explode(T.citations(F.col("answer"))).alias("c"))
    return each.select("qid", F.col("c.claim").alias("claim_idx"), (F.col("c.passage") + 1).alias("cited_rank"))


def gated(questions: DataFrame, hits: DataFrame, config: Config) -> DataFrame:
    """qid, context_relevance, top_similarity, passed: the gate that comes before generation."""
    found = trust.relevance(questions, hits)
    return found.withColumn("passed", F.col("top_similarity") >= config.retrieval_gate)


def measure(questions: DataFrame, hits: DataFrame, answers: DataFrame, config: Config, generated: DataFrame | None = None, citations: DataFrame | None = None, gate: DataFrame | None = None, models: Models | None = None, stages: Stages | None = None) -> DataFrame:
    """One wide row of metrics, aggregates and verdicts a question; null is undefined.

    questions: qid, question, qvec; hits: qid, rank, passage, vec; answers: qid, answer. The
    entailment of all claims and passages is computed once and feeds both metrics that need it.
    Citations are parsed from the answers unless they are given; `gate` is what `gated` found.

    Questions that the retrieval gate declines have no claims compared; of their metrics relevance
    alone is defined. Of those that the support gate declines, it is faithfulness and the
    contradiction rate. top_similarity and best_support tell what the gates saw.
    """
    models = models or Models()
    gate = stored(gated(questions, hits, config), "gate") if gate is None else gate
    passed = gate.filter("passed").select("qid")
    live, answers = questions.join(passed, "qid", "left_semi"), answers.join(passed, "qid", "left_semi")
    claims = answers.select("qid", F.posexplode(T.sentences(F.col("answer"))).alias("claim_idx", "claim"))
    claims = claims if stages is None else stages.keep(claims, "decompose")
    nli = models.nli.matrix(claims, hits.join(passed, "qid", "left_semi"))
    nli = nli if stages is None else stages.keep(nli, "entail")
    support = trust.claim_support(nli)
    vectors = models.embedder.embed(claims.select(F.struct("qid", "claim_idx").alias("id"), "claim"), "id", "claim")
    vectors = vectors.select("id.qid", "id.claim_idx", "vec")
    faith = trust.faithfulness(live, support)
    attr = trust.attribution(live, support, nli, citations_of(answers) if citations is None else citations.join(passed, "qid", "left_semi"), config.support_threshold)
    short = trust.conciseness(live, vectors)
    out = gate.drop("passed").withColumnRenamed("context_relevance", "relevance")
    for part in (faith, attr.withColumnRenamed("f1", "attribution"), short):
        out = out.join(part, "qid", "left")
    if generated is not None:
        out = out.join(trust.answer_relevance(live, generated), "qid", "left")
    scores = trust.aggregates(out, config.weights)
    out = out.join(scores, "qid").withColumn("reason", trust.gates(F.col("top_similarity"), F.col("best_support"), config.retrieval_gate, config.abstain_threshold))
    declined, unsupported = F.col("reason").isNotNull(), F.col("best_support") < config.abstain_threshold
    zero = lambda c: F.when(declined, F.lit(0.0)).otherwise(F.col(c)).alias(c)
    hidden = {"relevance": unsupported} | dict.fromkeys(("attribution", "precision", "recall", "conciseness", "answer_relevance"), declined)
    kept = [F.when(~F.coalesce(hidden[c], F.lit(False)), F.col(c)).alias(c) if c in hidden else F.col(c) for c in out.columns if c not in ("t_arith", "t_geom", "reason")]
    out = out.select(*kept, zero("t_arith"), zero("t_geom"), declined.alias("abstained"), F.col("reason").alias("abstain_reason"))
    return out.withColumn("is_trustworthy", trust.trustworthy(F.col("abstained"), F.col("t_geom")))


def answer_all(
    passages: DataFrame, vectors: DataFrame, questions: DataFrame, config: Config | None = None, answers: DataFrame | None = None, models: Models | None = None, index: inverted.Index | None = None, stages: Stages | None = None
) -> DataFrame:
    """Answers and measures a table of questions (qid, question); `answers` (qid, answer) are
    recorded ones, otherwise the models' generator writes them, for questions that pass the gate.
    `stages` is told how long retrieving, the gate, generating, decomposing, entailment and scoring took."""
    config, models = config or Config(), models or Models()
    keep = stored if stages is None else stages.keep
    qvec = models.embedder.embed(questions, "qid", "question")
    asked = questions.join(qvec.withColumnRenamed("vec", "qvec"), "qid", "left")
    hits = retrieve(passages, vectors, questions, qvec, config, scorer=models.scorer, index=index)
    hits = keep(hits, "retrieve")
    texts = passages.select("passage_id", F.coalesce("source_text", "text").alias("passage") if "source_text" in passages.columns else F.col("text").alias("passage"))
    full = stored(hit_rows(hits, texts, vectors).join(questions, "qid"), "hits")
    gate = keep(gated(asked, full, config), "gate")
    made = models.generator.generate(full.join(gate.filter("passed").select("qid"), "qid", "left_semi")) if answers is None else answers
    made = made if stages is None else stages.keep(made, "generate")
    cited = own_citations(made) if answers is None and models.generator.cites_first else None
    generated = models.back_questions(made, config) if config.answer_relevance else None
    out = measure(asked, full, made.select("qid", "answer"), config, generated, cited, gate, models, stages).join(made.select("qid", "answer"), "qid", "left")
    out = out.withColumn("answer", F.when(F.col("abstained"), F.lit(DECLINED)).otherwise(F.col("answer")))
    return out if stages is None else stages.keep(out, "score")
