"""Three ways of answering compared: once, in rounds, or as a route decides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.config import Config
from plumbline.operators import fusion, resample
from plumbline.plans import agentic, answer
from plumbline.plans.models import Models
from plumbline.sources.shared import stored

ARMS = ("single", "iterative", "routed")


def query_set(answerable: DataFrame, tiers: dict[str, DataFrame], n_answerable: int, n_unanswerable: int, seed: int = 0, question: str = "question") -> DataFrame:
    """question, answerable, tier: the n questions of least digest that a corpus answers, and as many as
    asked of others, shared evenly among the tiers. Null and repeated questions of a tier count once or not."""
    def some(rows: DataFrame, n: int, tier: str, yes: bool) -> DataFrame:
        digest = F.md5(F.concat_ws("|", F.lit(str(seed)), "question").cast("binary"))
        drawn = rows.select(F.col(question).alias("question")).dropna().distinct().orderBy(digest, "question").limit(max(n, 0))
        return drawn.select("question", F.lit(yes).alias("answerable"), F.lit(tier).alias("tier"))

    out, names = some(answerable, n_answerable, "corpus", True), sorted(tiers)
    for i, name in enumerate(names):
        share = n_unanswerable // len(names) + (1 if i < n_unanswerable % len(names) else 0)
        out = out.unionByName(some(tiers[name], share, name, False))
    return out


def records(passages: DataFrame, vectors: DataFrame, questions: DataFrame, config: Config | None = None, models: Models | None = None) -> DataFrame:
    """arm, qid, answerable, abstained, trust, calls: each question (qid, question, answerable) by each
    arm. A routed question has the record of the arm that it is sent to, or is declined unasked."""
    config, models = config or Config(), models or Models()
    plain = stored(questions.select("qid", "question"), "asked")
    once = stored(answer.answer_all(passages, vectors, plain, config, models=models), "single")
    _, best = agentic.iterate(passages, vectors, plain, config, models=models)
    single = once.select("qid", "abstained", F.col("t_geom").alias("trust"), F.when(F.col("top_similarity") >= config.retrieval_gate, 1).otherwise(0).cast("long").alias("calls"))
    rounds = best.select("qid", "abstained", F.col("best_trust").alias("trust"), F.col("calls").cast("long").alias("calls"))
    way = once.select("qid", fusion.route(F.col("top_similarity"), config.retrieval_gate, config.route_iterate_margin).alias("way"))
    declined = way.filter("way = 'abstain'").select("qid", F.lit(True).alias("abstained"), F.lit(0.0).alias("trust"), F.lit(0).cast("long").alias("calls"))
    sent = {name: rows.join(way.filter(F.col("way") == name), "qid", "left_semi") for name, rows in (("single", single), ("iterative", rounds))}
    routed = declined.unionByName(sent["single"]).unionByName(sent["iterative"])
    out = None
    for name, rows in zip(ARMS, (single, rounds, routed), strict=True):
        part = rows.withColumn("arm", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.join(questions.select("qid", "answerable"), "qid").select("arm", "qid", "answerable", "abstained", "trust", "calls")


def paired(found: DataFrame, arm: str, base: str = "single") -> DataFrame:
    """qid, answerable, and answered, declined and calls of an arm (a) and of the base (b), of the
    questions that both have."""
    side = lambda name, x: found.filter(F.col("arm") == name).select("qid", "answerable", (~F.col("abstained")).cast("double").alias(f"answered_{x}"), F.col("abstained").cast("double").alias(f"declined_{x}"), F.col("calls").cast("double").alias(f"calls_{x}"))
    return side(arm, "a").join(side(base, "b").drop("answerable"), "qid")


def differences(found: DataFrame, arm: str, base: str = "single", n: int = 10_000, seed: int = 0) -> DataFrame:
    """statistic, point, ci_lo, ci_hi: how an arm differs from the base over the same questions."""
    both = stored(paired(found, arm, base), "paired")
    yes, no = both.filter("answerable"), both.filter("not answerable")
    gain = both.withColumn("d", F.when(F.col("answerable"), F.col("answered_a") - F.col("answered_b")).otherwise(F.col("declined_a") - F.col("declined_b")))
    right = both.withColumn("unanswerable", (~F.col("answerable")).cast("double"))
    parts = {
        "answered_rate": resample.bootstrap_paired_difference(yes, "answered_a", "answered_b", n, seed),
        "abstention_rate": resample.bootstrap_paired_difference(no, "declined_a", "declined_b", n, seed),
        "youden_j": resample.bootstrap_sum_of_means(gain.filter("answerable"), gain.filter("not answerable"), "d", n, seed),
        "abstention_precision": resample.bootstrap_ratio_difference(right, "unanswerable", "declined_a", "declined_b", n, seed),
        "mean_calls": resample.bootstrap_paired_difference(both, "calls_a", "calls_b", n, seed),
    }
    out = None
    for name, part in parts.items():
        part = part.select(F.lit(name).alias("statistic"), "point", "ci_lo", "ci_hi")
        out = part if out is None else out.unionByName(part)
    return out


def verdict(arm: str, found: DataFrame) -> str:
    """In words, from `differences`: quality by Youden's J and cost by calls, always both."""
    rows = {r.statistic: r for r in found.collect()}

    def told(name: str) -> str:
        r = rows[name]
        return f"{r.point:+.3f} [{r.ci_lo:+.3f}, {r.ci_hi:+.3f}]"

    j = rows["youden_j"]
    sure = j.ci_lo == j.ci_lo and j.ci_hi == j.ci_hi and not j.ci_lo <= 0 <= j.ci_hi
    quality = ("HELPS" if j.point > 0 else "HURTS") if sure else "is NOT AN IMPROVEMENT"
    return f"{arm} {quality}: Youden's J {told('youden_j')}; calls a question {told('mean_calls')}."
