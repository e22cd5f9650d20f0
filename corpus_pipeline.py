"""The corpus pipeline: language ID, quality, near-duplicates, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Rejected are:
documents without any letter (language ID), documents whose posterior of being good is under one
half (quality), all but the smallest doc_id of each near-duplicate group, and what the mixture
doesn't take; a document that the mixture takes twice occurs twice.

`run` writes a stage's result before the next stage begins, and removes then what the stage kept in the
shared folder on its way, and the result of the stage before.

Cases, of all stages: a null doc_id is a document of its own, a null text an empty one (which the
language stage drops), a null lang teaches nothing, a null source is a source of its own; equal rows
are one document from the near-duplicate stage on, and so are rows of one doc_id, of which a
defined one stays (the one of the least digest); long texts are read whole; an empty table
gives an empty table; other columns, whatever their names, pass through up to the last stage.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import langid, mixing, near_dedup, quality, sentencepiece_codec
from plumbline.llm.common import made_so_far, remove, stored, table, taken

#: Rows up to which the ids of dropped documents are broadcast.
BROADCAST_DROPPED = 1_000_000
#: Documents of this similarity or more, in percent, are near-duplicates; op8 alone asks for 85.
NEAR = 80


def stage(step):
    """A stage whose result names, as `_on_its_way`, the tables that it is read from. They go when `run`
    has written the result, or with the session."""

    @wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        mark = made_so_far()
        out = step(spark, docs, sf_dir)
        out._on_its_way = taken(mark)
        return out

    return run_step


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told, as they hold no letter. What was told takes the place of
    `lang`, which the next stage reads; where it is ambiguous, of a null lang alone. Without a labelled
    document there is no model, and the letter alone decides."""
    model = langid.fit(docs, ~langid.held_out())
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    told = langid.identify(docs, model).filter("lang_pred <> 'und'")
    lang = F.when(F.col("lang_ambiguous") & F.col("lang").isNotNull(), F.col("lang")).otherwise(F.col("lang_pred"))
    return told.withColumn("lang", lang).select(docs.columns)


@stage
def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are more likely bad than good."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality.posterior(docs, labels, F.col("source"), F.col("lang")).filter("keep").select(docs.columns)


@stage
def once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each near-duplicate group."""
    found = stored(spark, near_dedup.near_duplicates(docs, percent=NEAR), "near")
    dropped = found.filter("not kept").select("doc_id").distinct()
    few = dropped.count() <= BROADCAST_DROPPED
    left = docs.join(F.broadcast(dropped) if few else dropped, "doc_id", "left_anti")
    repeated = found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    n = repeated.count()
    if n:  # rows of one doc_id are one document
        some = F.broadcast(repeated) if n <= BROADCAST_DROPPED else repeated
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        one = left.join(some, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.xxhash64(row)).alias("row"))
        left = left.join(some, "doc_id", "left_anti").select(docs.columns).unionByName(one.select("row.*"))
    return left.select(docs.columns)


@stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mixture of sources does."""
    mixed = mixing.mix_sources(docs, F.col("source")).filter("copies > 0")
    return mixed.withColumn("copies", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(docs.columns)


@stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids, and the digests of ids and of their decoded text."""
    model = sentencepiece_codec.model_bytes(public_tokenizers.path("piece_bpe_32k.model"))
    encoded = sentencepiece_codec.encode_decode(docs.select("doc_id", "source", "text"), model)
    return sentencepiece_codec.digests(encoded, "source", "ids")


STAGES = [
    ("language ID", language),
    ("quality classifier", good),
    ("MinHash near-dedup", once),
    ("mixing sources to target weights", mixture),
    ("SentencePiece encoding and decoding", tokens),
]

#: SQL can't express the stages; tests/llm/test_pipeline.py holds them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages in turn; each reads what its predecessor wrote."""
    docs, written = table(spark, sf_dir, "documents"), []
    for i, (_, step) in enumerate(STAGES):
        found = step(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return found
        mark = made_so_far()
        docs = stored(spark, found, f"stage-{i}")
        remove(spark, found._on_its_way + written)
        written = taken(mark)
    return docs
