"""Readers of benchmark files, with explicit schemas."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QRELS = "`query-id` string, `corpus-id` string, score int"
SENTENCE = "struct<index: int, text: string, attributable: int>"


def beir_corpus(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text: title and text as one."""
    rows = spark.read.schema("_id string, title string, text string").parquet(path)
    return rows.select(F.col("_id").alias("doc_id"), F.trim(F.concat_ws(" ", "title", "text")).alias("text"))


def beir_queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("_id string, text string").parquet(path).dropna().select(F.col("_id").alias("qid"), F.col("text").alias("qtext"))


def negative_queries(queries: DataFrame, n: int, seed: int = 0, text: str = "qtext") -> DataFrame:
    """n of the queries with text, by digest: those that another corpus answers."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(text)).cast("binary"))
    return queries.filter(F.col(text).isNotNull()).orderBy(digest, text).limit(max(n, 0))


def presets(recorded: DataFrame, category: str | None = None) -> DataFrame:
    """question, category: what a reader is offered to ask; answers stay where they are."""
    return recorded.select("question", (F.col(category) if category else F.lit(None).cast("string")).alias("category")).dropDuplicates(["question"])


def subset(rows: DataFrame, column: str, values: tuple) -> DataFrame:
    """Rows of some tiers, classes or labels; asking for none is an error."""
    if not values:
        raise ValueError(f"no value of {column} is asked for")
    return rows.filter(F.col(column).isin(*values))


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """qid, doc_id, gain, for positive judgments."""
    rows = spark.read.schema(QRELS).option("header", True).option("sep", "\t").csv(path)
    return rows.filter("score > 0").select(F.col("query-id").alias("qid"), F.col("corpus-id").alias("doc_id"), F.col("score").alias("gain"))


def ragtruth(spark: SparkSession, path: str) -> DataFrame:
    schema = "id string, task_type string, context string, output string, hallucination_labels_processed struct<evident_conflict: int, baseless_info: int>"
    rows = spark.read.schema(schema).parquet(path)
    flag = lambda c: F.coalesce(F.col(f"hallucination_labels_processed.{c}") > 0, F.lit(False))
    out = rows.withColumn("conflict", flag("evident_conflict")).withColumn("baseless", flag("baseless_info"))
    return out.withColumn("hallucinated", F.col("conflict") | F.col("baseless")).withColumn("one_kind", F.col("conflict") != F.col("baseless"))


def attributed(spark: SparkSession, path: str) -> DataFrame:
    from plumbline.operators.reshape import binary_label

    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.select("answer", "reference", "label", binary_label(F.col("label"), ("Attributable",), ("Extrapolatory", "Contradictory")).alias("supported"))


def summaries(spark: SparkSession, path: str) -> DataFrame:
    from plumbline.operators.reshape import binary_label

    schema = "gem_id string, worker_lang string, summary string, model string, question string, answer string"
    rows = spark.read.schema(schema).parquet(path).filter("worker_lang = 'en-US'")
    return rows.withColumn("value", F.when(F.col("answer").isin("Yes", "No"), binary_label(F.col("answer"), ("Yes",), ("No",))))


def cited_sentences(spark: SparkSession, path: str) -> DataFrame:
    schema = f"query_id string, quotes array<struct<idx: int, text: string>>, answers array<struct<sentences: array<{SENTENCE}>>>"
    return spark.read.schema(schema).json(path)


def golden(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("question string, expect string, class string, note string").option("multiLine", True).json(path)


def judgments(spark: SparkSession, path: str) -> DataFrame:
    """question, section, gain."""
    rows = spark.read.schema("grades map<string, map<string, int>>").option("multiLine", True).json(path)
    return rows.select(F.explode("grades").alias("question", "g")).select("question", F.explode("g").alias("section", "gain"))


def answers(spark: SparkSession, path: str) -> DataFrame:
    """question, text, citations of recorded answers: a map from question to a text or a struct."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, string>")).alias("question", "v"))
    got = F.from_json("v", "text string, answer string, citations map<string, int>")
    plain = ~F.startswith(F.ltrim("v"), F.lit("{"))
    out = rows.select("question", F.when(plain, F.col("v")).otherwise(F.coalesce(got["text"], got["answer"])).alias("text"), F.when(~plain, F.transform_keys(got["citations"], lambda k, v: k.cast("int"))).alias("citations"))
    return out


def questions(spark: SparkSession, path: str) -> DataFrame:
    """question: an array of strings or of {question}; anything else is an error."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("qid", "v"))
    named = F.get_json_object("v", "$.question")
    bad = F.raise_error(F.lit("a question is a string or has the field question")).cast("string")
    return rows.select(F.col("qid").cast("long").alias("qid"), F.when(~F.startswith(F.ltrim("v"), F.lit("{")), F.col("v")).otherwise(F.coalesce(named, bad)).alias("question"))


def if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """An earlier result, if it exists; a warning where it doesn't."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.json(path)
    except AnalysisException:
        warnings.warn(f"no earlier result at {path}", stacklevel=2)
        return None
