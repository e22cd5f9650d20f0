"""The models that answering uses, and what stands in their place by default.

An embedder, a judge of entailment, a scorer of pairs and a generator are objects with a name and a
method from DataFrame to DataFrame (or Column). The defaults are deterministic and lexical. A hosted
or local model enters as a plain function over lists, which tasks call in Arrow batches
(`FunctionEmbedder`, `FunctionNli`, `FunctionScorer`, `FunctionGenerator`); results that were
computed before enter as tables (`LookupEmbedder`, `RecordedGenerator`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from plumbline.config import Config
from plumbline.functions import text as T
from plumbline.operators import dense, trust

#: What a judge of entailment tells apart.
LABELS = ("entailment", "neutral", "contradiction")


class Embedder(Protocol):
    name: str

    def embed(self, rows: DataFrame, key: str, text: str) -> DataFrame:
        """key, vec; texts that can't be embedded have no row."""


class Nli(Protocol):
    def matrix(self, claims: DataFrame, hits: DataFrame) -> DataFrame:
        """qid, claim_idx, rank, entailment, neutral, contradiction."""


class Generator(Protocol):
    #: Whether each answer's first claim cites the first passage, without marks in the text.
    cites_first: bool

    def generate(self, hits: DataFrame, again: Column | None = None) -> DataFrame:
        """qid, answer, from hits (qid, question, rank, passage); again: not the question's first time."""


def text_key(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


class HashEmbedder:
    name = "hash-64"

    def embed(self, rows: DataFrame, key: str, text: str) -> DataFrame:
        return dense.hash_counts(rows, key, text)


@dataclass
class FunctionEmbedder:
    """fn maps a list of texts to a matrix; vectors get length 1 unless `unit` is off."""

    name: str
    fn: Callable[[list[str]], np.ndarray]
    unit: bool = True

    def embed(self, rows: DataFrame, key: str, text: str) -> DataFrame:
        fn, unit = self.fn, self.unit
        slim = rows.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text is not null")
        schema = T_.StructType([T_.StructField(key, slim.schema["key"].dataType), T_.StructField("vec", T_.ArrayType(T_.DoubleType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                m = np.asarray(fn(batch.column("text").to_pylist()), np.float64).reshape(batch.num_rows, -1)
                if unit:
                    m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
                offsets = pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.ListArray.from_arrays(offsets, pa.array(m.ravel()))], names=[key, "vec"])

        return slim.mapInArrow(run, schema)


@dataclass
class LookupEmbedder:
    """Vectors that were computed before: a table (text_key, vec), as `text_key` makes the key. A
    text without one goes to `otherwise`, or is an error."""

    name: str
    table: DataFrame
    otherwise: Embedder | None = None

    def embed(self, rows: DataFrame, key: str, text: str) -> DataFrame:
        known = self.table.select("text_key", "vec").dropDuplicates(["text_key"])
        asked = rows.select(F.col(key).alias(key), F.col(text).alias("_text"), text_key(F.col(text)).alias("text_key"))
        found = asked.join(known, "text_key", "left")
        if self.otherwise is None:
            missing = F.raise_error(F.concat(F.lit("no vector is stored for: "), F.left(F.coalesce("_text", F.lit("")), F.lit(80)))).cast("array<double>")
            return found.select(key, F.coalesce("vec", missing).alias("vec"))
        new = self.otherwise.embed(found.filter("vec is null").select(key, "_text"), key, "_text")
        return found.filter("vec is not null").select(key, "vec").unionByName(new.select(key, "vec"))


class LexicalNli:
    def matrix(self, claims: DataFrame, hits: DataFrame) -> DataFrame:
        return trust.nli_matrix(claims, hits)


@dataclass
class FunctionNli:
    """fn maps lists of premises and hypotheses to a matrix with one column for each of `labels`, in
    the model's own order; names decide, whatever their case, so no order is taken for granted."""

    fn: Callable[[list[str], list[str]], np.ndarray]
    labels: tuple[str, ...] = LABELS

    def __post_init__(self) -> None:
        low = [x.lower() for x in self.labels]
        if sorted(low) != sorted(LABELS):
            raise ValueError(f"a judge of entailment has the labels {', '.join(LABELS)}, not {', '.join(self.labels)}")
        self.order = [low.index(x) for x in LABELS]

    def matrix(self, claims: DataFrame, hits: DataFrame) -> DataFrame:
        fn, order = self.fn, self.order
        pairs = claims.select("qid", "claim_idx", "claim").join(hits.select("qid", "rank", "passage"), "qid")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = np.asarray(fn(batch["passage"].fillna("").tolist(), batch["claim"].fillna("").tolist()), float).reshape(len(batch), len(LABELS))
                yield batch[["qid", "claim_idx", "rank"]].assign(**{x: found[:, i] for x, i in zip(LABELS, order, strict=True)})

        kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
        return pairs.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in ("qid", "claim_idx", "rank")) + "".join(f", {x} double" for x in LABELS))


def lexical_pair_score(question: str = "qtext", text: str = "text") -> Column:
    """A model-free pair score: the share of the question's words that the passage has."""
    return shared_words(T.word_set(F.col(question)), T.word_set(F.col(text)))


def shared_words(q: Column, p: Column) -> Column:
    """The share of q's words that p has, of two sets of words."""
    return F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(q, p)).cast("double"), F.size(q).cast("double")), F.lit(0.0)), 9)


@dataclass
class FunctionScorer:
    """A scorer of pairs (a column of qtext and text) from a function over lists of both."""

    fn: Callable[[list[str], list[str]], np.ndarray]

    def __call__(self, pairs: DataFrame) -> Column:
        fn = self.fn

        @F.pandas_udf("double")
        def score(q: pd.Series, t: pd.Series) -> pd.Series:
            return pd.Series(np.asarray(fn(q.fillna("").tolist(), t.fillna("").tolist()), float))

        return score("qtext", "text")


def extractive(hits: DataFrame, seen_before: Column | None = None) -> DataFrame:
    """qid, answer: the first sentence of the top passage, citing it. For a third of questions, by
    hash, and only when first asked, the last passage is quoted instead, so the citation is wrong.

    hits: qid, question, rank, passage.
    """
    found = hits.groupBy("qid", "question").agg(F.min_by("passage", "rank").alias("first"), F.max_by("passage", "rank").alias("last"), F.count(F.lit(1)).alias("n"))
    # a number leaves the remainder of the sum of its hexadecimal digits, as 16 leaves 1
    digits = F.split(F.sha1(F.col("question").cast("binary")), "")
    by_three = F.aggregate(digits, F.lit(0), lambda s, d: s + F.coalesce(F.conv(F.nullif(d, F.lit("")), 16, 10).cast("int"), F.lit(0))) % 3
    again = F.lit(False) if seen_before is None else seen_before
    weak = (by_three == 1) & (F.col("n") >= 2) & ~again
    quoted = T.first_sentence(F.when(weak, F.col("last")).otherwise(F.col("first")))
    return found.select("qid", F.concat(quoted, F.lit(" [1]")).alias("answer"))


class ExtractiveGenerator:
    cites_first = True

    def generate(self, hits: DataFrame, again: Column | None = None) -> DataFrame:
        return extractive(hits, again)


@dataclass
class RecordedGenerator:
    """Answers that were written before (question, text); other questions go to `otherwise`, or are
    an error."""

    answers: DataFrame
    otherwise: Generator | None = None
    cites_first = False

    def generate(self, hits: DataFrame, again: Column | None = None) -> DataFrame:
        known = self.answers.select("question", "text").dropDuplicates(["question"])
        asked = hits.select("qid", "question").distinct().join(known, "question", "left")
        if self.otherwise is None:
            missing = F.raise_error(F.concat(F.lit("no answer is recorded for: "), "question")).cast("string")
            return asked.select("qid", F.coalesce("text", missing).alias("answer"))
        rest = hits.join(asked.filter("text is null").select("qid"), "qid", "left_semi")
        return asked.filter("text is not null").select("qid", F.col("text").alias("answer")).unionByName(self.otherwise.generate(rest, again))


@dataclass
class FunctionGenerator:
    """fn(question, passages) writes an answer; ask(answer, n), if given, writes questions back."""

    fn: Callable[[str, list[str]], str]
    ask: Callable[[str, int], list[str]] | None = None
    cites_first = False

    def generate(self, hits: DataFrame, again: Column | None = None) -> DataFrame:
        fn = self.fn

        @F.pandas_udf("string")
        def write(question: pd.Series, passages: pd.Series) -> pd.Series:
            return pd.Series([fn(q, list(p)) for q, p in zip(question, passages, strict=True)])

        lists = hits.groupBy("qid", "question").agg(F.sort_array(F.collect_list(F.struct("rank", "passage"))).alias("p"))  # k passages
        return lists.select("qid", write("question", F.col("p.passage")).alias("answer"))

    def questions(self, answers: DataFrame, n: int) -> DataFrame | None:
        """qid, question: at most n a row; an answer for which asking fails has none."""
        ask = self.ask
        if ask is None:
            return None

        @F.pandas_udf("array<string>")
        def back(answer: pd.Series) -> pd.Series:
            return pd.Series([_attempt(lambda a=a: list(ask(a, n))[:n]) or [] for a in answer])

        return answers.select("qid", F.explode(back("answer")).alias("question"))


def _attempt(call: Callable):
    """What a call returns; None where the model fails, which must not fail an answer."""
    try:
        return call()
    except Exception:
        return None


@dataclass
class FunctionReformulator:
    """A reformulation of queries by fn; null where it fails, which ends a question's rounds."""

    fn: Callable[[str], str]

    def __call__(self, query: Column) -> Column:
        fn = self.fn

        @F.pandas_udf("string")
        def again(q: pd.Series) -> pd.Series:
            return pd.Series([_attempt(lambda x=x: fn(x)) for x in q], dtype=object)

        return again(query)


EMBEDDERS: dict[str, Callable[[], Embedder]] = {"hash-64": HashEmbedder}
GENERATORS: dict[str, Callable[[], Generator]] = {"extractive": ExtractiveGenerator}
JUDGES: dict[str, Callable[[], Nli]] = {"lexical": LexicalNli}


def make(registry: dict, name: str):
    """The registered model of a name."""
    if name not in registry:
        raise ValueError(f"unknown model {name}; known: {', '.join(sorted(registry))}")
    return registry[name]()


@dataclass
class Models:
    embedder: Embedder = field(default_factory=HashEmbedder)
    nli: Nli = field(default_factory=LexicalNli)
    generator: Generator = field(default_factory=ExtractiveGenerator)
    scorer: Callable[[DataFrame], Column] | None = None

    def back_questions(self, answers: DataFrame, config: Config) -> DataFrame | None:
        """qid, vec of questions written back from answers; None where the generator can't."""
        ask = getattr(self.generator, "questions", None)
        asked = ask(answers, config.n_questions) if callable(ask) else None
        if asked is None:
            return None
        keyed = asked.select(F.struct("qid", "question").alias("id"), "question")
        return self.embedder.embed(keyed, "id", "question").select("id.qid", "vec")
