"""One object for a corpus: index it, keep it, ask it."""

from __future__ import annotations

import threading
from collections import OrderedDict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.config import Config
from plumbline.operators import fusion, inverted, stats, trust
from plumbline.plans import agentic, answer
from plumbline.plans.models import Models
from plumbline.sources import corpus, store
from plumbline.sources.shared import scratch, stored
from plumbline.streaming import traces

class Engine:
    """Passages and their vectors, with the questions that can be put to them.

    Questions are tables (qid, question), or lists of strings; answers are tables. `models` are what
    embeds, judges, scores and writes; an index is tied to the name of its embedder.
    """

    def __init__(self, spark: SparkSession, config: Config | None = None, models: Models | None = None):
        self.spark, self.config, self.models = spark, config or Config(), models or Models()
        self.passages: DataFrame | None = None
        self.vectors: DataFrame | None = None
        self.index: inverted.Index | None = None

    def _embed(self, rows: DataFrame, key: str, text: str) -> DataFrame:
        return self.models.embedder.embed(rows, key, text)

    def _install(self, passages: DataFrame, vectors: DataFrame | None = None) -> Engine:
        passages = stored(passages, "passages")
        if passages.isEmpty():
            raise ValueError("nothing to index")
        self.passages = passages
        self.vectors = stored(self._embed(passages, "passage_id", "text"), "vectors") if vectors is None else vectors
        if self.config.retrieval_mode != "dense":
            self.index = inverted.keep(inverted.build(passages), scratch(self.spark, "index"))
        return self

    def index_dir(self, path: str, pattern: str = "*", sentences: DataFrame | None = None) -> Engine:
        """All files of a folder; situating sentences (passage_id, sentence) may open the indexed text."""
        c = self.config
        found = corpus.passages(corpus.read_corpus(self.spark, path, pattern), c.chunk_window, c.chunk_stride, c.chunk_min_chars)
        return self._install(found if sentences is None else corpus.contextualised(found, sentences))

    index_corpus = index_dir

    def index_texts(self, texts: DataFrame | list[str], key: str = "passage_id", text: str = "text") -> Engine:
        if isinstance(texts, list):
            texts = self.spark.createDataFrame(list(enumerate(texts)), "passage_id long, text string")
        return self._install(corpus.from_texts(texts, key, text))

    def save(self, path: str) -> None:
        store.save_index(path, self.models.embedder.name, self.config.retrieval_mode, self._ready(), self.vectors if self.config.retrieval_mode != "sparse" else None, self.index)

    def load(self, path: str) -> Engine:
        _, self.passages, vectors = store.load_index(self.spark, path, self.models.embedder.name)
        self.index = store.load_postings(self.spark, path)
        self.vectors = self._embed(self.passages, "passage_id", "text") if vectors is None else vectors
        return self

    def _ready(self) -> DataFrame:
        if self.passages is None:
            raise ValueError("nothing is indexed")
        return self.passages

    def _asked(self, questions: DataFrame | list[str]) -> DataFrame:
        if isinstance(questions, list):
            return self.spark.createDataFrame(list(enumerate(questions)), "qid long, question string")
        return questions.select(F.col("qid").cast("long").alias("qid"), "question")

    def retrieve(self, questions: DataFrame | list[str], k: int | None = None, scorer=None) -> DataFrame:
        """qid, passage_id, score, rank, source, page, passage."""
        asked = self._asked(questions)
        hits = answer.retrieve(self._ready(), self.vectors, asked, self._embed(asked, "qid", "question"), self.config, k, scorer or self.models.scorer, self.index)
        return corpus.shown(hits, self.passages)

    def similarity(self, questions: DataFrame | list[str]) -> DataFrame:
        """qid, top_similarity: the gate's statistic, a cosine in every mode."""
        asked = self._asked(questions)
        qvec = self._embed(asked, "qid", "question").withColumnRenamed("vec", "qvec")
        hits = self.retrieve(asked).join(self._embed(self.passages.select("passage_id", F.col("source_text").alias("t")), "passage_id", "t"), "passage_id")
        return trust.relevance(asked.join(qvec, "qid", "left"), hits).select("qid", "top_similarity")

    def route(self, questions: DataFrame | list[str]) -> DataFrame:
        """qid, top_similarity, route."""
        c = self.config
        return self.similarity(questions).withColumn("route", fusion.route(F.col("top_similarity"), c.retrieval_gate, c.route_iterate_margin))

    def answer(self, questions: DataFrame | list[str], answers: DataFrame | None = None, stages: answer.Stages | None = None) -> DataFrame:
        """Answers and their measures, one row a question; `answers` (qid, answer) are recorded ones, and
        `stages` is told how long each stage took."""
        return answer.answer_all(self._ready(), self.vectors, self._asked(questions), self.config, answers, self.models, self.index, stages)

    def answer_iterative(self, questions: DataFrame | list[str], reformulate=agentic.alternate) -> tuple[DataFrame, DataFrame]:
        return agentic.iterate(self._ready(), self.vectors, self._asked(questions), self.config, reformulate, models=self.models, index=self.index)


class Corpora:
    """Uploaded corpora below a path, and the engines of those last asked for, at most `capacity`."""

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None, models: Models | None = None, capacity: int = 4, grace: float = 3600.0):
        #: Seconds for which a deleted corpus can still be read by who has it.
        self.grace = grace
        self.spark, self.path, self.config, self.models, self.capacity = spark, path, config, models or Models(), capacity
        self._engines: OrderedDict[str, Engine] = OrderedDict()
        self._lock = threading.RLock()

    def add(self, uploads: DataFrame, now: Column | None = None, **limits) -> DataFrame:
        return store.add_corpus(self.path, uploads, self.models.embedder.name, F.current_timestamp() if now is None else now, embed=self.models.embedder.embed, **limits)

    def list(self) -> DataFrame:
        records = store._records(self.spark, self.path)
        empty = "corpus_id string, filename string, bytes long, passages long, embed_model string, created_at timestamp"
        return self.spark.createDataFrame([], empty) if records is None else store.list_corpora(records).drop("folder")

    def get(self, corpus_id: str) -> DataFrame:
        """The record; KeyError for an id that isn't listed."""
        return store.get_corpus(self.spark, self.path, corpus_id)[0]

    def delete(self, corpus_id: str) -> None:
        with self._lock:
            self._engines.pop(corpus_id, None)
        store.delete_corpus(self.spark, self.path, corpus_id)

    def engine(self, corpus_id: str) -> Engine:
        """The engine of a corpus; the one that wasn't asked for longest goes when there are too many."""
        with self._lock:
            if corpus_id in self._engines:
                self._engines.move_to_end(corpus_id)
                return self._engines[corpus_id]
        passages = store.get_corpus(self.spark, self.path, corpus_id)[1]  # other corpora can be asked meanwhile
        vectors = store.corpus_vectors(self.spark, self.path, corpus_id)
        if vectors is not None:
            vectors = vectors.select(F.col("idx").cast("long").alias("passage_id"), "vec")
        made = Engine(self.spark, self.config, self.models)._install(corpus.from_texts(passages, "idx", "text"), vectors)
        with self._lock:
            own = self._engines.setdefault(corpus_id, made)
            self._engines.move_to_end(corpus_id)
            while len(self._engines) > max(1, self.capacity):
                self._engines.popitem(last=False)
            return own

    def sweep(self, now: Column, ttl_hours: float, cap: int) -> list[str]:
        """Deletes what is too old or beyond the cap; returns the ids."""
        gone = [r.corpus_id for r in traces.sweep(self.list(), now, ttl_hours, cap).filter("dropped").select("corpus_id").toLocalIterator()]
        for corpus_id in gone:
            self.delete(corpus_id)
        self.vacuum()
        return gone

    def vacuum(self) -> list[str]:
        """Removes what corpora held that were deleted longer ago than `grace`; their ids."""
        return store.vacuum(self.spark, self.path, self.grace)


def published(answered: DataFrame, digits: int = 4) -> DataFrame:
    """Measured answers as a demonstration shows them: numbers rounded, undefined ones left null."""
    return answered.select([F.round(F.col(f.name), digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in answered.schema.fields])


def summary(answered: DataFrame) -> DataFrame:
    """One row over a batch of answers: counts, and mean and median of each measure that is defined."""
    measures = [c for c in ("faithfulness", "attribution", "relevance", "conciseness", "t_arith", "t_geom") if c in answered.columns]
    live = lambda c: F.when(~F.col("abstained"), F.col(c)) if c.startswith("t_") else F.col(c)
    means: list[Column] = [F.avg(live(c)).alias(f"mean_{c}") for c in measures]
    whole = answered.agg(F.count(F.lit(1)).alias("count"), F.count_if(~F.col("abstained")).alias("answered"), F.count_if("abstained").alias("abstained"), *means)
    if not measures:
        return whole
    # one row a measure and answer, so that all medians are found in one pass over ranges of values
    each = answered.select(F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), live(c).cast("double").alias("value")) for c in measures))).alias("m")).select("m.*")
    middle = stats.order_statistics(each, F.col("value"), {"median": stats.linear(0.5)}, ("measure",))
    wide = middle.agg(*(F.max(F.when(F.col("measure") == c, F.col("median"))).alias(f"median_{c}") for c in measures))
    return whole.join(F.broadcast(wide)).select("count", "answered", "abstained", *(f"{f}_{c}" for c in measures for f in ("mean", "median")))  # a row each


def arm_metrics(records: DataFrame) -> DataFrame:
    """arm, n, answered_rate (of answerable ones), abstention_rate (of others), abstention_precision,
    youden_j, mean_trust (of answered ones), mean_calls, from rows (arm, answerable, abstained, trust, calls)."""
    yes, declined = F.col("answerable"), F.col("abstained")
    found = records.groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(yes, (~declined).cast("double"))).alias("answered_rate"),
        F.avg(F.when(~yes, declined.cast("double"))).alias("abstention_rate"),
        F.avg(F.when(declined, (~yes).cast("double"))).alias("abstention_precision"),
        F.avg(F.when(~declined, F.col("trust"))).alias("mean_trust"),
        F.avg("calls").alias("mean_calls"),
    )
    return found.withColumn("youden_j", F.col("answered_rate") + F.col("abstention_rate") - 1)


def pass_rates(results: DataFrame) -> DataFrame:
    """metric, value: pass rates by class and overall, and mean trust of the cases to be answered,
    from rows (class, expect, abstained, trust_geometric)."""
    ok = (F.when(F.col("expect") == "answer", ~F.col("abstained")).otherwise(F.col("abstained"))).cast("double")
    by = results.groupBy(F.concat("class", F.lit("_pass_rate")).alias("metric")).agg(F.avg(ok).alias("value"))
    whole = results.agg(F.avg(ok).alias("value")).select(F.lit("overall_pass_rate").alias("metric"), "value")
    trusted = results.filter("expect = 'answer'").agg(F.avg("trust_geometric").alias("value")).select(F.lit("mean_geometric_trust").alias("metric"), "value")
    return by.unionByName(whole).unionByName(trusted)
