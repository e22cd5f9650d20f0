"""Persisted indexes, corpora, caches and uploads, as tables."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import inverted
from plumbline.sources.corpus import SUFFIXES, has_pdf_parser, pdf_pages, suffix
from plumbline.sources.shared import exists, listed, move, remove, stored


def save_index(path: str, embedder: str, mode: str, passages: DataFrame, vectors: DataFrame | None, index: inverted.Index | None = None) -> None:
    """Passages, vectors (unless the mode is sparse), the inverted index (unless it is dense) and a
    manifest, below path."""
    passages.write.mode("overwrite").parquet(f"{path}/passages")
    if mode != "dense":
        inverted.save(index or inverted.build(passages), f"{path}/postings")
    if vectors is not None:
        vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    spark = passages.sparkSession
    row = spark.createDataFrame([(embedder, mode, vectors is not None)], "embed_model string, retrieval_mode string, has_vectors boolean")
    row.write.mode("overwrite").json(f"{path}/manifest")


def load_index(spark: SparkSession, path: str, embedder: str) -> tuple[str, DataFrame, DataFrame | None]:
    """mode, passages, vectors; an index of another embedder is refused. Vectors are read back."""
    row = spark.read.schema("embed_model string, retrieval_mode string, has_vectors boolean").json(f"{path}/manifest").first()
    if row.embed_model != embedder:
        raise ValueError(f"the index was made with {row.embed_model}, not {embedder}")
    passages = spark.read.parquet(f"{path}/passages")
    if "source_text" not in passages.columns:
        passages = passages.withColumn("source_text", F.col("text"))
    return row.retrieval_mode, passages, spark.read.parquet(f"{path}/vectors") if row.has_vectors else None


def load_postings(spark: SparkSession, path: str) -> inverted.Index | None:
    """The inverted index of a saved index, unless its mode is dense."""
    return inverted.load(spark, f"{path}/postings") if exists(spark, f"{path}/postings") else None


def page_count(content: Column) -> Column:
    """Pages that a PDF's plain objects declare; pages within compressed objects aren't seen."""
    return F.regexp_count(F.decode(content, "ISO-8859-1"), F.lit(r"/Type\s*/Page(?![A-Za-z])"))


def reject_reason(name: Column, content: Column, most_bytes: int = 10 << 20, most_pages: int = 100) -> Column:
    """Why an upload is refused, the cheapest checks first; null where it is accepted."""
    kind, size = suffix(name), F.octet_length(content)
    return (
        F.when(~kind.isin(*SUFFIXES), F.concat(F.lit("unsupported file type "), F.coalesce(F.nullif(kind, F.lit("")), F.lit("(none)"))))
        .when(size == 0, "empty file")
        .when(size > most_bytes, F.concat(F.lit("larger than "), F.lit(str(most_bytes)), F.lit(" bytes")))
        .when((kind == ".pdf") & (F.substring(content, 1, 5) != F.lit(b"%PDF-")), "not a PDF")
        .when((kind == ".pdf") & (page_count(content) > most_pages), F.lit(f"more than {most_pages} pages"))
        .when((kind != ".pdf") & ~F.is_valid_utf8(content.cast("string")), "not UTF-8 text")
    )


ID = "^[0-9a-f]{32}$"


def add_corpus(
    path: str, uploads: DataFrame, embedder: str, now: Column, most_bytes: int = 10 << 20, most_pages: int = 100, parse: Callable[[bytes], list[str]] | None = None,
    embed: Callable[[DataFrame, str, str], DataFrame] | None = None,
) -> DataFrame:
    """Indexes accepted uploads (filename, content), each under an id of its own; returns what was decided
    on each: filename, corpus_id, reason (null where it is listed).

    All is written aside first. Then each corpus's passages, its vectors (by `embed`, once for all) and at
    last its record are moved to their places, a folder at a time, which is atomic: a corpus that is listed
    is whole, whoever else adds or reads meanwhile. If anything fails, what was moved is removed.
    PDF files need `parse` or a parser package, and are refused without.
    """
    from plumbline.operators.chunks import chunk_passages

    spark = uploads.sparkSession
    judged = uploads.withColumn("reason", reject_reason(F.col("filename"), F.col("content"), most_bytes, most_pages)).withColumn("corpus_id", F.replace(F.uuid(), F.lit("-"), F.lit("")))
    is_pdf = suffix(F.col("filename")) == ".pdf"
    if parse is None and not has_pdf_parser():
        judged = judged.withColumn("reason", F.coalesce("reason", F.when(is_pdf, "no PDF parser is installed")))
    judged = stored(judged, "uploads")  # ids are drawn once
    kept = judged.filter("reason is null")
    texts = kept.filter(~is_pdf).select("corpus_id", T.markdown_sections(F.decode("content", "UTF-8")).alias("pages"))
    pdfs = pdf_pages(kept.filter(is_pdf).select(F.col("corpus_id").alias("path"), "content"), parse).withColumnRenamed("path", "corpus_id")
    found = stored(chunk_passages(texts.unionByName(pdfs), F.col("pages"), key="corpus_id"), "passages")
    folder = F.concat(F.lit("c"), "corpus_id").alias("folder")  # a letter first, so that no id reads as a number
    counts = found.groupBy("corpus_id").agg(F.count(F.lit(1)).alias("passages"))
    rows = kept.join(counts, "corpus_id").select(
        "corpus_id", T.display_name(F.col("filename")).alias("filename"), F.octet_length("content").cast("long").alias("bytes"), "passages", F.lit(embedder).alias("embed_model"), now.alias("created_at")
    )
    rows = stored(rows, "records")
    aside, moved = f"{path}/aside/{uuid.uuid4().hex}", []
    try:
        parts = {"passages": found}
        if embed is not None:
            vectors = embed(found.select(F.struct("corpus_id", "idx").alias("id"), "text"), "id", "text")
            parts["vectors"] = vectors.select("id.corpus_id", "id.idx", "vec")
        parts["corpora"] = rows  # the records last: what they name is there
        for kind, df in parts.items():
            df.select("*", folder).write.partitionBy("folder").parquet(f"{aside}/{kind}")
        for kind in parts:
            for name in listed(spark, f"{aside}/{kind}"):
                if name.startswith("folder="):
                    move(spark, f"{aside}/{kind}/{name}", f"{path}/{kind}/{name}")
                    moved.append(f"{path}/{kind}/{name}")
    except Exception:
        for place in reversed(moved):
            remove(spark, place)
        raise
    finally:
        remove(spark, aside)
    known = rows.select("corpus_id", F.lit(True).alias("listed"))
    return judged.join(known, "corpus_id", "left").select("filename", "corpus_id", F.coalesce("reason", F.when(F.col("listed").isNull(), "no passages")).alias("reason"))


def _records(spark: SparkSession, path: str) -> DataFrame | None:
    """The records of corpora, if there are any."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(f"{path}/corpora")
    except AnalysisException:
        return None


def list_corpora(corpora: DataFrame) -> DataFrame:
    """Records with a valid id that stand in their own folder, newest first."""
    own = F.col("folder") == F.concat(F.lit("c"), "corpus_id") if "folder" in corpora.columns else F.lit(True)
    return corpora.filter(F.col("corpus_id").rlike(ID) & own).orderBy(F.desc("created_at"), "corpus_id")


def get_corpus(spark: SparkSession, path: str, corpus_id: str) -> tuple[DataFrame, DataFrame]:
    """The record and the passages of a corpus; KeyError for an id that isn't listed."""
    records = _records(spark, path)
    if not re.fullmatch(ID, corpus_id) or records is None:
        raise KeyError(corpus_id)
    record = list_corpora(records).filter(F.col("corpus_id") == corpus_id)
    if record.isEmpty():
        raise KeyError(corpus_id)
    return record.drop("folder"), spark.read.parquet(f"{path}/passages").filter(F.col("folder") == f"c{corpus_id}").drop("folder")


def corpus_vectors(spark: SparkSession, path: str, corpus_id: str) -> DataFrame | None:
    """idx, vec of a listed corpus's passages, if they were stored."""
    folder = f"{path}/vectors/folder=c{corpus_id}"
    return spark.read.parquet(folder).select("idx", "vec") if exists(spark, folder) else None


def delete_corpus(spark: SparkSession, path: str, corpus_id: str) -> None:
    """Takes a corpus off the list, at once. Who reads it by then reads on: what it holds goes by `vacuum`."""
    get_corpus(spark, path, corpus_id)
    move(spark, f"{path}/corpora/folder=c{corpus_id}", f"{path}/deleted/c{corpus_id}@{int(1000 * time.time())}")


def vacuum(spark: SparkSession, path: str, grace: float = 0.0) -> list[str]:
    """Removes what corpora held that were deleted over `grace` seconds ago; their ids."""
    gone = []
    for name in listed(spark, f"{path}/deleted"):
        corpus_id, _, at = name[1:].partition("@")
        if re.fullmatch(ID, corpus_id) and at.isdigit() and int(at) <= 1000 * (time.time() - grace):
            for place in (f"passages/folder=c{corpus_id}", f"vectors/folder=c{corpus_id}", f"deleted/{name}"):
                remove(spark, f"{path}/{place}")
            gone.append(corpus_id)
    return gone


def with_cache(items: DataFrame, cache: DataFrame | None, key: str, score: Callable[[DataFrame], DataFrame], path: str | None = None, usable: Column | None = None) -> DataFrame:
    """Scores of items by key: cached ones are looked up, each other distinct one is scored once.

    score maps distinct missing items to (key, value); with a path, new scores are appended there.
    `usable` tells which cached rows may be used (of the right model, of the right shape); what
    others hold is scored anew. Of several scores of a key, one of the least value counts.
    """
    held = cache if cache is None or usable is None else cache.filter(usable)
    held = None if held is None else held.groupBy(key).agg(F.min("value").alias("value"))
    wanted = items.select(*items.columns).dropDuplicates([key])
    missing = wanted if held is None else wanted.join(held.select(key), key, "left_anti")
    new = stored(score(missing).select(key, "value"), "scores")
    if path:
        new.write.mode("append").parquet(path)
    known = new if held is None else held.unionByName(new)
    return items.join(known, key, "left")


def write_json(rows: DataFrame, path: str) -> None:
    """A result as JSON lines; NaN as null."""
    clean = [F.nanvl(F.col(f.name), F.lit(None)).alias(f.name) if f.dataType.simpleString() in ("double", "float") else F.col(f.name) for f in rows.schema.fields]
    rows.select(*clean).write.mode("overwrite").json(path)


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table: numbers to four places, null as n/a. More than `most`
    rows are no report, and an error."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows for a report")
    show = lambda v: "n/a" if v is None or v != v else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [rows.columns, ["---"] * len(rows.columns), *([show(v) for v in r] for r in found)]
    return "".join("| " + " | ".join(x) + " |\n" for x in lines)
