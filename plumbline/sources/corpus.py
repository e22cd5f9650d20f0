"""Reading corpora: files of text, Markdown and PDF as documents of pages."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as T

SUFFIXES = (".pdf", ".md", ".txt")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def has_pdf_parser() -> bool:
    """Whether this machine has the optional package that reads PDF files."""
    return importlib.util.find_spec("pdfplumber") is not None


def pdf_pages(files: DataFrame, parse: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """path, pages: text of each page of PDF files (path, content), by `parse` or the package
    pdfplumber."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = parse or _plumbed
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "pages": [read(bytes(c)) for c in batch["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, pages array<string>")


def _plumbed(content: bytes) -> list[str]:
    import io

    try:
        import pdfplumber
    except ImportError as e:
        raise RuntimeError("reading PDF files needs the package pdfplumber") from e
    with pdfplumber.open(io.BytesIO(content)) as pdf:
        return [p.extract_text() or "" for p in pdf.pages]


def pdf_text(files: DataFrame) -> DataFrame:
    return pdf_pages(files).select("path", F.array_join("pages", "\n").alias("text"))


def read_corpus(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True, parse: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """source (path below the folder, or the file's name), pages: one row a file.

    Other kinds of files in a folder are passed over; a path without any usable file is an error,
    and so is a single file of another kind.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).load(path)
    files = files.select("path", "content").withColumn("suffix", suffix(F.col("path")))
    usable = files.filter(F.col("suffix").isin(*SUFFIXES))
    found = [r[0] for r in usable.select("suffix").distinct().collect()]  # at most the three
    if not found and files.select("path").limit(1).count():
        raise ValueError(f"unsupported file type; one of {', '.join(SUFFIXES)} is needed")
    if not found:
        raise FileNotFoundError(f"no file of a corpus at {path}")
    body = F.decode("content", "UTF-8")
    plain = files.filter(F.col("suffix").isin(".md", ".txt")).select("path", T.markdown_sections(body).alias("pages"))
    pdf = files.filter("suffix = '.pdf'")
    out = plain.unionByName(pdf_pages(pdf, parse)) if ".pdf" in found else plain
    root = path.rstrip("/").split("/")[-1]
    below = F.regexp_extract("path", rf"/\Q{root}\E/(.*)$", 1)
    name = F.when(below != "", below).otherwise(F.element_at(F.split("path", "/"), -1))
    return out.select(name.alias("source"), "pages")


def passages(files: DataFrame, window: int = 8, stride: int = 4, min_chars: int = 30) -> DataFrame:
    """passage_id (from 0, by source, page and place), source, page, text, source_text."""
    from plumbline.operators.chunks import chunk_passages
    from plumbline.operators.order import running

    found = chunk_passages(files, F.col("pages"), window, stride, min_chars, key="source")
    counts = found.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    starts = running(counts, [F.col("source")], {"first": F.col("n")}).select("source", "first")
    out = found.join(starts, "source")
    return out.select((F.col("first") + F.col("idx")).alias("passage_id"), "source", "page", "text", F.col("text").alias("source_text"))


def from_texts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Ready passages: passage_id is the key."""
    return texts.select(F.col(key).cast("long").alias("passage_id"), F.lit("inline").alias("source"), F.lit(1).alias("page"), F.col(text).alias("text"), F.col(text).alias("source_text"))


def contextualised(found: DataFrame, sentences: DataFrame) -> DataFrame:
    """passages whose indexed text opens with a situating sentence, where there is one (passage_id,
    sentence); source_text stays what was read."""
    out = found.join(sentences.select("passage_id", T.situating_sentence(F.col("sentence")).alias("s")), "passage_id", "left")
    text = F.when(F.coalesce(F.col("s"), F.lit("")) != "", F.concat_ws(" ", "s", "text")).otherwise(F.col("text"))
    return out.withColumn("text", text).drop("s")


def contextualise(found: DataFrame, make: Callable[[DataFrame], DataFrame], model: str, cache: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """passages with situating sentences by a model. make maps distinct passages that the cache
    (key, value) lacks, as rows (key, text, source), to (key, value); `path` keeps what it makes."""
    from plumbline.sources.store import with_cache

    keyed = found.withColumn("key", T.cache_key(model, F.coalesce("text", F.lit(""))))
    made = with_cache(keyed.select("passage_id", "key", "text", "source"), cache, "key", make, path)
    return contextualised(found, made.select("passage_id", F.col("value").alias("sentence")))


def shown(hits: DataFrame, found: DataFrame) -> DataFrame:
    """hits with the source text; after this nothing reads the indexed text."""
    texts = found.select("passage_id", "source", "page", F.coalesce("source_text", "text").alias("passage"))
    return hits.join(texts, "passage_id")
