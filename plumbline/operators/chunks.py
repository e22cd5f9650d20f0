"""Passages, claims and sentence groups, one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as T


def windows(pages: Column, window: int, stride: int, min_chars: int, min_line_chars: int) -> Column:
    """(page, start, text) of overlapping line windows of each page (array of texts), each text once."""
    if window < 1 or stride < 1:
        raise ValueError("window and stride are at least 1")

    def of_lines(lines: Column, number: Column) -> Column:
        n = F.size(lines)
        last = F.when(n > window, F.ceil((n - window) / stride).cast("int") * stride).otherwise(F.lit(0))
        starts = F.when(n > 0, F.sequence(F.lit(0), last, F.lit(stride))).otherwise(F.array().cast("array<int>"))
        return F.transform(
            starts,
            lambda s: F.struct((number + 1).alias("page"), s.alias("start"), F.array_join(F.slice(lines, s + 1, F.lit(window)), " ").alias("text")),
        )

    def of_page(page: Column, number: Column) -> Column:
        lines = F.filter(F.transform(F.split(F.coalesce(page, F.lit("")), "\n"), T.strip), lambda x: F.length(x) > min_line_chars)
        return T.let(lines, lambda own: of_lines(own, number))

    def once(found: Column) -> Column:
        """The first of equal texts, by two sorts. Sorted by text and place, a text that differs from the
        one before it is the first of its kind; these, sorted by place, are what stays."""
        placed = F.array_sort(F.transform(found, lambda x, i: F.struct(x["text"].alias("text"), i.alias("i"), x["page"].alias("page"), x["start"].alias("start"))))

        def firsts(own: Column) -> Column:
            new = F.filter(own, lambda x, i: (i == 0) | (x["text"] != F.get(own, F.greatest(i - 1, F.lit(0)))["text"]))
            back = F.array_sort(F.transform(new, lambda x: F.struct(x["i"].alias("i"), x["page"].alias("page"), x["start"].alias("start"), x["text"].alias("text"))))
            return F.transform(back, lambda x: F.struct(x["page"].alias("page"), x["start"].alias("start"), x["text"].alias("text")))

        return T.let(placed, firsts)

    return T.let(F.filter(F.flatten(F.transform(pages, of_page)), lambda x: F.length(x["text"]) >= min_chars), once)


def chunk_passages(docs: DataFrame, pages: Column, window: int = 8, stride: int = 4, min_chars: int = 30, min_line_chars: int = 3, key: str = "doc_id") -> DataFrame:
    """key, idx, page, text: passages of each document, numbered from 0."""
    found = docs.select(key, F.posexplode(windows(pages, window, stride, min_chars, min_line_chars)).alias("idx", "w"))
    return found.select(key, "idx", F.col("w.page").alias("page"), F.col("w.text").alias("text"))


def claims(rows: DataFrame, answer: Column, *keys: str, min_chars: int = 20) -> DataFrame:
    return rows.select(*keys, F.posexplode(T.sentences(answer, min_chars)).alias("claim_idx", "claim"))


def sentence_groups(docs: DataFrame, text: Column, n: int, key: str = "doc_id") -> DataFrame:
    """key, idx, text: groups of n sentences that share one; a text of at most n sentences whole."""
    step = max(1, n - 1)

    def groups(found: Column) -> Column:
        count = F.size(found)
        starts = F.sequence(F.lit(0), F.greatest(F.ceil((count - n) / step), F.lit(0)).cast("int") * step, F.lit(step))
        return F.when(count <= n, F.array(text)).otherwise(F.transform(starts, lambda s: F.array_join(F.slice(found, s + 1, F.lit(n)), " ")))

    return docs.select(key, F.posexplode(T.let(T.sentences(text), groups)).alias("idx", "text"))
