"""Which documents hold which texts, without pairing all with all."""

from __future__ import annotations

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import inverted, sparse
from plumbline.operators.sparse import small
from plumbline.sources.shared import stored


def words(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\r]+")


def anchored(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", qid: str = "qid", qtext: str = "qtext") -> DataFrame:
    """qid, key, whole: documents that have an item's anchor, and whether they hold its whole text.

    A document that holds a text holds the text's inner words as words; an item's anchor is the one
    of them that the fewest documents have (then the first by code point). So documents and items meet by an
    equi-join on words, and only what meets is searched for the text. Items of under three words
    have no inner word; they alone are compared with every document.
    """
    asked = items.select(F.col(qid).alias("qid"), F.col(qtext).alias("qtext"))
    inner = stored(asked.select("qid", F.explode(F.array_distinct(_inner(F.col("qtext")))).alias("word")), "inner")
    wanted = inner.select("word").distinct()
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.coalesce("n", F.lit(0)), "word"))
    chosen = lambda counts: stored(inner.join(counts, "word", "left").withColumn("r", place).filter("r = 1").select("qid", "word"), "anchors")
    # words meet first, then the texts of what has met
    if wanted.limit(sparse.BROADCAST_ROWS + 1).count() <= sparse.BROADCAST_ROWS:  # they are looked up where texts are cut
        known = pc.unique(wanted.toArrow().column("word").combine_chunks())
        held = stored(sparse.occurrences(docs, key, words(F.col(text)), known).select(F.col(key).alias("key"), "ids"), "held")
        spark = docs.sparkSession
        counts = spark.createDataFrame([(w, i, int(n)) for i, (w, n) in enumerate(zip(known.to_pylist(), sparse.places(held, len(known)), strict=True))], "word string, id int, n long")
        anchors = chosen(counts.select("word", "n")).join(F.broadcast(counts.select("word", "id")), "word")
        found = held.select("key", F.explode("ids").alias("id")).join(small(anchors.select("id", "qid")), "id")
    else:
        found = docs.select(F.col(key).alias("key"), F.explode(F.array_distinct(words(F.col(text)))).alias("word"))
        found = found.join(small(chosen(found.join(small(wanted), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n")))), "word")
    met = stored(found.select("key", "qid"), "met")
    each = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    whole = F.contains("text", F.col("qtext"))
    out = each.join(small(met), "key").join(small(asked), "qid").select("qid", "key", whole.alias("whole"))
    short = asked.filter(F.size(_inner(F.col("qtext"))) == 0).filter("qtext is not null")
    if short.limit(1).count():
        pairs = each.join(small(short), whole).select("qid", "key", F.lit(True).alias("whole"))
        out = out.unionByName(pairs)
    return out.select(F.col("qid").alias(qid), F.col("key").alias(key), "whole")


def _inner(text: Column) -> Column:
    w = F.filter(words(text), lambda x: x != "")
    return F.slice(w, 2, F.greatest(F.size(w) - 2, F.lit(0)))


def containing(docs: DataFrame, items: DataFrame, index: inverted.Index | None = None, key: str = "doc_id", text: str = "text", qid: str = "qid", qtext: str = "qtext") -> DataFrame:
    """qid, key: documents that hold an item's text. With an inverted index of docs, its postings say
    which documents have an item's rarest inner term, and only their texts are searched."""
    if index is None:
        return anchored(docs, items, key, text, qid, qtext).filter("whole").drop("whole")
    asked = items.select(F.col(qid).alias("qid"), F.col(qtext).alias("qtext")).filter("qtext is not null")
    met, short = inverted.holding(index, asked)
    met = stored(met, "met")
    each = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    whole = F.contains("text", F.col("qtext"))
    out = each.join(small(met), "key").join(small(asked), "qid").filter(whole).select("qid", "key")
    if short.limit(1).count():
        out = out.unionByName(each.join(small(asked.join(short, "qid", "left_semi")), whole).select("qid", "key"))
    return out.select(F.col("qid").alias(qid), F.col("key").alias(key))
