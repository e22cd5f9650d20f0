"""Connected components of links, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import HOT_ROWS, discard, made_so_far, salted_join, stored


def _measure(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first())


def components(links: DataFrame) -> DataFrame:
    """node, component: of every node that has a link to another, the smallest node it reaches.

    links: a, b (long); a link with a null end is none. Each round ties every node's larger
    neighbours, then its smaller ones, to the smallest of them; it ends when nothing moves, after
    about log(nodes) rounds. A node that holds a third of all links is spread by salts. Rounds are
    written to the shared folder, and removed once the next is there.
    """
    spark = links.sparkSession
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(spark, edges, "links")
    before = _measure(edges)
    while before[0]:
        none_hot = [] if 2 * before[0] <= HOT_ROWS else None  # no key has more rows than there are
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = salted_join(both.filter("b > a"), low, ["a"], "inner", hot=none_hot).select(F.col("b").alias("a"), F.col("low").alias("b"))
        mark = made_so_far() - 1
        large = stored(spark, large.filter("a <> b").distinct(), "large")
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = salted_join(large, least, ["a"], "inner", hot=none_hot).select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e"))
        edges = stored(spark, small.select("e.*").filter("a <> b").distinct(), "stars")
        after = _measure(edges)
        discard(spark, mark, keep=1)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
