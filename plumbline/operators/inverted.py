"""A stored inverted index, and BM25 that leaves out what can't reach the k best.

Documents are dealt by a hash of their key to groups of about GROUP. A block is what one term has in one
group: keys, term frequencies and document lengths, and the largest part of a score that any of them
gets from one query term (`most`). Blocks lie in buckets by term, in order of term and group, so a search
reads the buckets of its terms alone, and of the texts nothing.

A group's bound is the sum of its blocks' largest parts, as the query weighs them; no document of
the group scores more. The groups of the highest bounds are scored first, and of the others those alone
whose bound reaches the k-th score found; so results are those of scoring everything.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators.sparse import idf, small, top
from plumbline.sources.shared import stored

#: Documents of a group, about; documents for each bucket of terms, and buckets at most.
GROUP, BUCKET_DOCS, MOST_BUCKETS = 16, 20_000, 256
#: Postings up to which all of a search's are scored, as bounds would cost more than they save.
DIRECT = 50_000_000
#: Bounds and scores are sums in different orders; what differs by less than this counts as equal.
SLACK = 1e-6


@dataclass(frozen=True)
class Index:
    """blocks: bucket, term, grp, n, most, keys, tfs, dls; terms: bucket, term, df. `most` holds for k1 and b."""

    blocks: DataFrame
    terms: DataFrame
    n: int
    avgdl: float
    key: str
    k1: float
    b: float
    buckets: int


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def part(tf: Column, dl: Column, avgdl: float, k1: float, b: float) -> Column:
    """What a term of weight 1 adds to a score."""
    return tf / (tf + k1 * (1 - b + b * dl / (avgdl or 1.0)))


def build(passages: DataFrame, key: str = "passage_id", text: str = "text", k1: float = 1.5, b: float = 0.75) -> Index:
    """The index of all rows. Each text is cut into terms once, and moves once, to its group."""
    n = passages.count()
    groups = max(1, -(-n // GROUP))
    rows = passages.select(F.pmod(F.xxhash64(key), F.lit(groups)).alias("grp"), F.col(key).alias("key"), T.tokens(F.col(text)).alias("terms")).repartition("grp")
    each = rows.select("grp", "key", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    posted = each.groupBy("grp", "term", "key", "dl").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    posted = posted.groupBy("grp", "term").agg(F.sort_array(F.collect_list(F.struct("key", "tf", "dl"))).alias("p"), F.sum("tf").alias("total"))
    posted = stored(posted, "postings")
    total = posted.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    avgdl = total / n if n else 0.0
    most = F.array_max(F.transform("p", lambda x: part(x["tf"], x["dl"], avgdl, k1, b)))
    buckets = min(MOST_BUCKETS, 1 + n // BUCKET_DOCS)
    blocks = posted.select(bucket_of(buckets).alias("bucket"), "term", "grp", F.size("p").alias("n"), most.alias("most"), F.col("p.key").alias("keys"), F.col("p.tf").alias("tfs"), F.col("p.dl").alias("dls"))
    return Index(blocks, blocks.groupBy("bucket", "term").agg(F.sum("n").alias("df")), n, avgdl, key, k1, b, buckets)


TOTALS = "n long, avgdl double, key string, k1 double, b double, buckets int"


def save(index: Index, path: str) -> None:
    """Blocks and terms below path, each file a stretch of the order of buckets and terms."""
    order = ["bucket", "term", "grp"]
    index.blocks.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")
    index.terms.repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    row = index.blocks.sparkSession.createDataFrame([(index.n, float(index.avgdl), index.key, index.k1, index.b, index.buckets)], TOTALS)
    row.coalesce(1).write.mode("overwrite").json(f"{path}/totals")


def load(spark: SparkSession, path: str, kind: str = "bigint") -> Index:
    """The index below path, whose keys are of the type `kind`."""
    t = spark.read.schema(TOTALS).json(f"{path}/totals").first()
    blocks = f"term string, grp bigint, n int, most double, keys array<{kind}>, tfs array<int>, dls array<int>, bucket int"
    read = lambda what, schema: spark.read.schema(schema).option("basePath", f"{path}/{what}").parquet(f"{path}/{what}")
    return Index(read("blocks", blocks), read("terms", "term string, df bigint, bucket int"), t.n, t.avgdl, t.key, t.k1, t.b, t.buckets)


def keep(index: Index, path: str) -> Index:
    """The index, saved below path and read back."""
    kind = index.blocks.schema["keys"].dataType.elementType.simpleString()
    save(index, path)
    return load(index.blocks.sparkSession, path, kind)


def weights(index: Index) -> DataFrame:
    """term, df, idf."""
    return index.terms.select("term", "df", idf(F.lit(index.n), F.col("df")).alias("idf"))


def _asked(index: Index, queries: DataFrame, qid: str, qtext: str, k1: float) -> tuple[DataFrame, list[int]]:
    """qid, bucket, term, w, df: what queries ask for and the index has; and its buckets."""
    wanted = queries.select(F.col(qid).alias("qid"), F.explode(T.tokens(F.col(qtext))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))
    wanted = stored(wanted.withColumn("bucket", bucket_of(index.buckets)), "wanted")
    buckets = [r.bucket for r in wanted.select("bucket").distinct().collect()]  # at most MOST_BUCKETS
    have = index.terms.filter(F.col("bucket").isin(buckets))
    weight = F.col("qtf") * idf(F.lit(index.n), F.col("df")) * (k1 + 1)
    return stored(small(wanted).join(have, ["bucket", "term"]).select("qid", "bucket", "term", weight.alias("w"), "df"), "asked"), buckets


def bounds(index: Index, asked: DataFrame, buckets: list[int], k1: float, b: float) -> DataFrame:
    """qid, grp, bound: what no document of the group can score above."""
    most = F.col("most") if (k1, b) == (index.k1, index.b) else F.lit(1.0)
    blocks = index.blocks.filter(F.col("bucket").isin(buckets)).select("bucket", "term", "grp", most.alias("most"))
    return blocks.join(small(asked), ["bucket", "term"]).groupBy("qid", "grp").agg(F.sum(F.col("w") * F.col("most")).alias("bound"))


def _scores(index: Index, asked: DataFrame, buckets: list[int], groups: DataFrame | None, k1: float, b: float) -> DataFrame:
    """qid, key, score of all documents of the groups (qid, grp), or of all groups."""
    blocks = index.blocks.filter(F.col("bucket").isin(buckets)).select("bucket", "term", "grp", "keys", "tfs", "dls")
    # what a query asks for meets its blocks within the scan; postings come out of those of its groups alone
    mine = blocks.join(small(asked), ["bucket", "term"])
    mine = mine if groups is None else mine.join(small(groups), ["qid", "grp"], "left_semi")
    each = mine.select("qid", "w", F.explode(F.arrays_zip("keys", "tfs", "dls")).alias("p"))
    got = F.col("w") * part(F.col("p.tfs"), F.col("p.dls"), index.avgdl, k1, b)
    return each.groupBy("qid", F.col("p.keys").alias("key")).agg(F.round(F.sum(got), 9).alias("score")).filter("score > 0")


def _best(found: DataFrame, k: int) -> DataFrame:
    return top(found, k, "qid", F.desc("score"), F.asc("key"))


def visits(index: Index, asked: DataFrame, buckets: list[int], k: int, k1: float = 1.5, b: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """Scores (qid, key, score) that hold the k best of each query, and the groups of each query (qid,
    grp, bound, visit: 1 or 2 where it was scored in the first or second turn, null where its bound ruled it out)."""
    bound = stored(bounds(index, asked, buckets, k1, b), "bounds")
    first = stored(top(bound, k, "qid", F.desc("bound"), F.asc("grp")).select("qid", "grp"), "first")
    found = stored(_scores(index, asked, buckets, first, k1, b), "scores")
    reach = _best(found, k).filter(F.col("rank") == k).select("qid", F.col("score").alias("reach"))
    told = bound.join(small(first.withColumn("one", F.lit(1))), ["qid", "grp"], "left").join(small(reach), "qid", "left")
    visit = F.coalesce("one", F.when(F.col("reach").isNull() | (F.col("bound") >= F.col("reach") - SLACK), 2))
    told = stored(told.select("qid", "grp", "bound", visit.alias("visit")), "visits")
    rest = told.filter("visit = 2").select("qid", "grp")
    return found.unionByName(_scores(index, asked, buckets, rest, k1, b)), told


def search(index: Index, queries: DataFrame, k: int, qid: str = "qid", qtext: str = "qtext", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """qid, key, score, rank: as `sparse.search` over the texts themselves."""
    asked, buckets = _asked(index, queries, qid, qtext, k1)
    postings = asked.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    found = _scores(index, asked, buckets, None, k1, b) if postings <= DIRECT else visits(index, asked, buckets, k, k1, b)[0]
    return _best(found, k).select(F.col("qid").alias(qid), F.col("key").alias(index.key), "score", "rank")


def holding(index: Index, items: DataFrame, qid: str = "qid", qtext: str = "qtext") -> tuple[DataFrame, DataFrame]:
    """qid, key: documents that have an item's rarest inner term, of which no document that holds the
    whole text lacks any; and the items (qid) without inner terms, for which there is no such list."""
    terms = T.tokens(F.col(qtext))
    inner = items.select(F.col(qid).alias("qid"), F.slice(terms, 2, F.greatest(F.size(terms) - 2, F.lit(0))).alias("inner"))
    each = inner.select("qid", F.explode(F.array_distinct("inner")).alias("term")).withColumn("bucket", bucket_of(index.buckets))
    each = stored(each, "inner")
    buckets = [r.bucket for r in each.select("bucket").distinct().collect()]
    have = index.terms.filter(F.col("bucket").isin(buckets))
    known = each.join(small(have.join(small(each.select("bucket", "term").distinct()), ["bucket", "term"])), ["bucket", "term"], "left")
    rarest = known.groupBy("qid").agg(F.min_by(F.struct("bucket", "term", "df"), F.struct(F.coalesce("df", F.lit(0)), "term")).alias("t"))
    rarest = stored(rarest.select("qid", "t.bucket", "t.term"), "rarest")
    blocks = index.blocks.filter(F.col("bucket").isin(buckets)).select("bucket", "term", "keys")
    met = blocks.join(small(rarest), ["bucket", "term"]).select("qid", F.explode("keys").alias("key"))
    return met.distinct(), inner.filter(F.size("inner") == 0).select("qid")
