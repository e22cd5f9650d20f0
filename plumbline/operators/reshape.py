"""Pivots, quotas, nested rows, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pivot(rows: DataFrame, keys: tuple, name: str, value: str, columns: tuple) -> DataFrame:
    """One row for each key, one column for each listed name; two values in a cell are an error."""
    one = F.when(F.count(value) > 1, F.raise_error(F.lit("two values in a cell")).cast("double")).otherwise(F.max(value).cast("double"))
    return rows.groupBy(*keys).pivot(name, list(columns)).agg(one)


def quotas(total: int, groups: int) -> list[int]:
    """An even split; the remainder goes to the first groups."""
    return [total // groups + (i < total % groups) for i in range(groups)]


def stratified(rows: DataFrame, stratum: str, total: int, order: Column) -> DataFrame:
    """About total rows, evenly over the sorted strata, none beyond its rows, in the given order."""
    names = [r[0] for r in rows.select(stratum).distinct().orderBy(stratum).limit(10_001).collect()]
    if len(names) > 10_000:
        raise ValueError("too many strata")
    if not names:
        return rows
    quota = rows.sparkSession.createDataFrame(list(zip(names, quotas(total, len(names)), strict=True)), f"{stratum} string, _quota int")
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(order))
    return rows.withColumn("_place", place).join(F.broadcast(quota), stratum).filter("_place <= _quota").drop("_place", "_quota")


def sample(rows: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows in a seeded hash order."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def binary_label(value: Column, ones: tuple, zeros: tuple) -> Column:
    """1, 0, null for null; any other value is an error."""
    return F.when(value.isin(*ones), 1).when(value.isin(*zeros), 0).when(value.isNotNull(), F.raise_error(F.concat(F.lit("unknown label "), value)).cast("int"))


def unnest(rows: DataFrame, key: str, answers: str, quotes: str) -> DataFrame:
    """One row a sentence of each answer, with the quotes it cites and why it is dropped, if so.

    answers: array<struct<sentences: array<struct<index, text, attributable>>>>; quotes:
    array<struct<idx, text>>.
    """
    from plumbline.functions.text import citation_markers, strip

    a = rows.select(key, F.col(quotes).alias("quotes"), F.posexplode(answers).alias("answer", "a"))
    s = a.select(key, "quotes", "answer", F.posexplode("a.sentences").alias("sentence", "s"))
    out = s.select(key, "answer", "sentence", F.col("s.text").alias("text"), F.col("s.attributable").alias("label"), citation_markers(F.col("s.text")).alias("markers"), "quotes")
    cited = F.filter("quotes", lambda q: F.array_contains(F.col("markers"), q["idx"]))
    out = out.withColumn("cited", cited).drop("quotes")
    reason = (
        F.when(F.col("label").isNull() | ~F.col("label").isin(0, 1), "no label")
        .when(strip(F.coalesce("text", F.lit(""))) == "", "empty")
        .when(F.size("markers") == 0, "no citation")
        .when(F.size("cited") == 0, "dangling citation")
    )
    return out.withColumn("dropped", reason)


#: How far a metric may fall below its baseline.
TOLERANCES = {"in_corpus_pass_rate": 0.0, "out_of_corpus_pass_rate": 0.0, "adversarial_pass_rate": 0.0, "overall_pass_rate": 0.0, "mean_geometric_trust": 0.05}


def compare(current: DataFrame, baseline: DataFrame, tolerances: dict | None = None) -> DataFrame:
    """metric, baseline, current, delta, verdict (PASS, FAIL, or -- where there is nothing to hold)."""
    spark = current.sparkSession
    limits = spark.createDataFrame(list((TOLERANCES if tolerances is None else tolerances).items()), "metric string, allowed double")
    both = current.select("metric", F.col("value").alias("current")).join(baseline.select("metric", F.col("value").alias("baseline")), "metric", "full_outer")
    out = both.join(F.broadcast(limits), "metric", "left").withColumn("delta", F.col("current") - F.col("baseline"))
    verdict = F.when(F.col("delta").isNull() | F.col("allowed").isNull(), "--").when(F.col("delta") >= -F.col("allowed"), "PASS").otherwise("FAIL")
    return out.select("metric", "baseline", "current", "delta", verdict.alias("verdict"))
