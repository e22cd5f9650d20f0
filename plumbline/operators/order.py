"""Running sums over an order that no one task could hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.sparse import small
from plumbline.sources.shared import stored

#: Rows up to which each group is summed in one task.
ONE_TASK = 1_000_000


def running(rows: DataFrame, order: list[Column], columns: dict[str, Column], by: tuple = ()) -> DataFrame:
    """rows with, for each name in columns, the sum of its column over the rows of the same group
    that come before in the order. The order must be total, as rows that tie are told apart by chance.

    Few rows take one window. More are dealt by range to tasks, so that each holds a stretch of the
    order; sums of whole stretches, of which a group has no more than there are tasks, are added to
    the sums within a stretch.
    """
    rows = stored(rows, "ordered")
    before = lambda *part: Window.partitionBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    sums = {n: F.coalesce(F.sum(c).over(before(*by).orderBy(*order)), F.lit(0)) for n, c in columns.items()}
    if rows.count() <= ONE_TASK:
        return rows.select("*", *(c.alias(n) for n, c in sums.items()))
    dealt = rows.repartitionByRange(*(F.col(c) for c in by), *order).withColumn("_part", F.spark_partition_id())
    dealt = stored(dealt, "dealt")
    parts = dealt.groupBy(*by, "_part").agg(*(F.sum(c).alias(f"_{n}") for n, c in columns.items()))
    starts = parts.select(*by, "_part", *(F.coalesce(F.sum(f"_{n}").over(before(*by).orderBy("_part")), F.lit(0)).alias(f"_{n}") for n in columns))
    within = before(*by, "_part").orderBy(*order)
    dealt = dealt.select("*", *(F.coalesce(F.sum(c).over(within), F.lit(0)).alias(n) for n, c in columns.items()))
    out = dealt.join(small(starts), [*by, "_part"])
    return out.select(*rows.columns, *((F.col(n) + F.col(f"_{n}")).alias(n) for n in columns))
