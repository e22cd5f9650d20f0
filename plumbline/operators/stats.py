"""How well a score tells two classes apart: ranks, curves, thresholds, percentiles.

Rows are (score, label 0/1), with an optional list of grouping columns. Rank statistics come from
one grouped count of each distinct score, and running sums over those counts (`order.running`), so
tied and repeated scores cost nothing, and no one task orders more scores than it can hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.order import running
from plumbline.operators.sparse import small


def tallies(rows: DataFrame, by: tuple = (), score: str = "score", label: str = "label") -> DataFrame:
    """by, score, pos, neg: counts at each distinct score; rows without score or label drop out."""
    usable = rows.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(label).isNotNull())
    return usable.groupBy(*by, F.col(score).cast("double").alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))


def dropped(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """no_score, no_label, used: rows that tallies leaves out, and why (a missing score counts first), and the others."""
    bad = F.col(score).isNull() | F.isnan(F.col(score).cast("double"))
    lost = ~bad & F.col(label).isNull()
    return rows.agg(F.count_if(bad).alias("no_score"), F.count_if(lost).alias("no_label"), F.count_if(~bad & ~lost).alias("used"))


def _totals(tally: DataFrame, by: tuple) -> DataFrame:
    return tally.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def _curve(rows: DataFrame, by: tuple, score: str, label: str) -> DataFrame:
    """by, score, pos, neg, tp, fp (of this score and above), n_pos, n_neg."""
    t = running(tallies(rows, by, score, label), [F.desc("score")], {"tp": F.col("pos"), "fp": F.col("neg")}, by)
    t = t.withColumn("tp", F.col("tp") + F.col("pos")).withColumn("fp", F.col("fp") + F.col("neg"))
    totals = small(_totals(t, by))
    return t.join(totals, list(by)) if by else t.join(totals)


def roc_auc(rows: DataFrame, by: tuple = (), score: str = "score", label: str = "label") -> DataFrame:
    """by, n_pos, n_neg, auc: chance that a positive scores above a negative, ties half; NaN with one class."""
    t = running(tallies(rows, by, score, label), [F.col("score")], {"below": F.col("neg")}, by)
    wins = F.col("pos") * (F.col("below") + F.col("neg") / 2)
    out = t.withColumn("wins", wins).groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum("wins").alias("wins"))
    auc = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("wins") / (F.col("n_pos").cast("double") * F.col("n_neg"))).otherwise(F.lit(float("nan")))
    return out.select(*by, "n_pos", "n_neg", auc.alias("auc"))


def roc_curve(rows: DataFrame, by: tuple = (), score: str = "score", label: str = "label") -> DataFrame:
    """by, threshold, fpr, tpr: one point a distinct score, and the origin above the largest."""
    t = _curve(rows, by, score, label)
    points = t.select(*by, F.col("score").alias("threshold"), F.try_divide("fp", "n_neg").alias("fpr"), F.try_divide("tp", "n_pos").alias("tpr"))
    origin = t.groupBy(*by).agg((F.max("score") + 1).alias("threshold")).select(*by, "threshold", F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(origin.filter("threshold is not null"))


def pr_auc(rows: DataFrame, by: tuple = (), score: str = "score", label: str = "label") -> DataFrame:
    """by, ap: average precision over distinct scores; NaN without positives."""
    t = _curve(rows, by, score, label)
    part = t.withColumn("part", F.col("tp") / (F.col("tp") + F.col("fp")) * F.try_divide("pos", "n_pos"))
    both = F.when((F.max("n_pos") > 0) & (F.max("n_neg") > 0), F.sum("part")).otherwise(F.lit(float("nan")))
    return part.groupBy(*by).agg(both.alias("ap"))


def best_sign(auc: Column) -> Column:
    return F.when((auc >= 0.5) | F.isnan(auc), F.lit(1)).otherwise(F.lit(-1))


def gate_grid(rows: DataFrame) -> DataFrame:
    """0, 0.01, ... 0.60, rounded to 10 places."""
    return rows.sparkSession.range(61).select(F.round(F.col("id") * 0.01, 10).alias("tau"))


def unit_grid(rows: DataFrame) -> DataFrame:
    """id * 0.01 for id = 0 to 100."""
    return rows.sparkSession.range(101).select((F.col("id") * 0.01).alias("tau"))


def _binned(counted: DataFrame, grid: DataFrame, by: tuple, amounts: tuple) -> DataFrame:
    """by, tau, and for each amount its sum at scores >= tau (name) and below (name_under).

    Each distinct score goes to one bin, the number of thresholds that it reaches; a group then has
    no more rows than the grid has thresholds, and one more.
    """
    taus = sorted(r[0] for r in grid.collect())  # a few thresholds
    reached = F.size(F.filter(F.array(*map(F.lit, taus)), lambda t: F.col("score") >= t))
    bins = counted.groupBy(*by, reached.alias("bin")).agg(*(F.sum(a).alias(a) for a in amounts))
    lists = bins.groupBy(*by).agg(F.collect_list(F.struct("bin", *amounts)).alias("bins"))
    part = lambda a, test: F.aggregate(F.filter("bins", test), F.lit(0).cast("long"), lambda s, x: s + x[a])
    marks = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(t).alias("tau")) for i, t in enumerate(taus)))
    each = lists.withColumn("m", F.explode(marks))
    over, under = lambda x: x["bin"] > F.col("m.i"), lambda x: x["bin"] <= F.col("m.i")
    return each.select(*by, "m.tau", *(part(a, over).alias(a) for a in amounts), *(part(a, under).alias(f"{a}_under") for a in amounts))


def sweep(rows: DataFrame, grid: DataFrame, by: tuple = (), score: str = "score", label: str = "label") -> DataFrame:
    """by, tau, tp, fp, fn, tn: predictions are score >= tau."""
    t = _binned(tallies(rows, by, score, label), grid, by, ("pos", "neg"))
    return t.select(*by, "tau", F.col("pos").alias("tp"), F.col("neg").alias("fp"), F.col("pos_under").alias("fn"), F.col("neg_under").alias("tn"))


def rates(counts: DataFrame) -> DataFrame:
    """counts with precision, recall, f1, accuracy; 0 where a denominator is 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = counts.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
    out = out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return out.withColumn("accuracy", ratio(tp + tn, tp + fp + fn + tn))


def _first(rows: DataFrame, by: tuple, *order: Column) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_r = 1").drop("_r")


def best_tau_by_f1(swept: DataFrame, by: tuple = ()) -> DataFrame:
    """The threshold of the best F1; ties: nearest to 0.5, then smaller."""
    return _first(swept, by, F.desc("f1"), F.abs(F.col("tau") - 0.5), F.asc("tau"))


def youden(counts: DataFrame, by: tuple = ()) -> DataFrame:
    """by, tau, j, tpr, fpr: the first threshold of the largest TPR - FPR."""
    tpr = F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    fpr = F.col("fp") / F.greatest(F.col("fp") + F.col("tn"), F.lit(1))
    rows = counts.select(*by, "tau", tpr.alias("tpr"), fpr.alias("fpr")).withColumn("j", F.col("tpr") - F.col("fpr"))
    return _first(rows, by, F.desc("j"), F.asc("tau")).select(*by, "tau", "j", "tpr", "fpr")


def degenerate_f1(rows: DataFrame, label: str = "label") -> DataFrame:
    """What predicting every row positive scores."""
    t = rows.agg(F.count_if(F.col(label) == 1).alias("tp"), F.count_if(F.col(label) == 0).alias("fp"))
    p = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))
    return t.select(p.alias("precision"), F.lit(1.0).alias("recall")).withColumn("f1", 2 * F.col("precision") / (F.col("precision") + 1))


def retention_sweep(rows: DataFrame, grid: DataFrame, tier: str, positive: str, score: str = "score") -> DataFrame:
    """tau, tier, rate: the share of each tier's scores that pass; on the positive tier, retention."""
    t = rows.groupBy(tier, F.col(score).cast("double").alias("score")).agg(F.count(F.lit(1)).alias("n"))
    passed = _binned(t, grid, (tier,), ("n",))
    return passed.select("tau", tier, (F.col("n") / (F.col("n") + F.col("n_under"))).alias("rate"), (F.col(tier) == positive).alias("is_positive"))


def recommended_threshold(retention: DataFrame, floor: float) -> DataFrame:
    """The largest threshold whose retention meets the floor, else the smallest."""
    return retention.agg(F.coalesce(F.max(F.when(F.col("rate") >= floor, F.col("tau"))), F.min("tau")).alias("tau"))


def linear(p: float) -> tuple[str, float]:
    """Between order statistics, by linear interpolation."""
    return "linear", p


def nearest(p: float) -> tuple[str, float]:
    """The smallest value that at least a share p of the values doesn't exceed."""
    return "nearest", p


def order_statistics(rows: DataFrame, value: Column, wanted: dict[str, tuple[str, float]], by: tuple = ()) -> DataFrame:
    """by, and a column for each name in wanted (`linear` or `nearest`), exactly; nulls drop out.

    Distinct values are counted and their places found by running sums over ranges of them
    (`order.running`), so no task holds the values of a group.
    """
    t = rows.select(*by, value.cast("double").alias("_v")).filter("_v is not null").groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    t = running(t, [F.col("_v")], {"_before": F.col("_n")}, by)
    totals = small(t.groupBy(*by).agg(F.sum("_n").alias("_total")))
    t = t.join(totals, list(by)) if by else t.join(totals)
    before, upto, total = F.col("_before"), F.col("_before") + F.col("_n"), F.col("_total")
    at = lambda place: F.max(F.when((before <= place) & (place < upto), F.col("_v")))
    found, shown = [], []
    for name, (kind, p) in wanted.items():
        place = F.lit(p) * (total - 1)
        if kind == "linear":
            found += [at(F.floor(place)).alias(f"_{name}_low"), at(F.ceil(place)).alias(f"_{name}_high"), F.max(place - F.floor(place)).alias(f"_{name}_part")]
            shown.append((F.col(f"_{name}_low") * (1 - F.col(f"_{name}_part")) + F.col(f"_{name}_high") * F.col(f"_{name}_part")).alias(name))
        else:
            found.append(at(F.greatest(F.ceil(F.lit(p) * total) - 1, F.lit(0))).alias(f"_{name}"))
            shown.append(F.col(f"_{name}").alias(name))
    return t.groupBy(*by).agg(*found).select(*by, *shown)


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """bin (from 1), n: equal bins; the last is closed; values outside drop out."""
    v = F.col(value)
    at = F.least(F.floor((v - low) / ((high - low) / bins)) + 1, F.lit(bins)).cast("int")
    return rows.filter(v.between(low, high)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
