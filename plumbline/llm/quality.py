"""Quality classification with hierarchical empirical Bayes over sites.

host and path are columns that the caller names. `documents` has no url, so op7_quality and the
pipeline pass stand-ins, source for the host and lang for the path: few large cells a source, which
hardly need the shrinking that sparse paths get.

A logistic classifier on a text's form gives each document's evidence. Sites have two levels:
host, and path within a host. By grouped sums over all documents, a host's share of good
documents is the posterior mean under a Beta prior fitted to all hosts by moments; a path's is
that under a Beta prior around its host's. A sparse site thus keeps near its parent. A document's
posterior odds are its classifier's odds times how far the odds of its path, without the
document itself, stand from the global odds.

The classifier is fitted on about FIT_ROWS labelled documents, chosen by a hash (a documented
bound: it has 12 weights); everything else is over all documents. Site tables are joined by
broadcast while they are counted to be small, else against salted copies.

Cases: a null text counts as empty; a null host or path is a site of its own; without labels of
both kinds the evidence is 0.5 throughout and all are kept; labels for unknown ids and null
labels are ignored, of repeated labels the largest counts, and of several texts of one id the
one of the least features is learned from; repeated rows are scored alike; an empty table gives an empty result; columns named like an output are replaced, others pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import free_prefix, salted_join, slices, stored, text_buffer, words

FIT_ROWS = 20_000
#: Bytes of text that one step reads.
SLICE = 1 << 19
BROADCAST_SITES = 50_000
#: Weight of the site's odds, strength of a path's prior, and the posterior below which a
#: document is rejected.
SITE_WEIGHT, PATH_STRENGTH, LEAST = 0.5, 20.0, 0.5
OUTPUTS = ("evidence", "host_rate", "path_rate", "quality", "keep")
N_FEATURES = 12


def _classes() -> np.ndarray:
    """Byte class x byte, of 0 and 1."""
    b = np.arange(256)
    letter = ((b | 32) >= 97) & ((b | 32) <= 122) & (b < 128)
    digit = (b >= 48) & (b <= 57)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    sign = (b < 128) & (b > 32) & ~letter & ~digit
    plain = np.isin(b, list(b".,'-"))
    return np.stack([(b >= 65) & (b <= 90), digit, sign & ~plain, b == ord("|"), b == ord("!"), b == 10, b >= 128, plain]).astype(np.float64)


CLASSES = _classes()


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Text x feature: shares of byte classes, length, word length and repetition."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    out = np.zeros((n, N_FEATURES))
    own = np.flatnonzero(size)
    if not len(own):
        return out
    heads = offsets[:-1][own]
    for i, row in enumerate(CLASSES):
        out[own, i] = np.add.reduceat(row[data], heads) / size[own]
    starts, lengths, hashes = words(data, offsets)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    count = np.bincount(doc, minlength=n)
    same = np.zeros(len(hashes))
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    some = np.maximum(count, 1)
    out[:, 8] = np.log1p(count) / 10
    out[:, 9] = np.bincount(doc, weights=lengths, minlength=n) / some / 20
    out[:, 10] = np.bincount(doc, weights=same, minlength=n) / some
    out[:, 11] = np.sqrt(out[:, 2])
    return out


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    bias: float

    def evidence(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.spread) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -12, 12)))


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 30, ridge: float = 1.0) -> Model:
    """Ridge logistic regression by Newton steps."""
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0)
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread = np.where(spread > 1e-9, spread, 1.0)
    a = np.hstack([(x - mean) / spread, np.ones((len(x), 1))])
    w, penalty = np.zeros(a.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Model(mean, spread, w[:-1], float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality") -> Model:
    """The classifier, from about FIT_ROWS of the labelled documents."""
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max(label).alias("y"))
    n = known.count()
    if not n:
        return logistic(np.zeros((0, N_FEATURES)), np.zeros(0))
    share = int(min(1.0, FIT_ROWS / n) * (1 << 20))
    chosen = known.filter(F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(1 << 20)) < share)  # some FIT_ROWS small rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                x = features(*text_buffer(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "y", "x"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    rows = rows.join(F.broadcast(chosen.select(F.col("id").cast("long"), F.col("y").cast("double"))), "id")
    found = rows.mapInArrow(run, "id long, y double, x array<double>").groupBy("id", "y").agg(F.min("x").alias("x")).toArrow().sort_by("id")
    x = found.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)
    return logistic(x, (found.column("y").to_numpy() > 0).astype(float))


def with_evidence(docs: DataFrame, model: Model, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """docs (all columns, or these) with evidence: the classifier's probability of a good document."""
    held = [f for f in docs.schema.fields if f.name not in OUTPUTS]
    kept = [f for f in held if columns is None or f.name in columns]
    schema = T.StructType([*kept, T.StructField("evidence", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, SLICE):
                found = model.evidence(features(*text_buffer(part.column(text))))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(found)], names=[f.name for f in schema.fields])

    return docs.select([F.col(f"`{f.name}`") for f in held]).mapInArrow(run, schema)


def prior(hosts: DataFrame) -> tuple[float, float]:
    """Mean and strength of the Beta prior of hosts (n, good), by the method of moments."""
    rate = F.col("good") / F.col("n")
    r = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.count(F.lit(1)).alias("hosts"), F.sum(F.col("n") * rate * rate).alias("sq"), F.sum(F.col("n") * F.col("n")).alias("nn")).first()
    if not r.n:
        return 0.5, 1.0
    mean = min(max(r.good / r.n, 1e-6), 1 - 1e-6)
    spread = r.sq - r.n * mean * mean  # weighted squares of host rates about the mean
    effective = r.n - r.nn / r.n
    noise = mean * (1 - mean)
    between = (spread - (r.hosts - 1) * noise) / effective if effective > 0 else 0.0
    strength = noise / between - 1 if between > 0 else 1e4
    return mean, float(min(max(strength, 1.0), 1e4))


def logit(p: Column) -> Column:
    safe = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    return F.ln(safe / (1 - safe))


def posterior(docs: DataFrame, labels: DataFrame, host: Column, path: Column, text: str = "text", key: str = "doc_id", columns: list[str] | None = None) -> DataFrame:
    """docs (all columns, or these) with evidence, host_rate, path_rate, quality (posterior) and keep.

    Each text is read once by the classifier; its rows are written with their evidence, and both
    the sums of sites and the posteriors are made from those.
    """
    spark = docs.sparkSession
    model = fit(docs, labels, text, key)
    names = [c for c in docs.columns if c not in OUTPUTS]
    wanted = names if columns is None else [c for c in columns if c in names]
    own = free_prefix(names)
    keys = [f"{own}host", f"{own}path"]
    site = [F.coalesce(F.concat(F.lit("="), x.cast("string")), F.lit("~")).alias(n) for x, n in zip((host, path), keys, strict=True)]
    rows = docs.select(*[F.col(f"`{c}`") for c in names], *site)
    scored = stored(spark, with_evidence(rows, model, text, [*wanted, *keys]), "evidence")
    # one row a site, summed in each task before it is shuffled
    sites = stored(spark, scored.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{own}n"), F.sum("evidence").alias(f"{own}good")), "sites")
    hosts = sites.groupBy(f"{own}host").agg(F.sum(f"{own}n").alias("n"), F.sum(f"{own}good").alias("good"))
    mean, strength = prior(hosts)
    hosts = hosts.select(f"{own}host", F.col("n").alias(f"{own}host_n"), F.col("good").alias(f"{own}host_good"))
    few = sites.count() <= BROADCAST_SITES
    sites = sites.join(F.broadcast(hosts) if few else hosts, f"{own}host")
    joined = scored.join(F.broadcast(sites), keys, "left") if few else salted_join(scored, sites, keys)
    e, n, good, host_n, host_good = (F.col(c) for c in ("evidence", f"{own}n", f"{own}good", f"{own}host_n", f"{own}host_good"))
    joined = joined.withColumn("host_rate", (host_good - e + strength * mean) / (host_n - 1 + strength))
    joined = joined.withColumn("path_rate", (good - e + PATH_STRENGTH * F.col("host_rate")) / (n - 1 + PATH_STRENGTH))
    odds = logit(e) + SITE_WEIGHT * (logit(F.col("path_rate")) - logit(F.lit(mean)))
    out = joined.withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn("keep", F.col("quality") >= LEAST)
    return out.select(*[F.col(f"`{c}`") for c in wanted], *OUTPUTS)
