"""Language identification by error-correcting output codes.

Each learned language has a codeword; one binary n-gram classifier predicts each bit: the mean,
over a text's byte trigrams, of the log odds of the languages with that bit against the others.
Decoding sums, over bits, a loss of how far the classifier's margin is from the codeword's bit,
weighted by how well that bit parts the languages in training, and takes the nearest codeword.
A text whose nearest two codewords are about as near is flagged as ambiguous.

Learning: about SAMPLE_DOCS texts of each language (chosen by a hash; a documented bound, since
a classifier gains little beyond), whole texts, at most MOST_LANGUAGES languages. Counts are
gathered by partial sums of at most 2**BITS buckets a language.

Cases: a null text or one without a letter is `und` with score 0; with no labelled rows all are
`und`; with one language all others are that one with score 1; texts of under three bytes have
no trigram and are ambiguous; ties go to the first language by code point; long texts are read
in windows; columns named like an output are replaced, others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import LOWER, slices, text_buffer

BITS = 15
SAMPLE_DOCS, MOST_LANGUAGES = 1500, 256
#: Trigrams that are scored at once.
WINDOW = 1 << 19
#: Relative distance of the two nearest codewords below which a text is ambiguous.
NEAR = 0.05
OUTPUTS = ("lang_pred", "lang_score", "lang_ambiguous")


@dataclass(frozen=True)
class Model:
    languages: list[str]
    codes: np.ndarray  # language x bit, of +1 and -1
    weights: np.ndarray  # bit x (bucket, and one empty bucket)
    trust: np.ndarray  # of each bit


def codebook(n: int) -> np.ndarray:
    """n codewords: the exhaustive code for few languages, else the best of seeded random codes."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 5:
        columns = [[(c >> i & 1) * 2 - 1 for i in range(n - 1)] + [1] for c in range(2 ** (n - 1) - 1)]
        return np.array(columns, float).T
    rng, width, best = np.random.default_rng(0), int(np.ceil(10 * np.log2(n))), (-1, None)
    for _ in range(100):
        code = rng.integers(0, 2, (n, width)) * 2.0 - 1
        apart = (width - code @ code.T) / 2
        np.fill_diagonal(apart, width)
        best = max(best, (float(apart.min()), code), key=lambda x: x[0])
    code = best[1]
    return code[:, np.abs(code.sum(axis=0)) < n]  # a bit that all share tells nothing


def buckets(data: np.ndarray, offsets: np.ndarray, a: int, b: int) -> np.ndarray:
    """The bucket of the trigram at each place from a to b; past a text's last, the empty one."""
    part = np.zeros(b - a + 2, np.uint32)
    part[: min(len(data), b + 2) - a] = LOWER[data[a : b + 2]]
    key = part[:-2] << np.uint32(16) | part[1:-1] << np.uint32(8) | part[2:]
    found = ((key * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int32)
    ends = offsets[1:]
    for back in (1, 2):
        last = ends - back
        last = last[(last >= a) & (last < b) & (last >= offsets[:-1])]
        found[last - a] = 1 << BITS
    return found


def count_trigrams(sample: DataFrame, text: str, lang: str) -> DataFrame:
    """lang, bucket, n over the sample: partial sums in each task, then one sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                for name in pc.unique(part.column("lang")).to_pylist():
                    own = part.filter(pc.equal(part.column("lang"), name))
                    data, offsets = text_buffer(own.column("text"))
                    total = sums.setdefault(name, np.zeros((1 << BITS) + 1, np.int64))
                    for a in range(0, len(data), WINDOW):
                        total += np.bincount(buckets(data, offsets, a, min(a + WINDOW, len(data))), minlength=len(total))
        for name, total in sums.items():
            at = np.flatnonzero(total[:-1])
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(total[at])], names=["lang", "bucket", "n"])

    rows = sample.select(F.col(lang).alias("lang"), F.col(text).cast("binary").alias("text"))
    counted = rows.mapInArrow(run, "lang string, bucket long, n long")
    return counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, learn_from: Column, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """A model from the rows where learn_from holds and lang and text are not null."""
    rows = docs.filter(learn_from & F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = rows.groupBy(lang).count().orderBy(F.desc("count"), lang).limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r[0], SAMPLE_DOCS / r[1])]) if sizes else None
    if share is None:
        return Model([], codebook(0), np.zeros((1, (1 << BITS) + 1)), np.zeros(1))
    drawn = F.pmod(F.xxhash64(F.lit(17), key, F.length(text)), F.lit(1_000_000)) / F.lit(1e6)
    found = count_trigrams(rows.filter(drawn < share[F.col(lang)]), text, lang).toArrow()
    languages = sorted(r[0] for r in sizes)
    at = {name: i for i, name in enumerate(languages)}
    counts = np.zeros((len(languages), 1 << BITS))
    counts[[at[x] for x in found.column("lang").to_pylist()], found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    rates = (counts + 0.1) / (counts.sum(axis=1, keepdims=True) + 0.1 * (1 << BITS))
    codes = codebook(len(languages))
    weights = np.zeros((codes.shape[1], (1 << BITS) + 1))
    for b, bits in enumerate(codes.T):
        if (bits > 0).any() and (bits < 0).any():
            weights[b, :-1] = np.log(rates[bits > 0].mean(axis=0)) - np.log(rates[bits < 0].mean(axis=0))
    margins = rates @ weights[:, :-1].T  # language x bit: what a text of the language can expect
    scale = np.maximum(np.abs(margins).mean(axis=0), 1e-9)
    weights /= scale[:, None]
    trust = np.clip((codes * margins / scale).min(axis=0), 0.05, None)
    return Model(languages, codes, weights.astype(np.float32), trust / trust.sum())


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text (text x bit): the nearest codeword, its score, and whether it is ambiguous."""
    n = len(model.languages)
    if n == 1:
        return np.zeros(len(margins), int), np.ones(len(margins)), np.zeros(len(margins), bool)
    loss = np.stack([(np.logaddexp(0, -2 * margins * code) * model.trust).sum(axis=1) for code in model.codes], axis=1)
    best = loss.argmin(axis=1)
    likely = np.exp(-4 * (loss - loss.min(axis=1, keepdims=True)))
    near = np.partition(loss, 1, axis=1)
    return best, 1 / likely.sum(axis=1), (near[:, 1] - near[:, 0]) < NEAR * near[:, 1]


def margins(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Text x bit: the mean weight of the text's trigrams."""
    n = len(offsets) - 1
    sums = np.zeros((n, len(model.weights)))
    full = np.flatnonzero(offsets[:-1] < offsets[1:])
    for a in range(0, len(data), WINDOW):
        b = min(a + WINDOW, len(data))
        found = buckets(data, offsets, a, b)
        own = full[(offsets[full] < b) & (offsets[full + 1] > a)]
        heads = np.maximum(offsets[own], a) - a
        for bit, weights in enumerate(model.weights):
            sums[own, bit] += np.add.reduceat(weights[found], heads, dtype=np.float64)
    return sums / np.maximum(1, np.diff(offsets) - 2)[:, None]


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, lang_score (0 to 1) and lang_ambiguous."""
    kept = [f for f in docs.schema.fields if f.name not in OUTPUTS]
    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    schema = T.StructType([*kept, *(T.StructField(c, k) for c, k in zip(OUTPUTS, kinds, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                letters = np.array([any(map(str.isalpha, t or "")) for t in part.column(text).to_pylist()], bool)
                if model.languages:
                    best, score, unsure = decode(model, margins(model, *text_buffer(part.column(text))))
                    names = np.array(model.languages, object)[best]
                else:
                    letters, names = letters & False, np.array([""] * len(letters), object)
                    score, unsure = np.zeros(len(letters)), letters
                names, score = np.where(letters, names, "und"), np.where(letters, score, 0.0)
                made = [pa.array(names, pa.string()), pa.array(score), pa.array(unsure & letters)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[f.name for f in schema.fields])

    return docs.select([F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)


def held_out(key: str = "doc_id") -> Column:
    """Whether the CRC-32 of the id's decimal text leaves no remainder by 5 (a null id: not)."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))
