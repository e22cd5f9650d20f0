"""Alignment of two tokenizers' tokens by the bytes they cover.

A is a byte-level BPE (read by `tokenizers`), B a SentencePiece model that marks word starts. Both
encode a space and the text. A transducer with a dangling suffix walks over both sequences at once: its
state is the side that leads and the bytes of it that the other side hasn't matched yet. The lagging
side's next token takes bytes away from it or takes the lead; where nothing is left, both sides end at
one byte, and a group closes. Transitions are memoised by state and next token. All pairs of an A and a
B token of one group are linked.

Neither side has a token over the start of a word (a space behind a character that surely isn't white
space), so the residual is empty there: texts fall into independent segments, of which a worker encodes
and aligns each once. A model of which that isn't known gets its texts whole.

How many documents hold an id pair is counted over the corpus. The most frequent pairs, at most
HEAD_PAIRS, are broadcast to the documents' pairs; the rest meet them in a join by pair.

Cases: a null or empty text, and one whose tokens' bytes aren't a space and the text (one that holds
U+2581), has no tokens and counts zero; strings of special tokens are plain text; long texts are
read whole; equal texts and rows of one doc_id are documents of their own; an empty table gives an
empty result; other columns play no part.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import discard_but, list_array, made_so_far, salted_join, slices, stored
from plumbline.llm.sentencepiece_codec import MARK, codec

#: Pairs whose counts are broadcast, at most.
HEAD_PAIRS = 1_000_000
#: Segments, and pairs of segments, after which a worker forgets what it has aligned.
KEPT_SEGMENTS, KEPT_PAIRS = 250_000, 4_000_000
#: Bytes of text that are aligned at once.
SLICE = 1 << 19
#: Segments up to which the transducer takes them one by one; pairs of tokens of a group up to which they are made one by one.
FEW, CROSSED = 16, 4096
#: A pair is its A id times this, and its B id.
WIDE = 1 << 32
#: A word starts at a space behind a printable character of ASCII or a letter of Latin.
WORD_START = re.compile("(?<=[!-~À-ɏ])(?= )")
#: Fixed value: what a byte-level BPE takes for words.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Transducer:
    """Walks over two token sequences of the same bytes; states and transitions are numbered.

    The state says which side is to move: A, unless A leads. So a state and a token's id are a transition.
    """

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]) -> None:
        self.bytes = (a_bytes, b_bytes)
        self.vocabulary = max(len(a_bytes), len(b_bytes))
        #: States by number: whether A leads, and what of it is unmatched; the first has nothing.
        self.states: list[tuple[bool, bytes]] = [(False, b"")]
        self.numbers: dict[tuple[bool, bytes], int] = {self.states[0]: 0}
        self.leads = np.zeros(1024, bool)
        #: Transitions: state * vocabulary + token to the next state, as a table and in order.
        self.memo: dict[int, int] = {}
        self.keys, self.after = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def step(self, key: int) -> int:
        """The state after a transition, which is learnt at its first use."""
        if key not in self.memo:
            state, token = divmod(key, self.vocabulary)
            leads, rest = self.states[state]
            new = self.bytes[leads][token]
            if rest.startswith(new):
                after = (leads, rest[len(new) :])
            elif new.startswith(rest):
                after = (not leads, new[len(rest) :])
            else:
                raise ValueError("tokens of different bytes")
            after = after if after[1] else self.states[0]
            if after not in self.numbers:
                self.numbers[after] = len(self.states)
                self.states.append(after)
                if len(self.states) > len(self.leads):
                    self.leads = np.concatenate([self.leads, np.zeros_like(self.leads)])
                self.leads[len(self.states) - 1] = after[0]
            self.memo[key] = self.numbers[after]
        return self.memo[key]

    def steps(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        if not known.all():
            new = np.unique(keys[~known])
            where = np.searchsorted(self.keys, new)
            self.after = np.insert(self.after, where, [self.step(k) for k in new.tolist()])
            self.keys = np.insert(self.keys, where, new)
            at = np.searchsorted(self.keys, keys)
        return self.after[at]

    def groups(self, a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of many segments at once, whose tokens end at a_ends and b_ends: each A and each B token's group
        within its segment, and how many groups each segment has."""
        i, j = (np.concatenate([[0], x[:-1]]).astype(np.int64) for x in (a_ends, b_ends))
        of_a, of_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        state, closed = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        live = np.flatnonzero((i < a_ends) | (j < b_ends))
        while len(live) > FEW:
            s = state[live]
            mine = ~self.leads[s]
            left, right = live[mine], live[~mine]
            token = np.empty(len(live), np.int64)
            token[mine], token[~mine] = a[i[left]], b[j[right]]
            of_a[i[left]], of_b[j[right]] = closed[left], closed[right]
            i[left] += 1
            j[right] += 1
            state[live] = s = self.steps(s * self.vocabulary + token)
            closed[live] += s == 0
            live = live[(i[live] < a_ends[live]) | (j[live] < b_ends[live])]
        for lane in live.tolist():  # the few longest, one by one
            x, y, s, g = int(i[lane]), int(j[lane]), int(state[lane]), int(closed[lane])
            while x < a_ends[lane] or y < b_ends[lane]:
                if self.states[s][0]:
                    token, of_b[y], y = int(b[y]), g, y + 1
                else:
                    token, of_a[x], x = int(a[x]), g, x + 1
                s = self.step(s * self.vocabulary + token)
                g += s == 0
            closed[lane] = g
        return of_a, of_b, closed


def byte_level() -> dict[str, int]:
    """The byte for which a character of a byte-level vocabulary stands: printable ones for
    themselves, others in order from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers, and where each list ends."""
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(counts.sum())), np.cumsum(counts)


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... of counts[i] numbers, for all i."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


class Aligner:
    """Both tokenizers and what a worker has aligned."""

    def __init__(self, a: str, b: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from sentencepiece import sentencepiece_model_pb2 as pb
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a)
        self.a.encode_special_tokens = True
        self.b = codec(b)
        to_byte = byte_level()
        ranks = {bytes(to_byte[c] for c in t): i for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        a_bytes = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            a_bytes[i] = t
        #: The same vocabulary and word pattern, for segments of ASCII, in which libraries agree on what is a letter.
        self.ascii = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        pieces = pb.ModelProto.FromString(b).pieces
        b_bytes = [bytes([int(p.piece[1:-1], 16)]) if p.type == p.BYTE else p.piece.replace(MARK, " ").encode() for p in pieces]
        self.split = self.b.split and self.b.prefix and not self.b.squeeze and not self.b.map.units
        self.transducer = Transducer(a_bytes, b_bytes)
        most = max(len(a_bytes), len(b_bytes))
        width = len(str(most - 1))
        #: Decimal digits of ids, with room for a mark behind them, and how many they are.
        self.digits = np.zeros((most, width + 1), np.uint8)
        self.n_digits = np.array([len(str(i)) for i in range(most)])
        self.digits[:, :width] = np.array([str(i).ljust(width).encode() for i in range(most)]).view(np.uint8).reshape(most, width)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.texts: list[str] = []
        self.numbers = np.zeros((0, 4), np.int64)  # tokens of A and of B, groups, links
        self.whole = np.zeros(0, bool)
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.starts, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def segments(self, text: str) -> list[str]:
        return WORD_START.split(" " + text) if self.split else [" " + text]

    def encode(self, new: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        plain = list(map(str.isascii, new))
        fast = map(self.ascii.encode_ordinary, [s for s, p in zip(new, plain, strict=True) if p])
        slow = iter(self.a.encode_batch_fast([s for s, p in zip(new, plain, strict=True) if not p], add_special_tokens=False))
        left = [next(fast) if p else next(slow).ids for p in plain]
        right = self.b.plain.encode(new, num_threads=1) if self.split else self.b.whole.encode([s[1:] for s in new], num_threads=1)
        return left, right

    def learn(self, new: list[str]) -> None:
        left, right = self.encode(new)
        a_bytes, b_bytes = self.transducer.bytes
        raw = [s.encode() for s in new]
        fits = np.array([b"".join([a_bytes[i] for i in x]) == r == b"".join([b_bytes[i] for i in y]) for x, y, r in zip(left, right, raw, strict=True)])
        kept = np.flatnonzero(fits).tolist()
        a, a_ends = _flat([left[i] for i in kept])
        b, b_ends = _flat([right[i] for i in kept])
        of_a, of_b, groups = self.transducer.groups(a, a_ends, b, b_ends)
        heads = np.cumsum(groups) - groups
        n_a, n_b = np.diff(a_ends, prepend=0), np.diff(b_ends, prepend=0)
        of_a, of_b = of_a + np.repeat(heads, n_a), of_b + np.repeat(heads, n_b)
        total = int(groups.sum())
        in_a, in_b = np.bincount(of_a, minlength=total), np.bincount(of_b, minlength=total)
        seg = np.repeat(np.arange(len(kept)), groups)
        links = np.bincount(seg, in_a * in_b, minlength=len(kept)).astype(np.int64)
        numbers = np.zeros((len(new), 4), np.int64)
        numbers[kept] = np.stack([n_a, n_b, groups, links], axis=1)
        texts = dict(zip(kept, self._shown(a, b, of_a, of_b, in_a, in_b, heads[groups > 0], len(kept)), strict=True))
        pairs, times, per = self._pairs(a, b, in_a, in_b, seg, len(kept))
        counts = np.zeros(len(new), np.int64)
        counts[kept] = per
        at = len(self.texts)
        self.index.update(zip(new, range(at, at + len(new)), strict=True))
        self.texts += [texts.get(i, "") for i in range(len(new))]
        self.starts = np.concatenate([self.starts, len(self.pairs) + np.cumsum(counts) - counts])
        for name, more in (("numbers", numbers), ("whole", fits), ("pairs", pairs), ("times", times), ("counts", counts)):
            setattr(self, name, np.concatenate([getattr(self, name), more]))

    def _shown(self, a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, heads: np.ndarray, segments: int) -> list[str]:
        """Of each segment, `a1,a2|b1;a3|b2,b3`: its groups' ids."""
        upto_a, upto_b = np.cumsum(in_a), np.cumsum(in_b)
        at_a, at_b = np.arange(len(a)) + (upto_b - in_b)[of_a], np.arange(len(b)) + upto_a[of_b]
        ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[at_a], ids[at_b] = a, b
        ends = upto_a + upto_b  # of groups
        mark[ends - in_b - 1], mark[ends - 1] = ord("|"), ord(";")
        last = ends[np.append(heads[1:], len(ends)) - 1] - 1 if len(ends) else np.zeros(0, np.int64)
        size = self.n_digits[ids]
        cells = self.digits[ids]
        cells[np.arange(len(ids)), size] = mark
        size = size + 1
        size[last] -= 1
        shown = cells[np.arange(cells.shape[1]) < size[:, None]].tobytes().decode("ascii")
        cuts = [0, *np.cumsum(size)[last].tolist()]
        return [shown[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]

    @staticmethod
    def _pairs(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, seg: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct id pairs of each segment, how often each is linked, and the number of pairs."""
        from_a, from_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        some = in_a * in_b <= CROSSED
        n, m = in_a[some], in_b[some]
        first = _ragged(from_a[some], n)
        repeats = np.repeat(m, n)
        code = np.repeat(a[first], repeats) * WIDE + b[_ragged(np.repeat(from_b[some], n), repeats)]
        owner, count = np.repeat(seg[some], n * m), np.ones(len(code), np.int64)
        more = []
        for g in np.flatnonzero(~some).tolist():  # many tokens in one group: their distinct ids are crossed
            x, y = Counter(a[from_a[g] : from_a[g] + in_a[g]].tolist()), Counter(b[from_b[g] : from_b[g] + in_b[g]].tolist())
            more += [(int(seg[g]), p * WIDE + q, k * l) for p, k in x.items() for q, l in y.items()]
        if more:
            owner, code, count = (np.concatenate([x, np.array(y, np.int64)]) for x, y in zip((owner, code, count), zip(*more, strict=True), strict=True))
        return _added(owner, code, count, segments)

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: tokens of A and B, groups and links (a row of four), the groups' digest; and its
        distinct id pairs, how often each is linked, and the number of pairs."""
        if len(self.index) > KEPT_SEGMENTS or len(self.pairs) > KEPT_PAIRS:
            self.forget()
        cut = [self.segments(t) if t else [] for t in texts]
        new = [s for s in dict.fromkeys(chain.from_iterable(cut)) if s not in self.index]
        if new:
            self.learn(new)
        per = np.fromiter(map(len, cut), np.int64, len(cut))
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(cut)), np.int64, int(per.sum()))
        owner = np.repeat(np.arange(len(cut)), per)
        odd = np.bincount(owner[~self.whole[at]], minlength=len(cut)) > 0
        at, owner = at[~odd[owner]], owner[~odd[owner]]
        numbers = np.stack([np.bincount(owner, x, minlength=len(cut)).astype(np.int64) for x in self.numbers[at].T], axis=1)
        bounds, places, shas = np.searchsorted(owner, np.arange(len(cut) + 1)).tolist(), at.tolist(), []
        for x, y in zip(bounds, bounds[1:], strict=False):
            digest = hashlib.sha256()
            for k in range(x, y, 65_536):  # of a long text, some segments at a time
                digest.update(((";" if k > x else "") + ";".join(map(self.texts.__getitem__, places[k : min(y, k + 65_536)]))).encode())
            shas.append(digest.hexdigest() if y > x else "")
        step, repeats = np.unique(owner * max(len(self.texts), 1) + at, return_counts=True)  # a segment once a text
        seg = step % max(len(self.texts), 1)
        counts = self.counts[seg]
        which = _ragged(self.starts[seg], counts)
        return numbers, shas, *_added(np.repeat(step // max(len(self.texts), 1), counts), self.pairs[which], self.times[which] * np.repeat(repeats, counts), len(cut))


def _added(owner: np.ndarray, code: np.ndarray, count: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct codes of each owner, their counts added up, and how many codes each owner has."""
    order = np.lexsort((code, owner))
    owner, code = owner[order], code[order]
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])])[: len(owner)])
    added = np.add.reduceat(count[order], first) if len(first) else count
    return code[first], added, np.bincount(owner[first], minlength=owners)


_aligners: dict[tuple[str, bytes], Aligner] = {}


def aligner(a: str, b: bytes) -> Aligner:
    if (a, b) not in _aligners:
        _aligners.clear()
        _aligners[a, b] = Aligner(a, b)
    return _aligners[a, b]


def aligned(docs: DataFrame, a: str, b: bytes, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs (distinct, as A id * WIDE + B id) and
    times (how often each is linked). a: the first tokenizer's JSON; b: the second's model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a, b)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                numbers, shas, pairs, times, per = own.align(part.column("text").to_pylist())
                columns = [part.column("doc_id"), *map(pa.array, numbers.T.copy()), pa.array(shas, pa.string())]
                columns += [list_array(x, per, pa.int64()) for x in (pairs, times)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
    kinds = ["long"] * 5 + ["string"] + ["array<long>"] * 2
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, ", ".join(map(" ".join, zip(names, kinds, strict=True))))


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked), best (whether no other pair of its A id has more)."""
    counts = found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(found.sparkSession, counts, "pairs")
    own = F.shiftright("pair", 32).alias("a")
    most = counts.groupBy(own).agg(F.max("n").alias("most"))
    return counts.select("pair", "n", own).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, a: str, b: bytes, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair no other of its A id outnumbers),
    count_sum (over links, of the documents that hold the pair), groups_sha256."""
    spark, mark = docs.sparkSession, made_so_far()
    found = stored(spark, aligned(docs, a, b, text, key).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = stored(spark, pair_counts(found), "counts")
    # the head: pairs of at least 2 ** k documents, for the least k under which it fits
    sizes = counts.agg(*[F.count_if(F.col("n") >= (1 << k)).alias(str(k)) for k in range(48)]).first()
    least = next(1 << k for k in range(48) if sizes[str(k)] <= HEAD_PAIRS)
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum")]
    each = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("e")).select("row", F.col("e.pairs").alias("pair"), F.col("e.times").alias("times"))
    head = F.broadcast(counts.filter(F.col("n") >= least))
    scored = each.join(head, "pair").groupBy("row").agg(*sums)
    if least > 1:
        rest = stored(spark, each.join(head, "pair", "left_anti"), "rest")
        tail = salted_join(rest, counts.filter(F.col("n") < least), ["pair"], "inner").groupBy("row").agg(*sums)
        scored = scored.union(tail).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    scored = stored(spark, scored, "scored")
    discard_but(spark, mark, found, scored)
    none = F.lit(0).cast("long")
    return found.drop("pairs", "times").join(scored, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256"
    )
