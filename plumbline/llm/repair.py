"""Repair of the structure of conversations by least edits.

A repaired conversation is an optional system turn and then user and assistant in turns, or nothing.
Rows may be kept (K, 0), given the role user or assistant (R, 2), or deleted (D, 3; blank rows and
repeats must be); empty turns may be inserted (I, 2); a truncated row that stays adds 1. Positions and
the states of the pattern are the nodes of a graph and edits its arcs. Least costs from the start and to
the end tell which arcs are tight, that is, on some cheapest way: those whose own cost fills the gap
between both. Over tight arcs alone, the set of nodes that the edits so far lead to moves by the least
letter that any of its nodes offers, which gives the least string of letters. A state and a letter lead to
one state, so a set that starts with one node stays one.

Rows are sorted over the cluster by conversation and turn, equal rows counted. A conversation may hold a
third of all rows, so it is cut into segments of at most SEGMENT rows. A segment has a (min, +) matrix of
costs between states; a scan of these small matrices gives costs at all segment bounds, then each
segment walks by itself from each state that a cheapest way may enter it in, and a scan of the states
says which of these walks count. A digest is by nature made in order: the repaired texts of a
conversation of several segments stream through one task, which holds one batch of them.

Cases: rows whose conv_id is null form one conversation; a null turn comes first (where a turn is the
least long, with it); a null role or text is one space; rows of one turn are in order of role and text;
equal rows are repeats of the first; a role other than those that start with s, u or a, in lower case,
fits nowhere; a conversation without rows (all `copies` zero) has zeros, no edits and the digest of the
empty string; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import discard_but, made_so_far, salted_join, stored

#: Rows and characters of a segment.
SEGMENT, SEGMENT_CHARS = 256, 1 << 20
#: Segments that are worked on at once.
LANES = 512
#: Repeated messages up to which they are broadcast.
BROADCAST_REPEATS = 200_000
#: White space, marks that end a sentence, costs of edits.
SPACES, MARKS = " \t\n\x0b\x0c\r", ".!?"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States: nothing yet, behind the system turn, behind a user, behind an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)  # what an inserted or renamed turn leads to
KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "": {}}
ROLE = {USER: "user", ASSISTANT: "assistant"}
FAR = 1 << 40  # no way
LEAST = -(1 << 63)
SEQUENCES = ("su", "ua", "au")


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(min, +) product of stacks of matrices."""
    return np.minimum((a[..., :, :, None] + b[..., None, :, :]).min(axis=-2), FAR)


def _inserts() -> np.ndarray:
    one = np.full((4, 4), FAR)
    one[range(4), range(4)] = 0
    one[range(4), NEXT] = np.minimum(one[range(4), NEXT], INSERT)
    return product(product(one, one), one)


def _row(initial: str, truncated: bool, forced: bool) -> np.ndarray:
    out = np.full((4, 4), FAR)
    out[range(4), range(4)] = DELETE
    if not forced:
        for s in range(4):
            out[s, NEXT[s]] = min(out[s, NEXT[s]], REROLE + TRUNCATED * truncated)
            if s in KEEP[initial]:
                out[s, KEEP[initial][s]] = TRUNCATED * truncated
    return out


#: Kinds of rows: to be deleted, or an initial, truncated or not.
KINDS = [("", False, True), *((c, t, False) for c in KEEP for t in (False, True))]
KIND = {k: i for i, k in enumerate(KINDS)}
ROWS, INSERTS = np.stack([_row(*k) for k in KINDS]), _inserts()
#: A row with what may be inserted before it, or behind it.
BEFORE, BEHIND = product(INSERTS[None], ROWS), product(ROWS, INSERTS[None])
ENTER = np.array([0, FAR, FAR, FAR])
#: From each state to the end: what must still be inserted.
LEAVE = INSERTS[:, [START, ASSISTANT]].min(axis=1)


def damage(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text, copies: rows damaged by crc32 of `conv_id:turn`, mod 20. 0 drops the row
    (no copies), 1 empties its text, 2 takes its sentence marks, 3 repeats it, 4 makes it the user's."""

    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.pmod(F.crc32(F.concat(shown(conv), F.lit(":"), shown(turn)).cast("binary")), F.lit(20))
    return conversations.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.when(kind == 0, "").when(kind == 4, "user").otherwise(shown(role)).alias("role"),
        F.when(kind <= 1, "").when(kind == 2, F.translate(shown(text), MARKS, "")).otherwise(shown(text)).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _sorted(rows: DataFrame) -> DataFrame:
    """conv, conv_id, turn, role, text, n, blank, seen, truncated: distinct rows, in order over the partitions."""
    rows = rows.select(
        F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit("n")).alias("conv"), "conv_id", F.coalesce("turn", F.lit(LEAST)).alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "copies",
    )
    digest = F.sha2(F.col("text").cast("binary"), 256).alias("digest")
    firsts = rows.filter("copies > 0").select("conv", "role", digest, "turn").groupBy("conv", "role", "digest")
    firsts = stored(rows.sparkSession, firsts.agg(F.min("turn").alias("first"), F.max("turn").alias("_last")).filter("first < _last").drop("_last"), "repeats")
    rows = rows.withColumn("digest", digest)
    if firsts.count() <= BROADCAST_REPEATS:
        rows = rows.join(F.broadcast(firsts), ["conv", "role", "digest"], "left")
    else:
        rows = salted_join(rows, firsts, ["conv", "role", "digest"])
    keys = ["conv", "turn", "role", "text"]
    rows = rows.groupBy(*keys, "conv_id").agg(F.sum("copies").alias("n"), F.coalesce(F.min("first") < F.col("turn"), F.lit(False)).alias("seen"))
    solid = F.rtrim(F.col("text"), F.lit(SPACES))
    ends = F.right(solid, F.lit(1)).isin(*MARKS)
    return rows.select(*keys, "conv_id", "n", (solid == "").alias("blank"), "seen", (~ends).alias("truncated")).repartitionByRange(*keys).sortWithinPartitions(*keys)


COUNTS = ["n", "blank", "duplicate", "truncated", "illegal", "extra", "turns"]
#: A segment: its place, whether it is a whole conversation, counts, bounds, its rows and its matrix.
SEGMENTS = (
    "conv string, conv_id long, part int, seg int, whole boolean, " + ", ".join(f"{c} long" for c in COUNTS) + ", low long, high long, first string, last string, "
    "kinds array<int>, copies array<long>, roles array<string>, texts array<string>, matrix array<long>"
)


class _Segment:
    """Rows of one conversation, in order, as they are told."""

    def __init__(self, conv: str, conv_id: int | None, seg: int):
        self.conv, self.conv_id, self.seg = conv, conv_id, seg
        self.count = dict.fromkeys(COUNTS, 0)
        self.low = self.high = self.first = self.last = None
        self.kinds, self.copies, self.roles, self.texts, self.chars = [], [], [], [], 0

    def add(self, turn: int, role: str, text: str, n: int, blank: bool, seen: bool, truncated: bool) -> None:
        if not n:
            return
        c, initial = self.count, role[:1]
        c["n"] += n
        c["blank"] += n if blank else 0
        c["duplicate"] += 0 if blank else n - 1 + seen
        truncated = truncated and not blank and not seen
        c["truncated"] += truncated
        c["illegal"] += n - 1  # a role never follows itself
        if self.last is not None:
            c["illegal"] += self.last + initial not in SEQUENCES
        c["extra"] += DELETE * (n - 1)
        if turn != LEAST and turn != self.high:
            c["turns"] += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        self.first, self.last = initial if self.first is None else self.first, initial
        forced = blank or seen
        self.kinds.append(KIND["", False, True] if forced else KIND[initial if initial in KEEP else "", truncated, False])
        self.copies.append(n)
        self.roles.append(role)
        self.texts.append("" if forced else text)
        self.chars += len(text)


def lanes(kinds: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The longest first: their order, lengths, and kinds by step and lane."""
    lengths = np.array([len(k) for k in kinds])
    order = np.argsort(-lengths, kind="stable")
    steps = np.zeros((int(lengths.max(initial=0)), len(kinds)), np.int64)
    for lane, i in enumerate(order.tolist()):
        steps[: lengths[i], lane] = kinds[i]
    return order, lengths[order], steps


def matrices(kinds: list[list[int]]) -> np.ndarray:
    """By segment, least costs from each state at its start to each behind its last row."""
    order, lengths, steps = lanes(kinds)
    out = np.full((len(kinds), 4, 4), FAR)
    out[:, range(4), range(4)] = 0
    for i, step in enumerate(steps):
        n = int((lengths > i).sum())
        out[:n] = product(out[:n], BEFORE[step[:n]])
    back = np.empty_like(out)
    back[order] = out
    return back


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, held, now, first = TaskContext.get().partitionId(), [], None, True

    def emit() -> pa.RecordBatch:
        made = matrices([s.kinds for s, _ in held]).reshape(len(held), 16)
        rows = [
            {"conv": s.conv, "conv_id": s.conv_id, "part": part, "seg": s.seg, "whole": whole, **s.count, "low": s.low, "high": s.high, "first": s.first, "last": s.last,
             "kinds": s.kinds, "copies": s.copies, "roles": s.roles, "texts": s.texts, "matrix": m}
            for (s, whole), m in zip(held, made.tolist(), strict=True)
        ]
        held.clear()
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    ints = pa.int64()
    schema = pa.schema(
        [("conv", pa.string()), ("conv_id", ints), ("part", pa.int32()), ("seg", pa.int32()), ("whole", pa.bool_()), *((c, ints) for c in COUNTS), ("low", ints), ("high", ints), ("first", pa.string()), ("last", pa.string()),
         ("kinds", pa.list_(pa.int32())), ("copies", pa.list_(ints)), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("matrix", pa.list_(ints))]
    )
    names = ["conv", "conv_id", "turn", "role", "text", "n", "blank", "seen", "truncated"]
    chars = 0
    for batch in batches:
        for conv, conv_id, *row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if now is not None and conv != now.conv:
                held.append((now, not first and now.seg == 0))
                chars += now.chars
                now, first = None, False
            elif now is not None and (len(now.kinds) >= SEGMENT or now.chars >= SEGMENT_CHARS):
                held.append((now, False))
                chars += now.chars
                now = _Segment(conv, conv_id, now.seg + 1)
            now = now or _Segment(conv, conv_id, 0)
            now.add(*row)
            if len(held) >= LANES or chars > 8 * SEGMENT_CHARS:
                yield emit()
                chars = 0
    if now is not None:
        held.append((now, False))  # it may go on in the next partition
        yield emit()


def _bounds(segments: pd.DataFrame) -> pd.DataFrame:
    """Of one conversation's segments: costs at their bounds, and what is summed over all of them."""
    s = segments.sort_values(["part", "seg"])
    made = np.array(s["matrix"].tolist(), np.int64).reshape(-1, 4, 4)
    enter, leave = [ENTER], [LEAVE]
    for m in made:
        enter.append(product(enter[-1][None], m)[0])
    for m in made[::-1]:
        leave.append(product(m, leave[-1][:, None])[:, 0])
    turns, illegal, high, last, low = int(s["turns"].sum()), int(s["illegal"].sum()), None, None, None
    for n, a, b, x, y in zip(s["n"], s["low"], s["high"], s["first"], s["last"], strict=True):
        if n:
            illegal += last is not None and last + x not in SEQUENCES
            last = y
        if n and not pd.isna(a):
            turns -= high is not None and a == high
            low, high = a if low is None else low, b
    return pd.DataFrame({
        "conv": s["conv"], "part": s["part"], "seg": s["seg"], "enter": [x.tolist() for x in enter[:-1]], "leave": [x.tolist() for x in leave[-2::-1]],
        "last_one": [False] * (len(s) - 1) + [True], "sums": [[int(s[c].sum()) for c in ("blank", "duplicate", "truncated")] + [illegal, int(s["extra"].sum()), 0 if low is None else int(high) - int(low) + 1 - turns]] * len(s),
    })


def walk(kinds: list[int], copies: list[int], roles: list[str], texts: list[str], ahead: list, behind: list, total: int, state: int, end: bool) -> tuple[int, str, list[str]]:
    """The least letters over tight arcs from a state on: the state they lead to, the letters, the repaired turns.
    ahead and behind: by position and state, least costs from the start and to the end."""
    at, n, frontier, letters, lines = 0, len(kinds), {state}, [], []
    while at < n or end:
        if at == n and any(s in (START, ASSISTANT) and ahead[n][s] == total for s in frontier):
            break
        initial, cut, forced = KINDS[kinds[at]] if at < n else ("", False, True)

        def tight(s: int, cost: int, to: int, step: int) -> bool:
            return ahead[at][s] + cost + behind[at + step][to] == total  # noqa: B023

        moves = {"D": {s for s in frontier if at < n and tight(s, DELETE, s, 1)}, "I": {NEXT[s] for s in frontier if tight(s, INSERT, NEXT[s], 0)}}
        if not forced:
            moves["K"] = {KEEP[initial][s] for s in frontier if s in KEEP[initial] and tight(s, cut * TRUNCATED, KEEP[initial][s], 1)}
            moves["R"] = {NEXT[s] for s in frontier if tight(s, REROLE + cut * TRUNCATED, NEXT[s], 1)}
        letter = min(x for x, to in moves.items() if to)
        frontier = moves[letter]
        letters.append(letter)
        (state,) = frontier
        if letter == "I":
            lines.append(f"{ROLE[state]}:")
            continue
        if letter != "D":
            lines.append(f"{roles[at] if letter == 'K' else ROLE[state]}:{texts[at]}")
        letters.append("D" * (copies[at] - 1))
        at += 1
    return state, "".join(letters), lines


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each segment's walks from the states that a cheapest way may enter it in."""
    for batch in batches:
        for a in range(0, batch.num_rows, LANES):
            rows = batch.slice(a, LANES)
            kinds = rows.column("kinds").to_pylist()
            order, lengths, steps = lanes(kinds)
            enter, leave = (np.array(rows.column(c).to_pylist(), np.int64)[order] for c in ("enter", "leave"))
            ahead = np.full((len(steps) + 1, len(kinds), 4), FAR)
            behind = np.full_like(ahead, FAR)
            ahead[0] = product(enter[:, None, :], INSERTS[None])[:, 0]
            behind[lengths, range(len(kinds))] = leave
            for i, step in enumerate(steps):
                n = int((lengths > i).sum())
                ahead[i + 1, :n] = product(ahead[i, :n, None, :], BEHIND[step[:n]])[:, 0]
            for i in range(len(steps) - 1, -1, -1):
                n = int((lengths > i).sum())
                behind[i, :n] = product(BEFORE[steps[i, :n]], behind[i + 1, :n, :, None])[:, :, 0]
            part = rows.select(["conv", "conv_id", "part", "seg", "last_one", "sums"])
            each = list(zip(kinds, *(rows.column(c).to_pylist() for c in ("copies", "roles", "texts", "last_one")), strict=True))
            out = []
            for lane, i in enumerate(order.tolist()):
                kind, copies, roles, texts, end = each[i]
                f, b = ahead[: len(kind) + 1, lane].tolist(), behind[: len(kind) + 1, lane].tolist()
                starts = (enter[lane] + np.array(b[0])).tolist()
                total = min(starts)
                for s in range(4):
                    if starts[s] == total:
                        state, letters, lines = walk(kind, copies, roles, texts, f, b, total, s, end)
                        out.append((i, s, state, letters, "\n".join(lines), len(lines), total))
            at, entry, exit_, letters, body, n_lines, total = zip(*out, strict=True)
            part = part.take(pa.array(at, pa.int32()))
            found = {"entry": pa.array(entry, pa.int32()), "exit": pa.array(exit_, pa.int32()), "audit": pa.array(letters, pa.string()), "body": pa.array(body, pa.string()), "lines": pa.array(n_lines, pa.int32()), "total": pa.array(total, pa.int64())}
            yield pa.RecordBatch.from_arrays([*part.columns, *found.values()], names=[*part.schema.names, *found])


WALKS = "conv string, conv_id long, part int, seg int, last_one boolean, sums array<long>, entry int, exit int, audit string, body string, lines int, total long"


def _route(walks: pd.DataFrame) -> pd.DataFrame:
    """Of one conversation's walks, those that follow on each other from the start."""
    state, rows = START, []
    steps = {}
    for p, g, a, b in zip(walks["part"], walks["seg"], walks["entry"], walks["exit"], strict=True):
        steps.setdefault((p, g), {})[a] = b
    for p, g in sorted(steps):
        rows.append((walks["conv"].iloc[0], p, g, state))
        state = steps[p, g][state]
    return pd.DataFrame(rows, columns=["conv", "part", "seg", "entry"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chosen walks in order: one row a conversation."""
    now, last, letters, digest, any_ = None, None, [], None, False

    def emit() -> pa.RecordBatch:
        row = {**last, "audit": "".join(letters), "repaired_sha256": digest.hexdigest()}
        return pa.RecordBatch.from_pylist([row], schema=schema)

    schema = pa.schema([("conv_id", pa.int64()), ("sums", pa.list_(pa.int64())), ("total", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    for batch in batches:
        for i, conv in enumerate(batch.column("conv").to_pylist()):
            if conv != now:
                if now is not None:
                    yield emit()
                now, letters, digest, any_ = conv, [], hashlib.sha256(), False
                last = {c: batch.column(c)[i].as_py() for c in ("conv_id", "sums", "total")}
            letters.append(batch.column("audit")[i].as_py())
            if batch.column("lines")[i].as_py():
                digest.update((("\n" if any_ else "") + batch.column("body")[i].as_py()).encode())
                any_ = True
    if now is not None:
        yield emit()


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    rows: conv_id (long), turn, role, text and how many copies there are of the row (zero: none, but the
    conversation is still returned)."""
    spark, mark = rows.sparkSession, made_so_far()
    packed = stored(spark, _sorted(rows).mapInArrow(_pack, SEGMENTS), "segments")
    body = ["conv", "conv_id", "part", "seg", "kinds", "copies", "roles", "texts"]
    longs = [F.array(*map(F.lit, x.tolist())).cast("array<long>") for x in (ENTER, LEAVE)]
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    alone = packed.filter("whole").select(
        *body, longs[0].alias("enter"), longs[1].alias("leave"), F.lit(True).alias("last_one"), F.array("blank", "duplicate", "truncated", "illegal", "extra", gaps).alias("sums")
    )
    walks = alone.mapInArrow(_walks, WALKS)
    done = walks.select("conv_id", "sums", "total", "audit", F.sha2(F.col("body").cast("binary"), 256).alias("repaired_sha256"))
    slim = packed.filter("not whole").select("conv", "part", "seg", *COUNTS, "low", "high", "first", "last", "matrix")
    bounds = slim.groupBy("conv").applyInPandas(_bounds, "conv string, part int, seg int, enter array<long>, leave array<long>, last_one boolean, sums array<long>")
    parts = packed.filter("not whole").select(*body).join(bounds, ["conv", "part", "seg"])
    parts = stored(spark, parts.mapInArrow(_walks, WALKS), "walks")
    chosen = parts.select("conv", "part", "seg", "entry", "exit").groupBy("conv").applyInPandas(_route, "conv string, part int, seg int, entry int")
    chosen = parts.join(chosen, ["conv", "part", "seg", "entry"]).repartition("conv").sortWithinPartitions("conv", "part", "seg")
    several = chosen.mapInArrow(_digests, "conv_id long, sums array<long>, total long, audit string, repaired_sha256 string")
    discard_but(spark, mark, packed, parts)
    out = done.union(several)
    s = F.col("sums")
    return out.select(
        "conv_id", s[5].alias("gaps"), s[0].alias("blank"), s[1].alias("duplicate"), s[2].alias("truncated"), s[3].alias("illegal"), (F.col("total") + s[4]).alias("cost"), "audit", "repaired_sha256"
    )
