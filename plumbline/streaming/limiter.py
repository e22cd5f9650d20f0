"""Sliding-window rate limiting, in batch and as a stream.

Only allowed requests count, so a denial changes what follows: the decision is a fold over a
client's requests in time order, not a range count.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.sparse import small
from plumbline.sources.shared import stored

DECIDED = "key string, event_id long, at double, allowed boolean, retry_after long"


def decide(live: deque, at: float, most: int, window: float) -> tuple[bool, int]:
    """Whether a request at this time passes, and after how many seconds to try again; keeps live."""
    while live and live[0] <= at - window:
        live.popleft()
    if most <= 0:
        return False, math.ceil(window)
    if len(live) < most:
        live.append(at)
        return True, 0
    return False, max(1, math.ceil(live[0] + window - at))


def _check(window: float) -> None:
    if window <= 0:
        raise ValueError("window is positive")


#: Requests of a client beyond which its history is folded in pieces, and of a piece, about.
PIECE = 200_000


def _folded(rows: pd.DataFrame, live: deque, most: int, window: float) -> list[tuple]:
    return [decide(live, t, most, window) for t in rows["at"]]


def limit(events: DataFrame, key: str, at: str, order: str, most: int, window: float) -> DataFrame:
    """key, event_id, at (seconds), allowed, retry_after: each client's requests by (at, order).

    Requests are dealt by client and sorted by Spark, and folded as they stream by: a task holds the live
    requests of one client. Clients of more than PIECE requests are folded in pieces (`_in_pieces`).
    """
    _check(window)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, live = None, deque()
        for batch in batches:
            out = []
            for k, event, t in batch.itertuples(index=False):
                if k != now:
                    now, live = k, deque()
                out.append((k, event, t, *decide(live, t, most, window)))
            yield pd.DataFrame(out, columns=["key", "event_id", "at", "allowed", "retry_after"])

    rows = events.select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("event_id"), F.col(at).cast("double").alias("at"))
    rows = stored(rows, "requests")
    busy = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > PIECE)
    busy = stored(busy, "busy")
    total = busy.agg(F.sum("n")).first()[0]
    quiet = rows.join(small(busy.select("key")), "key", "left_anti") if total else rows
    dealt = quiet.repartition("key").sortWithinPartitions("key", "at", "event_id")
    done = dealt.mapInPandas(run, DECIDED)
    return done.unionByName(_in_pieces(rows.join(small(busy.select("key")), "key", "left_semi"), total, most, window)) if total else done


def _in_pieces(rows: DataFrame, total: int, most: int, window: float) -> DataFrame:
    """limit() of clients whose histories no task should fold alone.

    A history is cut into ranges of time. All pieces are folded at once, as if nothing were live before
    them; then each again whose predecessor's end says otherwise, until none does. After a gap of
    the window, or where enough requests were denied, a piece ends as it did before, so this takes a few
    rounds; it never takes more than a client has pieces, and what it ends with is the fold itself.
    What is live at the ends of pieces, at most `most` times each, comes to the driver.
    """
    order = ["key", "at", "event_id"]
    ranged = rows.repartitionByRange(max(1, -(-total // PIECE)), *order).withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, "pieces")
    entries: dict[tuple, list[float]] = {}

    def ends(pieces: DataFrame, known: dict[tuple, list[float]]) -> DataFrame:
        def run(k: tuple, piece: pd.DataFrame) -> pd.DataFrame:
            piece, live = piece.sort_values(["at", "event_id"]), deque(known.get(k, []))
            _folded(piece, live, most, window)
            return pd.DataFrame({"key": [k[0]], "part": [k[1]], "first": [piece["at"].iloc[0]], "live": [list(live)]})

        return pieces.groupBy("key", "part").applyInPandas(run, "key string, part int, first double, live array<double>")

    found = {(r.key, r.part): (r.first, list(r.live)) for r in ends(ranged, {}).collect()}
    changed = True
    while changed:
        changed = {}
        for (k, part), before in zip(sorted(found)[1:], sorted(found), strict=False):
            if before[0] != k:
                continue
            first = found[k, part][0]
            live = [t for t in found[before][1] if t > first - window]
            if live != entries.get((k, part), []):
                changed[k, part] = live
        entries |= changed
        if changed:
            which = rows.sparkSession.createDataFrame(list(changed), "key string, part int")
            again = ends(ranged.join(small(which), ["key", "part"], "left_semi"), entries)
            found |= {(r.key, r.part): (r.first, list(r.live)) for r in again.collect()}

    def run(k: tuple, piece: pd.DataFrame) -> pd.DataFrame:
        piece = piece.sort_values(["at", "event_id"])
        piece[["allowed", "retry_after"]] = _folded(piece, deque(entries.get(k, [])), most, window)
        return piece[["key", "event_id", "at", "allowed", "retry_after"]]

    return ranged.groupBy("key", "part").applyInPandas(run, DECIDED)


def limit_all(events: DataFrame, at: str, order: str, most: int, window: float) -> DataFrame:
    """One limit over all requests, as of one client."""
    return limit(events.withColumn("_all", F.lit("all")), "_all", at, order, most, window)


def two_level(events: DataFrame, key: str, at: str, order: str, client: tuple, everyone: tuple) -> DataFrame:
    """key, event_id, at, verdict (allowed, client, global), retry_after.

    The client's limit is asked first; what passes it uses up a place there even if the limit of
    all then denies it.
    """
    first = limit(events, key, at, order, *client)
    second = limit_all(first.filter("allowed").select("key", "event_id", "at"), "at", "event_id", *everyone)
    late = second.select("event_id", F.col("allowed").alias("ok"), F.col("retry_after").alias("later"))
    both = first.join(late, "event_id", "left")
    verdict = F.when(~F.col("allowed"), "client").when(F.col("ok"), "allowed").otherwise("global")
    return both.select("key", "event_id", "at", verdict.alias("verdict"), F.coalesce(F.when(F.col("allowed"), F.col("later")), "retry_after").alias("retry_after"))


def limit_stream(events: DataFrame, key: str, at: str, order: str, most: int, window: float, late: str = "1 hour") -> DataFrame:
    """limit() for a streaming DataFrame: a client's live requests are its state.

    Event time is when a request ceases to count. The state of a client goes once the watermark, which
    follows the latest request by `late`, has passed that time of its last live request, as nothing
    that may still come can meet it. Requests behind the watermark are left out. A trigger's requests of one client are ordered in one task.
    """
    _check(window)

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        live = deque(state.get[0] if state.exists else [])
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        out = [(k[0], e, t, *decide(live, t, most, window)) for e, t in zip(rows["event_id"], rows["at"], strict=True)]
        state.update((list(live),))
        ends = ((live[-1] if live else float(rows["at"].iloc[-1])) + window) * 1000
        state.setTimeoutTimestamp(max(int(ends), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["key", "event_id", "at", "allowed", "retry_after"])

    rows = events.select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("event_id"), F.col(at).cast("double").alias("at"))
    rows = rows.withColumn("time", F.timestamp_micros(((F.col("at") + window) * 1_000_000).cast("long"))).withWatermark("time", late)
    return rows.groupBy("key").applyInPandasWithState(run, DECIDED, "live array<double>", "append", "EventTimeTimeout")
