"""Near-duplicate documents by SimHash fingerprints, found in BK-trees.

A document's fingerprint has a bit for each bit of the XXH64 of its shingles of four words, repeats
included: 1 where over half of the hashes have it. Two documents link where their fingerprints differ
in at most `radius` bits.

The distinct fingerprints are dealt to shards so that all pairs within the radius meet: 64 bits cut
into radius + extra chunks leave, by the pigeonhole principle, `extra` chunks in which such a pair
agrees, so each choice of `extra` chunks with its values is a shard. More fingerprints get a larger
`extra`, which keeps shards small (`routes`); it changes no result. Each shard has a BK-tree, whose
children are keyed by their integer Hamming distance to the parent, and each of its fingerprints
follows only the edges whose distance is within the radius of its own. All trees together hold the
fingerprints of all documents, which has no bound to broadcast under; so a tree goes to the query
blocks of its shard alone. A shard of over BLOCK fingerprints is cut into trees and query blocks of
bounded size, each pair of them a tile of its own. A tile gives a spanning forest of the links it
finds; the trees of many small shards are built and searched at once.

Cases: null and wordless texts have fingerprint zero, which links like any other; one to three words
are one shingle; equal fingerprints are one class from the start, however many rows have them; rows
of one doc_id are documents of their own; a row without doc_id is kept, links with nothing and has
no component; an empty table gives an empty result; long texts are read whole; columns of the table
other than id and text play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import HOT_ROWS, LOWER, MOST_HOT, discard_but, made_so_far, salted_join, slices, stored, text_buffer, words
from plumbline.llm.components import components
from plumbline.llm.near_dedup import blocked

SHINGLE, SEED, BITS = 4, 42, 64
#: Fingerprints of a tree or query block, and those that an average shard may hold.
BLOCK, SHARD = 2048, 1024
#: Fingerprints whose tiles are searched at once, and pairs of query and node that one step holds.
BATCH, FRONTIER = 16_384, 1 << 20
#: Rows up to which the classes that say more than a row's own id are broadcast.
BROADCAST_CLASSES = 200_000


def shingle_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of consecutive texts, and how many each text has."""
    data = LOWER[data]
    starts, lengths, _ = words(data, offsets)
    bounds = np.searchsorted(starts, offsets)
    sizes = lengths + 1
    begins = np.cumsum(sizes) - sizes  # of words, each with one space behind it
    joined = data[np.minimum(np.repeat(starts - begins, sizes) + np.arange(int(sizes.sum())), len(data) - 1)]
    joined[begins + lengths] = 32
    have = np.diff(bounds)
    counts = np.where(have > 0, np.maximum(have - SHINGLE + 1, 1), 0)
    first = np.repeat(bounds[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    last = first + np.repeat(np.minimum(have, SHINGLE), counts) - 1
    raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
    spans = zip(begins[first].tolist(), (begins[last] + lengths[last]).tolist(), strict=True)
    return np.fromiter((digest(raw[a:b], SEED) for a, b in spans), np.uint64, len(first)), counts


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """By text, the bits that over half of its hashes have; zero without hashes."""
    out = np.zeros(len(counts), np.uint64)
    own = np.flatnonzero(counts)
    if not len(own):
        return out
    # bytes of a 64-bit number count eight bits at once, for at most 255 hashes
    steps = -(-counts[own] // 255)
    ends = np.cumsum(counts[own])
    heads = np.repeat(ends - counts[own], steps) + 255 * (np.arange(int(steps.sum())) - np.repeat(np.cumsum(steps) - steps, steps))
    votes = np.zeros((len(own), 8, 8), np.int64)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & np.uint64(0x0101010101010101), heads)
        votes[:, :, k] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8), np.cumsum(steps) - steps, axis=0, dtype=np.int64)
    set_ = 2 * votes.reshape(len(own), BITS) > counts[own, None]
    out[own] = np.packbits(set_, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, print: the fingerprint's 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = majority(*shingle_hashes(*text_buffer(part.column("text"))))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "print"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, print long")


def routes(radius: int, total: int) -> list[int]:
    """Masks of the bits that name a shard: any two fingerprints within the radius agree under one."""
    extra = 1
    while total >> (BITS * extra // (radius + extra)) > SHARD and extra < 4:
        extra += 1
    chunks = radius + extra
    cuts = [BITS * i // chunks for i in range(chunks + 1)]
    each = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(each[i] for i in chosen) for chosen in combinations(range(chunks), extra)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Trees:
    """BK-trees of many tiles at once: points by tile, the first of each tile its root."""

    def __init__(self, points: np.ndarray, tile: np.ndarray):
        self.points = points
        _, self.roots, inverse = np.unique(tile, return_index=True, return_inverse=True)
        at = self.roots[inverse]  # the node below which a point is to stand
        rest = np.flatnonzero(at != np.arange(len(points)))
        at, keys, children = at[rest], [], []
        while len(rest):
            edge = at * (BITS + 1) + np.bitwise_count(points[rest] ^ points[at])
            found, first, inverse = np.unique(edge, return_index=True, return_inverse=True)
            child = rest[first]
            keys.append(found)
            children.append(child)
            below = np.ones(len(rest), bool)
            below[first] = False
            rest, at = rest[below], child[inverse][below]
        #: Edges as parent * 65 + distance, in order, and the child that each leads to.
        self.keys, self.children = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, children))
        order = np.argsort(self.keys)
        self.keys, self.children = self.keys[order], self.children[order]

    def near(self, queries: np.ndarray, roots: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Query and node places of what is within the radius, each query from a root on."""
        todo = [(np.arange(len(queries)), roots)]
        while todo:
            query, node = todo.pop()
            if len(query) > FRONTIER:
                half = len(query) // 2
                todo += [(query[:half], node[:half]), (query[half:], node[half:])]
                continue
            apart = np.bitwise_count(queries[query] ^ self.points[node]).astype(np.int64)
            hit = apart <= radius
            if hit.any():
                yield query[hit], node[hit]
            low = np.searchsorted(self.keys, node * (BITS + 1) + np.maximum(apart - radius, 0))
            high = np.searchsorted(self.keys, node * (BITS + 1) + np.minimum(apart + radius, BITS), side="right")
            many = high - low
            total = int(many.sum())
            if total:
                at = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(total)
                todo.append((np.repeat(query, many), self.children[at]))


class Links:
    """A spanning forest of the pairs it is told, over n things."""

    def __init__(self, n: int):
        self.label, self.kept = np.arange(n), []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            new = x != y
            if not new.any():
                return
            a, b, low, high = a[new], b[new], np.minimum(x, y)[new], np.maximum(x, y)[new]
            order = np.lexsort((low, high))
            _, first = np.unique(high[order], return_index=True)
            chosen = order[first]  # each group goes under the least one it meets, so no circle closes
            self.kept.append((a[chosen], b[chosen]))
            self.label[high[chosen]] = low[chosen]
            while True:
                jumped = self.label[self.label]
                if (jumped == self.label).all():
                    break
                self.label = jumped


def search(prints: np.ndarray, tile: np.ndarray, first: np.ndarray, second: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within each tile: fingerprints marked `second` asked of trees of those marked `first`."""
    nodes, asked = np.flatnonzero(first), np.flatnonzero(second)
    trees, links = Trees(prints[nodes], tile[nodes]), Links(len(prints))
    there = np.isin(tile[asked], tile[nodes])
    asked = asked[there]
    roots = trees.roots[np.searchsorted(tile[nodes][trees.roots], tile[asked])]
    for a in range(0, len(asked), 512):
        for query, node in trees.near(prints[asked[a : a + 512]], roots[a : a + 512], radius):
            links.add(asked[a : a + 512][query], nodes[node])
    if not links.kept:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*links.kept, strict=True))


def near_prints(classes: DataFrame, radius: int, total: int) -> DataFrame:
    """a, b: links between distinct fingerprints (column print), enough to connect all within the radius."""
    spark = classes.sparkSession

    def shard(i: int, mask: int) -> Column:
        return F.xxhash64(F.lit(i), F.col("print").bitwiseAND(F.lit(_signed(mask)).cast("long")))

    dealt = classes.select(F.col("print").alias("node"), F.explode(F.array(*[shard(i, m) for i, m in enumerate(routes(radius, total))])).alias("grp"))
    sizes = stored(spark, dealt.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shards")
    hot = [(r.grp,) for r in sizes.filter(F.col("n") > HOT_ROWS).orderBy(F.desc("n"), "grp").limit(MOST_HOT).collect()]
    blocks = sizes.select("grp", F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks"))
    members = blocked(salted_join(dealt, blocks, ["grp"], "inner", hot=hot)).select("grp", "row", "col", "block", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy() for c in ("grp", "row", "col", "block", "node")]))
            n += batch.num_rows
            if n >= BATCH:  # the last tile may go on in the next batch
                rows = np.concatenate(held, axis=1)
                same = (rows[:3] == rows[:3, -1:]).all(axis=0)
                whole = int(np.argmax(same))
                if whole:
                    yield from solve(rows[:, :whole])
                held, n = [rows[:, whole:]], rows.shape[1] - whole
        if held:
            yield from solve(np.concatenate(held, axis=1))

    def solve(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        grp, row, col, block, node = rows
        tile = np.concatenate([[0], np.cumsum((rows[:3, 1:] != rows[:3, :-1]).any(axis=0))])
        a, b = search(node.view(np.uint64), tile, block == row, block == col, radius)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    tiles = members.repartition("grp", "row", "col").sortWithinPartitions("grp", "row", "col")
    return tiles.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links)."""
    spark, mark = docs.sparkSession, made_so_far()
    sketch = stored(spark, fingerprints(docs, text, key), "prints")
    classes = sketch.filter("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("rows"))
    classes = stored(spark, classes, "classes")
    labels = components(near_prints(classes.select("print"), radius, classes.count()))
    tied = stored(spark, classes.join(labels.withColumnRenamed("node", "print"), "print"), "tied")
    lows = tied.groupBy("component").agg(F.min("low").alias("component_id"))
    linked = salted_join(tied.select("print", "component"), lows, ["component"], "inner")
    # only classes of several rows, and those that a link leads from, say more than a row's own id
    owned = classes.join(linked, "print", "left").filter("rows > 1 or component is not null")
    owned = stored(spark, owned.select("print", "rows", F.coalesce("component_id", "low").alias("component_id")), "owned")
    hot = [(r["print"],) for r in owned.filter(F.col("rows") > HOT_ROWS).orderBy(F.desc("rows"), "print").limit(MOST_HOT).collect()]
    few = owned.count() <= BROADCAST_CLASSES
    discard_but(spark, mark, sketch, owned)  # all else has been read for the last time
    owned = owned.drop("rows")
    out = sketch.join(F.broadcast(owned), "print", "left") if few else salted_join(sketch, owned, ["print"], hot=hot)
    digits = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return out.select("doc_id", digits.alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
