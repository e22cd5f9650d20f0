"""Near-duplicate documents: a multi-index Hamming join of b-bit MinHash signatures.

A document is the set of its distinct shingles of five words. Its signature has chunks * places
symbols of 16 bits, each from one MinHash. Two signatures that differ in fewer than
chunks * (ERRORS + 1) places agree, by the pigeonhole principle, in some chunk but for at most
ERRORS = 1 of its places; so each chunk is indexed once for each place that may be wrong, under
the other places. All pairs below that distance meet under a key. The chunks are sized for the
least similarity that links (`scheme`): a pair of just that similarity, 0.85 or 0.80, meets with
probability over 0.9998, and the nearer, the surer.

Exact copies are one class from the start. Documents that meet are not paired: under each key, the
members are tied to the least of them if their signatures are near enough (`far` of the scheme).
Where some member is too far from the least, its key's members are compared among each other, in
blocks of bounded size, which gives a spanning forest of the near ones. So only signatures that are
near tie documents, and keys that unlike documents share by chance don't join whole groups.

The connected groups of these ties are cut into blocks of bounded size. A task compares two blocks:
signatures first, then the full shingle sets, and only of documents that its own links don't connect
yet. It returns a spanning forest of the confirmed links, so a group of any size gives no more rows
than it has members in each tile.

Cases: null and wordless texts have an empty set and link with nothing; one to four words are one
shingle; rows of one doc_id count as one document for linking; a row without doc_id is kept,
links with nothing and has no component; an empty table gives an empty result; long texts are
read whole; columns of the table other than id and text play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import HOT_ROWS, LOWER, MOST_HOT, discard_but, made_so_far, mixed, salted_join, slices, stored, text_buffer, words
from plumbline.llm.components import components

SHINGLE = 5
CHUNKS, PLACES, ERRORS = 7, 7, 1
SYMBOLS = CHUNKS * PLACES
#: Bounds of a block: shingles and documents.
BLOCK_SHINGLES, BLOCK_DOCS = 400_000, 1500
#: Signatures in a block.
BLOCK_SIGNATURES = 4096
#: Bytes of text that one step reads.
SLICE = 1 << 19
#: Rows up to which the documents of candidate groups are broadcast to the scan.
BROADCAST_NODES = 200_000


class Scheme(NamedTuple):
    """Chunks of places, and far: signatures that differ in more places are not compared in full,
    which happens to fewer than one pair in a million of the least similarity that links."""

    chunks: int
    places: int
    far: int

    @property
    def symbols(self) -> int:
        return self.chunks * self.places


#: For links from the similarity (in percent) on, the strictest first.
SCHEMES = {85: Scheme(CHUNKS, PLACES, 22), 80: Scheme(9, 6, 26)}
MOST_SYMBOLS = max(x.symbols for x in SCHEMES.values())


def scheme(percent: int) -> Scheme:
    """The scheme that is sized for links of percent or more."""
    for least, found in SCHEMES.items():
        if percent >= least:
            return found
    raise ValueError(f"no signature is sized for a similarity of {percent} %")


_FACTORS = mixed(np.arange(1, MOST_SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_PLACE = mixed(np.arange(101, 101 + SHINGLE, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    starts, _, hashes = words(LOWER[data], offsets)
    bounds = np.searchsorted(starts, offsets)
    grams = np.zeros(max(0, len(hashes) - SHINGLE + 1), np.uint64)
    for i in range(SHINGLE):
        grams += hashes[i : i + len(grams)] * _PLACE[i]
    grams = mixed(grams)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(grams[a : b - SHINGLE + 1]))
        elif b > a:
            whole = np.add.reduce(hashes[a:b] * _PLACE[: b - a]) + np.uint64(b - a)
            out.append(mixed(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], symbols: int = SYMBOLS) -> np.ndarray:
    """Set x symbol, 16 bits each; zeros for an empty set."""
    out = np.zeros((len(sets), symbols), np.uint16)
    sizes = np.array([len(s) for s in sets])
    own = np.flatnonzero(sizes)
    if not len(own):
        return out
    flat = np.concatenate(sets)
    heads = (np.cumsum(sizes) - sizes)[own]
    x, high = np.empty_like(flat), np.empty_like(flat)  # one pair of arrays for all symbols
    for k in range(symbols):
        np.multiply(flat, _FACTORS[k], out=x)
        np.right_shift(x, np.uint64(32), out=high)
        np.bitwise_xor(x, high, out=x)
        np.multiply(x, _FACTORS[k], out=x)
        least = np.minimum.reduceat(x, heads)
        out[own, k] = (mixed(least) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def keys(sigs: np.ndarray, places: int = PLACES) -> np.ndarray:
    """Signature x key: for each chunk, and each of its places, the chunk without that place."""
    n = sigs.shape[1]
    terms = mixed(sigs.astype(np.uint64) + np.arange(n, dtype=np.uint64) * np.uint64(1 << 16) + np.uint64(1))
    chunks = terms.reshape(len(sigs), n // places, places)
    rest = chunks.sum(axis=2, keepdims=True, dtype=np.uint64) - chunks
    return mixed(rest + np.arange(n, dtype=np.uint64).reshape(n // places, places)[None]).reshape(len(sigs), n).view(np.int64)


def sketches(docs: DataFrame, text: str, key: str, symbols: int = SYMBOLS) -> DataFrame:
    """doc_id, n_shingles, f1, f2 (of the whole set), sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                sets = shingle_sets(*text_buffer(part.column("text")))
                sigs = signatures(sets, symbols)
                f1 = np.array([np.add.reduce(mixed(s)) for s in sets], np.uint64).view(np.int64)
                f2 = np.array([np.add.reduce(mixed(s ^ _FACTORS[0])) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(f1), pa.array(f2), pa.array([x.tobytes() for x in sigs], pa.binary())],
                    names=["doc_id", "n_shingles", "f1", "f2", "sig"],
                )

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, sig binary")


def index_keys(classes: DataFrame, plan: Scheme) -> DataFrame:
    """key, node: plan.symbols rows for each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, plan.symbols)
            nodes = batch.column("node").to_numpy()
            for a in range(0, len(nodes), 2000):
                made = keys(sigs[a : a + 2000], plan.places)
                yield pa.RecordBatch.from_arrays([pa.array(made.ravel()), pa.array(np.repeat(nodes[a : a + 2000], plan.symbols))], names=["key", "node"])

    return classes.select("node", "sig").mapInArrow(run, "key long, node long")


class Forest:
    """Groups of numbered things as a label each; joining relabels the smaller group."""

    def __init__(self, n: int):
        self.label, self.size = np.arange(n), np.ones(n, np.int64)

    def join(self, a: int, b: int) -> bool:
        x, y = self.label[a], self.label[b]
        if x == y:
            return False
        if self.size[x] < self.size[y]:
            x, y = y, x
        self.label[self.label == y] = x
        self.size[x] += self.size[y]
        return True


def confirm(sets: list[np.ndarray], sigs: np.ndarray, split: int, percent: int, plan: Scheme | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets: those before split against those after, or,
    with split 0, all among each other."""
    n, plan = len(sets), plan or scheme(percent)
    forest, links = Forest(n), []
    right = np.arange(split, n)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate([sets[j] for j in right]) if len(right) else np.zeros(0, np.uint64)
    vocabulary, places = np.unique(flat, return_inverse=True)
    ends = np.cumsum(sizes[right])
    heads = ends - sizes[right]
    mark = np.zeros(len(vocabulary), np.int32)
    for i in range(split or n):
        others = right[i + 1 :] if not split else right
        others = others[forest.label[others] != forest.label[i]]
        # sizes alone rule out pairs whose smaller set is under percent of the larger
        others = others[100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i])]
        if not len(others):
            continue
        far = np.zeros(len(others), np.uint8)
        for k in range(plan.symbols):
            far += sigs[others, k] != sigs[i, k]
        others = others[far <= plan.far]
        if not len(others):
            continue
        at = np.searchsorted(vocabulary, sets[i])
        inside = at < len(vocabulary)
        at = at[inside]
        at = at[vocabulary[at] == sets[i][inside]]
        mark[at] = 1
        slots = others - split
        if 4 * int(sizes[others].sum()) < len(flat):
            shared = np.array([mark[places[heads[s] : ends[s]]].sum() for s in slots])
        else:
            shared = np.add.reduceat(mark[places], heads)[slots]
        mark[at] = 0
        for j in others[100 * shared >= percent * (sizes[others] + sizes[i] - shared)].tolist():
            if forest.join(i, j):
                links.append((i, j))
    return links


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many places the signatures of each row differ."""
    out = np.zeros(len(a), np.uint8)
    for k in range(a.shape[1]):
        out += a[:, k] != b[:, k]
    return out


def near_forest(sigs: np.ndarray, split: int, far: int) -> list[tuple[int, int]]:
    """A spanning forest of the signatures that differ in at most far places: those before split
    against those after, or, with split 0, all among each other."""
    n = len(sigs)
    forest, ties = Forest(n), []
    columns = np.ascontiguousarray(sigs.T)
    for i in range(split or n):
        others = np.arange(i + 1 if not split else split, n)
        others = others[forest.label[others] != forest.label[i]]
        if not len(others):
            continue
        differ = np.zeros(len(others), np.uint8)
        for column in columns:
            differ += column[others] != column[i]
        for j in others[differ <= far].tolist():
            if forest.join(i, j):
                ties.append((i, j))
    return ties


def tile_links(members: DataFrame, solve: Callable) -> DataFrame:
    """a, b: what `solve` finds in each tile: a spanning forest of the links between its nodes.

    members: grp, row, col, block, node and what solve needs; one row for each tile of a member.
    Rows are dealt by tile and sorted, so a task holds one tile at a time. solve gets the tile,
    sorted by block, and how many members are of its first block (0 where it has one block).
    """

    def tile(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(parts)
        row, col = held.column("row")[0].as_py(), held.column("col")[0].as_py()
        blocks = held.column("block").to_numpy()
        held = held.take(pa.array(np.argsort(blocks, kind="stable")))
        split = int((blocks == row).sum()) if row != col else 0
        if row != col and split in (0, len(blocks)):
            return
        found, nodes = solve(held, split), held.column("node").to_numpy()
        if found:
            a, b = np.array(found).T
            yield pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            tags = np.stack([batch.column(c).to_numpy() for c in ("grp", "row", "col")])
            cuts = [0, *(np.flatnonzero((tags[:, 1:] != tags[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                tag = tuple(tags[:, a].tolist())
                if held and tag != now:
                    yield from tile(held)
                    held = []
                held.append(batch.slice(a, b - a))
                now = tag
        if held:
            yield from tile(held)

    dealt = members.repartition("grp", "row", "col").sortWithinPartitions("grp", "row", "col")
    return dealt.mapInArrow(run, "a long, b long")


def blocked(members: DataFrame) -> DataFrame:
    """One row for each tile of a member; members has grp, node and blocks (of its group)."""
    zero = F.lit(0).cast("long")
    return (
        members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1)))
        .withColumn("row", F.least("block", "other"))
        .withColumn("col", F.greatest("block", "other"))
        .drop("blocks", "other")
    )


def signed(column: pa.ChunkedArray, plan: Scheme) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, plan.symbols)


def near_ties(classes: DataFrame, plan: Scheme) -> DataFrame:
    """a, b: of all classes (node, sig) that meet under a key and are near by signature, links that
    connect them."""
    spark = classes.sparkSession
    index = index_keys(classes, plan)
    print_ = F.xxhash64("node", F.lit(1))  # equal sets of members have equal sums
    met = index.groupBy("key").agg(
        F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.shiftright(print_, 32)).alias("y")
    )
    met = stored(spark, met.filter("low < high").drop("high"), "met")
    hot = [(r.key,) for r in met.filter(F.col("n") > HOT_ROWS).orderBy(F.desc("n"), "key").limit(MOST_HOT).collect()]
    ties = stored(spark, salted_join(index, met, ["key"], "inner", hot=hot).filter("node <> low"), "ties")
    sigs = classes.select("node", "sig")
    pairs = ties.select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
    pairs = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a")
    pairs = salted_join(stored(spark, pairs, "pairs"), sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb")), ["b"], "inner")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = apart(signed(batch.column("sa"), plan), signed(batch.column("sb"), plan)) <= plan.far
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(near)], names=["a", "b", "near"])

    pairs = pairs.select("a", "b", "sa", "sb").mapInArrow(measure, "a long, b long, near boolean")
    # rows of one doc_id may have several signatures; one that is near is enough
    pairs = stored(spark, pairs.groupBy("a", "b").agg(F.max("near").alias("near")), "measured")
    near = pairs.filter("near").select("a", "b")
    far = pairs.filter("not near").select(F.col("a").alias("node"), F.col("b").alias("low"))
    n_far = far.count()
    if not n_far:
        return near
    # keys of three or more, of which one is far from the least; of equal sets of members, one
    some = ties.filter("n > 2")
    some = some.join(F.broadcast(far), ["node", "low"], "left_semi") if n_far <= BROADCAST_NODES else some.join(far, ["node", "low"], "left_semi")
    chosen = some.groupBy("n", "x", "y").agg(F.min_by(F.struct("key", "low"), "key").alias("k"))
    chosen = stored(spark, chosen.select("k.key", "k.low", F.ceil(F.col("n") / BLOCK_SIGNATURES).cast("long").alias("blocks")), "crowded")
    n_chosen = chosen.count()
    if not n_chosen:
        return near
    keys_ = chosen.select("key", "blocks")
    small = ties.select("key", "node")
    inside = small.join(F.broadcast(keys_), "key") if n_chosen <= BROADCAST_NODES else salted_join(small, keys_, ["key"], "inner", hot=hot)
    inside = inside.select("key", "blocks", "node").union(chosen.select("key", "blocks", F.col("low").alias("node")))
    inside = salted_join(stored(spark, inside, "inside"), sigs, ["node"], "inner").withColumnRenamed("key", "grp")
    members = blocked(inside).select("grp", "row", "col", "block", "node", "sig")
    return near.union(tile_links(members, lambda held, split: near_forest(signed(held.column("sig"), plan), split, plan.far)))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = 85, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: links where 100 * shared >= percent * union.

    With `exact`, no pair that meets under a key is ruled out by its signatures' distance; all are
    compared in full, which costs more.
    component_id is the smallest doc_id that a document reaches over links; it is kept where it
    is its own component_id.
    """
    spark, plan, mark = docs.sparkSession, scheme(percent), made_so_far()
    plan = plan._replace(far=plan.symbols) if exact else plan
    sketch = stored(spark, sketches(docs, text, key, plan.symbols), "sketches")
    whole = ["n_shingles", "f1", "f2"]
    usable = sketch.filter("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy(*whole).agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("rows"))
    classes = stored(spark, classes, "classes")
    groups = stored(spark, components(near_ties(classes, plan)), "groups")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                found = shingle_sets(*text_buffer(part.column("text")))
                sig = [x.tobytes() for x in signatures(found, plan.symbols)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), part.column("grp"), pa.array(list(map(len, found)), pa.int64()), pa.array(sig, pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())],
                    names=["node", "grp", "n", "sig", "shingles"],
                )

    nodes = groups.select("node", F.col("component").alias("grp"))
    n_nodes = nodes.count()
    few = n_nodes <= BROADCAST_NODES
    texts = docs.select(F.col(key).cast("long").alias("node"), F.col(text).cast("binary").alias("text"))
    found = texts.join(F.broadcast(nodes) if few else nodes, "node").mapInArrow(sets, "node long, grp long, n long, sig binary, shingles binary")
    found = stored(spark, found.filter("n > 0"), "members")
    if found.count() > n_nodes:  # rows of one doc_id
        found = stored(spark, found.dropDuplicates(["node", "shingles"]), "members-once")
    sizes = found.groupBy("grp").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))
    sizes = stored(spark, sizes, "sizes")
    blocks = sizes.select("grp", F.greatest(F.ceil(F.col("n") / BLOCK_SHINGLES), F.ceil(F.col("docs") / BLOCK_DOCS)).cast("long").alias("blocks"))
    hot = [(r.grp,) for r in sizes.filter(F.col("docs") > HOT_ROWS).orderBy(F.desc("docs"), "grp").limit(MOST_HOT).collect()]
    members = blocked(salted_join(found, blocks, ["grp"], "inner", hot=hot)).select("grp", "row", "col", "block", "node", "sig", "shingles")

    def confirmed(held: pa.Table, split: int) -> list[tuple[int, int]]:
        shingles = [np.frombuffer(x, np.uint64) for x in held.column("shingles").to_pylist()]
        return confirm(shingles, signed(held.column("sig"), plan), split, percent, plan)

    labels = stored(spark, components(tile_links(members, confirmed)), "labels")
    # only classes of several rows, and those that a link leads from, say more than a row's own id
    owned = classes.drop("sig").join(labels, "node", "left").filter("rows > 1 or component is not null")
    owned = stored(spark, owned.select(*whole, "rows", F.coalesce("component", "node").alias("component_id")), "owned")
    hot = [tuple(r) for r in owned.filter(F.col("rows") > HOT_ROWS).orderBy(F.desc("rows"), *whole).limit(MOST_HOT).select(*whole).collect()]
    few = owned.count() <= BROADCAST_NODES
    discard_but(spark, mark, sketch, owned)  # all else has been read for the last time
    owned, slim = owned.drop("rows"), sketch.drop("sig")
    out = slim.join(F.broadcast(owned), whole, "left") if few else salted_join(slim, owned, whole, hot=hot)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
