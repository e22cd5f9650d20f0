"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern: the set of sources that they belong to (in
`mix_sources`, the sources in which a document's text occurs). Each pattern's words flow to the
quotas of its sources. The first copy of a pattern's distinct words is free, each further copy
costs more than the one before (convex), so a quota is filled from texts that no other quota has
taken, as far as it can be. Patterns that share no source are solved apart.

The flow says how many words of each pattern a source takes: so many copies of every document, and
one more of the documents that come first in a seeded order, up to the rest. The order is a ring of
text hashes on which each source of a pattern starts where the one before it stops, so that sources
take different texts before any text is taken again. Where the order must be cut is found by sums
over hash ranges, refined level by level, so that no task orders a whole pattern; then up to FILLS
documents beyond the cut whose sizes fit what is missing best are added.

The solver sees one row a pattern and source; patterns are sets of the sources that a mix names, and
at most MOST_PATTERNS (an error beyond: a pattern for each document is no mixture).

Cases: a null text has size 0; documents of size 0 take 0 words; a null source is a source of its
own, last by order; equal rows (same id and text) are taken together; an empty table gives an
empty result; columns named like an output are replaced, others pass through.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import discard, free_prefix, made_so_far, salted_join, stored

#: Weights that sources take in turn.
WEIGHTS = (5, 2, 1)
MOST_PATTERNS, BROADCAST_PATTERNS = 1_000_000, 50_000
#: Texts of several sources up to which their patterns are broadcast.
BROADCAST_TEXTS = 100_000
#: Hash ranges that one level tells apart, and documents added beyond a cut.
RANGES, FILLS = 256, 3
#: Size of the ring of hashes; its upper 24 bits come from the text, the others from the row.
RING, TEXT_BITS = 1 << 62, 24
SEED = 20
#: Copies up to which each copy has a cost of its own; beyond, each doubling has.
SINGLE_COPIES = 8


def size_of(text: Column) -> Column:
    """Words: runs of other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def water_fill(sizes: Sequence[int], weights: Sequence[int], total: Fraction, most: int) -> list[Fraction]:
    """Shares of total by weight, none above most times its size; what is over goes to the others."""
    caps = [Fraction(most * s) for s in sizes]
    out, open_ = list(caps), set(range(len(sizes)))
    total = min(total, sum(caps, Fraction(0)))
    left = total
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if unit * weights[i] >= caps[i]}
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        left -= sum(caps[i] for i in full)
        open_ -= full
    return out


def routes(patterns: Sequence[tuple[frozenset, int]], quotas: dict, most: int, limits: Sequence[dict] | None = None) -> dict[tuple, int]:
    """By (place of a pattern, source): the words that it gives to that source's quota, most words
    at least cost. limits: what each pattern can give to each of its sources; without, a pattern
    can give most times its size in all."""
    sent: dict[tuple, int] = {}
    shared = defaultdict(list)
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for sources, _ in patterns:
        for s in sources:
            root[find(s)] = find(next(iter(sources)))
    for i, (sources, size) in enumerate(patterns):
        if size and sources:
            shared[find(next(iter(sources)))].append(i)
    for members in shared.values():
        sent |= _search({i: patterns[i] for i in members}, quotas, most, limits)
    return sent


def flow(patterns: Sequence[tuple[frozenset, int]], quotas: dict, most: int) -> list[int]:
    """Words that each (sources, size) gives to the quotas at least cost."""
    given = [0] * len(patterns)
    for (i, _), words in routes(patterns, quotas, most).items():
        given[i] += words
    return given


def _search(patterns: dict, quotas: dict, most: int, limits: Sequence[dict] | None = None) -> dict[tuple, int]:
    """Successive cheapest paths, all of one cost at once.

    Only the step into a pattern costs: its copy number (beyond SINGLE_COPIES, its doubling). So the
    cheapest paths at any time are those of the lowest copy from which a quota can be reached, and a
    largest flow is found for each cost in turn, over paths that may take back what was sent before.
    """
    sent: dict[tuple, int] = {(i, s): 0 for i, (sources, _) in patterns.items() for s in sources}
    of = defaultdict(list)  # patterns of a source
    for i, s in sent:
        of[s].append(i)
    left = {s: quotas.get(s, 0) for s in of}
    whole = {i: most * size if limits is None else sum(limits[i].get(s, 0) for s in sources) for i, (sources, size) in patterns.items()}
    free = {e: whole[e[0]] if limits is None else limits[e[0]].get(e[1], 0) for e in sent}
    room = dict.fromkeys(patterns, 0)  # words that patterns have at this cost and below
    opened, bound = dict.fromkeys(patterns, 0), 0
    while any(left.values()) and any(opened[i] < whole[i] for i in patterns):
        bound = bound + 1 if bound < SINGLE_COPIES else 2 * bound
        for i, (_, size) in patterns.items():
            more = min(bound * size, whole[i]) - opened[i]
            opened[i] += more
            room[i] += more
        while _push(patterns, of, room, free, sent, left):
            pass
    return sent


def _push(patterns: dict, of: dict, room: dict, free: dict, sent: dict, left: dict) -> bool:
    """A blocking flow along shortest paths from patterns with room to sources with quota left."""
    depth = {("p", i): 0 for i, r in room.items() if r}
    todo, reached = deque(depth), None
    while todo:
        node = todo.popleft()
        d = depth[node]
        if reached is not None and d >= reached:
            break
        if node[0] == "p":
            near = [("s", s) for s in patterns[node[1]][0] if free[node[1], s] > 0]
        else:
            if left[node[1]]:
                reached = d
                continue
            near = [("p", i) for i in of[node[1]] if sent[i, node[1]] > 0]
        for x in near:
            if x not in depth:
                depth[x] = d + 1
                todo.append(x)
    if reached is None:
        return False
    after = {n: iter([("s", s) for s in patterns[n[1]][0]] if n[0] == "p" else [("p", i) for i in of[n[1]]]) for n in depth}
    ahead: dict = {n: next(it, None) for n, it in after.items()}

    def width(a, b):
        return free[a[1], b[1]] if a[0] == "p" else sent[b[1], a[1]]

    for first in [n for n, d in depth.items() if d == 0]:
        path = [first]
        while path and room[first[1]]:
            node = path[-1]
            if node[0] == "s" and left[node[1]]:
                words = min([room[first[1]], left[node[1]], *(width(a, b) for a, b in zip(path, path[1:], strict=False))])
                for a, b in zip(path, path[1:], strict=False):
                    e, way = ((a[1], b[1]), 1) if a[0] == "p" else ((b[1], a[1]), -1)
                    sent[e] += way * words
                    free[e] -= way * words
                room[first[1]] -= words
                left[node[1]] -= words
                path = [first]
                continue
            to = ahead[node]
            if to is None or depth[node] >= reached:
                path.pop()
                if path:
                    ahead[path[-1]] = next(after[path[-1]], None)
            elif depth.get(to) == depth[node] + 1 and width(node, to) > 0:
                path.append(to)
            else:
                ahead[node] = next(after[node], None)
    return True


def attach(rows: DataFrame, table: DataFrame, count: int) -> DataFrame:
    """rows with the table of patterns: broadcast while it is counted to be small, else salted."""
    return rows.join(F.broadcast(table), "pattern", "left") if count <= BROADCAST_PATTERNS else salted_join(rows, table, ["pattern"])


def cuts(spark: SparkSession, drawn: DataFrame, rest: dict) -> dict:
    """By pattern: the draw below which documents get one more copy.

    drawn: pattern, draw, size. rest: words that one more copy shall add, by pattern. Each level
    sums sizes by range within the one range where a pattern's cut still lies, until that holds
    one document.
    """
    low, width = dict.fromkeys(rest, 0), RING
    missing = dict(rest)
    schema = "pattern string, low long, missing long"
    while missing and width > 1:
        inner = max(1, width // RANGES)
        table = spark.createDataFrame([(p, low[p], missing[p]) for p in missing], schema)
        inside = attach(drawn, table, len(missing)).filter(
            F.col("low").isNotNull() & (F.col("draw") >= F.col("low")) & (F.col("draw") - F.col("low") < width)
        )
        bins = inside.groupBy("pattern", F.expr(f"(draw - low) div {inner}").alias("bin"))
        sums = bins.agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.first("missing").alias("missing")).filter("size > 0")
        upto = F.sum("size").over(Window.partitionBy("pattern").orderBy("bin")) - F.col("size")  # at most RANGES + 1 rows
        cut = sums.withColumn("before", upto).filter("before <= missing and before + size > missing")
        done = {}
        for r in cut.select("pattern", "bin", "before", "n").collect():  # one row a pattern
            missing[r["pattern"]] -= r["before"]
            low[r["pattern"]] += r["bin"] * inner
            done[r["pattern"]] = r["n"]
        for p in set(missing) - set(done):  # all of what is left goes in
            low[p] += width
        missing = {p: missing[p] for p, n in done.items() if n > 1}
        width = inner
    return low


def mix_sources(docs: DataFrame, source: Column, text: str = "text", **options) -> DataFrame:
    """`mix` of documents that each have one source, and belong to all in which their text occurs.

    source_size, target and what is taken are a document's own source's. A text of many rows is met
    by sums in each task; only texts of several sources are looked up, by broadcast while they are
    counted to be few.
    """
    spark = docs.sparkSession
    own = free_prefix(docs.columns)
    keys = [f"{own}x", f"{own}y"]
    name = F.coalesce(F.concat(F.lit("="), source), F.lit("~"))
    filled = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.withColumn(keys[0], F.xxhash64(filled)).withColumn(keys[1], F.xxhash64(F.lit(1), filled)).withColumn(f"{own}own", name)
    shared = rows.groupBy(*keys).agg(F.collect_set(f"{own}own").alias(f"{own}all")).filter(F.size(f"{own}all") > 1)
    shared = stored(spark, shared, "mix-texts")
    few = shared.count()
    if few:
        rows = rows.join(F.broadcast(shared), keys, "left") if few <= BROADCAST_TEXTS else salted_join(rows, shared, keys)
    else:
        rows = rows.withColumn(f"{own}all", F.lit(None).cast("array<string>"))
    sources = F.coalesce(f"{own}all", F.array(f"{own}own"))
    sources = F.transform(sources, lambda s: F.when(s != "~", F.substr(s, F.lit(2))))
    out = mix(rows, sources, text=text, own=source, **options)
    return out.drop(*keys, f"{own}own", f"{own}all")


def mix(
    docs: DataFrame,
    sources: Column,
    weights: Sequence[int] = WEIGHTS,
    share: Fraction = Fraction(3, 2),
    most: int = 2,
    text: str = "text",
    key: str = "doc_id",
    own: Column | None = None,
) -> DataFrame:
    """docs with size, source_size, target, copies and taken.

    sources: the names (array of strings; a null name is a source, too) of the sources that a
    document belongs to. Sources share `share` of all words by weight, none more than `most`
    times its size. Without `own`, a document counts for all of its sources, and source_size and
    target are sums over them. With `own`, one of them, it counts for that one alone; then equal
    texts of a pattern are one text, which the flow repeats only as far as it must.
    """
    spark, mark = docs.sparkSession, made_so_far()
    outputs = ("size", "source_size", "target", "copies", "taken")
    docs = docs.select([F.col(f"`{c}`") for c in docs.columns if c not in outputs])
    named = lambda s: F.coalesce(F.concat(F.lit("="), s), F.lit("~"))  # noqa: E731  "~" is after "="
    name = F.array_sort(F.array_distinct(F.transform(sources, named)))
    each = F.transform(name, lambda s: F.to_json(F.struct(s.alias("s"))))
    mine = named(own) if own is not None else F.lit("")
    pattern = F.concat_ws("@", F.to_json(F.struct(mine.alias("s"))), F.array_join(each, ","))
    filled = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    by_text = F.xxhash64(F.lit(SEED), filled)
    by_row = F.xxhash64(F.lit(SEED), key, filled)
    draw = F.shiftleft(F.shiftrightunsigned(by_text, 64 - TEXT_BITS), 62 - TEXT_BITS).bitwiseOR(F.shiftrightunsigned(by_row, 2 + TEXT_BITS))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    sized = docs.select(row, size_of(F.col(f"`{text}`")).alias("size"), pattern.alias("pattern"), draw.alias("draw"), name.alias("names"), mine.alias("mine"), by_text.alias("hash"))
    slim = stored(spark, sized.select("pattern", "size", "draw", "names", "mine", "hash"), "mix-sizes")
    groups = slim.groupBy("pattern").agg(F.sum("size").alias("size"), F.first("names").alias("names"), F.first("mine").alias("mine"))
    found = groups.limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError("more membership patterns than a mixture has")
    found.sort(key=lambda r: r["pattern"])
    by_source: dict[str, int] = defaultdict(int)
    for r in found:
        for s in set(r["names"]) if own is None else [r["mine"]]:
            by_source[s] += r["size"]
    order = sorted(by_source)  # by code point, the null source last
    total = share * sum(r["size"] for r in found)
    targets = dict(zip(order, water_fill([by_source[s] for s in order], [weights[i % len(weights)] for i in range(len(order))], total, most), strict=True))
    quotas = {s: round(t) for s, t in targets.items()}
    start: dict[str, int] = {}
    if own is None:
        given = flow([(frozenset(r["names"]), r["size"]) for r in found], quotas, most)
    else:
        texts = slim.groupBy("names", "hash").agg(F.max("size").alias("size")).groupBy("names").agg(F.sum("size").alias("size"))
        distinct = {tuple(r["names"]): r["size"] for r in texts.collect()}
        sets = sorted(distinct)
        limits: list[dict] = [{} for _ in sets]
        at = {names: i for i, names in enumerate(sets)}
        for r in found:
            limits[at[tuple(r["names"])]][r["mine"]] = most * r["size"]
        sent = routes([(frozenset(names), distinct[names]) for names in sets], quotas, most, limits)
        given, ring = [], dict.fromkeys(sets, Fraction(0))
        for r in found:
            names = tuple(r["names"])
            given.append(sent.get((at[names], r["mine"]), 0))
            start[r["pattern"]] = int(ring[names] % 1 * RING)
            ring[names] += Fraction(given[-1], r["size"]) if r["size"] else 0
    base = {r["pattern"]: (min(most, g // r["size"]) if r["size"] else 0) for r, g in zip(found, given, strict=True)}
    rest = {r["pattern"]: g - base[r["pattern"]] * r["size"] for r, g in zip(found, given, strict=True) if r["size"]}
    rest = {p: m for p, m in rest.items() if m > 0 and base[p] < most}
    turned = {p: s for p, s in start.items() if s}

    moved = F.pmod(F.col("draw") - F.coalesce("turn", F.lit(0)), F.lit(RING))  # counted from where the pattern starts
    drawn = slim.select("pattern", "size", "draw")
    if turned and rest:
        turns = spark.createDataFrame(list(turned.items()), "pattern string, turn long")
        drawn = stored(spark, attach(drawn, turns, len(turned)).select("pattern", "size", moved.alias("draw")), "mix-draws")
    low = cuts(spark, drawn, rest)
    extra: dict[str, list[int]] = {p: [] for p in rest}
    if rest:
        table = spark.createDataFrame([(p, low[p]) for p in rest], "pattern string, low long")
        below = attach(drawn, table, len(rest)).filter("low is not null")
        short = {p: rest[p] for p in rest}
        for r in below.filter("draw < low").groupBy("pattern").agg(F.sum("size").alias("size")).collect():
            short[r["pattern"]] -= r["size"]
        for _ in range(FILLS):
            table = spark.createDataFrame([(p, low[p], m, extra[p]) for p, m in short.items() if m > 0], "pattern string, low long, missing long, extra array<long>")
            beyond = attach(drawn, table, len(short)).filter("missing is not null and draw >= low and not array_contains(extra, draw)")
            same = beyond.groupBy("pattern", "draw", "missing").agg(F.sum("size").alias("size")).filter("size > 0")
            fit = same.withColumn("off", F.abs(F.col("size") - F.col("missing"))).filter(F.col("off") < F.col("missing"))
            picks = fit.groupBy("pattern").agg(F.min(F.struct("off", "draw", "size")).alias("pick")).collect()
            if not picks:
                break
            for p, pick in picks:
                extra[p].append(pick["draw"])
                short[p] -= pick["size"]
    discard(spark, mark)  # sizes and draws have been read for the last time
    rows = []
    for r in found:
        p, counted = r["pattern"], set(r["names"]) if own is None else [r["mine"]]
        rows.append((p, sum(by_source[s] for s in counted), float(sum((targets[s] for s in counted), Fraction(0))), base[p], low.get(p, 0), extra.get(p, []), turned.get(p, 0)))
    table = spark.createDataFrame(rows, "pattern string, source_size long, target double, base long, low long, extra array<long>, turn long")
    more = (F.col("draw") < F.col("low")) | F.array_contains("extra", F.col("draw"))
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("base") + F.when(more, 1).otherwise(0))
    return (
        attach(sized, table, len(rows))
        .withColumn("draw", moved)
        .withColumn("copies", copies.cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select("row.*", *outputs)
    )
