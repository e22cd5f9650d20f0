"""WARC archives of pages, and a two-level capture index over them.

Writing: each page becomes one record, its own gzip member; members are gathered into archives of
bounded size. Of records with equal payloads of at least `least` bytes, the one with the largest
page_id is a response, the others are revisits that name it. Only payloads that occur more than
once are looked up, by broadcast while they are counted to be few, else by a salted join.
Archives are .warc.gz files in the shared folder. A task names its files itself, and the table of
archives holds the names of tasks that ended well, so what a lost or repeated task wrote is never
read. Tasks reach the folder by pyarrow's file systems (local or mounted, hdfs, s3, gs).

Index: capture keys (reversed-host URL, page_id) are sorted over range partitions of about
DIRECTORY_SLICE blocks, cut into blocks of BLOCK_LINES lines and compressed. The sparse directory
has two levels: the first key of each range partition, which is all that the driver holds, and the
first key of each block. A lookup is dealt to its partition by the one, binary-searches the other,
opens the blocks, finds the lines, and reads only those byte ranges of the archives.

Cases: a null html is an empty payload; a null url is the empty URL; a null page_id never is what
others refer to unless all of its payload are null (then all are responses); rows of the same
page_id and payload as the response are responses, too; any byte in a URL is escaped in headers
and keys, and comes back as it was; an empty table gives empty archives, index and results; other
columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote
from uuid import uuid4

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import salted_join, scratch, slices, stored

#: Bounds of an archive, and lines of an index block.
ARCHIVE_BYTES, ARCHIVE_RECORDS, BLOCK_LINES = 4 << 20, 2000, 1000
#: Rows up to which repeated payloads, and names of archives, are broadcast.
BROADCAST_REPEATS, BROADCAST_ARCHIVES = 200_000, 50_000
#: Blocks of a range partition of the index.
DIRECTORY_SLICE = 64
#: Wanted keys that one search task takes, and bytes between two ranges that are read along.
SEARCH_KEYS, GAP = 200_000, 1 << 16
#: Files that one task of `fetch` reads from, on average.
FILES = 4
NO_ID = -(1 << 63)

#: Fixed values of the WARC format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:plumbline:page:"
#: Characters that a URI holds as they are; a URL with any other is escaped, which a header tells.
LEGAL = "/?#&=+:;,()!~*'@$[]-._"
ESCAPED = "X-Target-URI-Escaped"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def surt(url: str) -> str:
    """`com,example,www)/path?query`: the host's labels reversed; no control bytes."""
    head, sep, rest = url.partition("://")
    if sep:
        host = re.match(r"[^/?#]*", rest)[0]
        url = ",".join(reversed(host.lower().split("."))) + ")" + rest[len(host) :]
    return quote(url, safe=LEGAL)


def record(page: int | None, url: str, payload: bytes, digest: str, refers: int | None, date: str) -> bytes:
    """One record, not compressed; with `refers`, a revisit without payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers is not None else http + payload
    head = [VERSION, f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <{URN}{'' if page is None else page}>"]
    plain = quote(url, safe=LEGAL + "%") == url
    head += [f"WARC-Date: {date}", f"WARC-Target-URI: {url if plain else quote(url, safe=LEGAL)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if not plain:
        head.append(f"{ESCAPED}: 1")
    if refers is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{refers}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(member: bytes) -> dict:
    """What one gzip member holds; a response's payload is checked against its digest."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != VERSION or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not one whole record")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError("a payload differs from its digest")
    page = lambda name: int(x) if (x := fields.get(name, f"<{URN}>")[1:-1].removeprefix(URN)) else None
    return {
        "page_id": page("WARC-Record-ID"), "url": unquote(fields["WARC-Target-URI"]) if ESCAPED in fields else fields["WARC-Target-URI"], "record_type": kind, "payload_bytes": size,
        "payload_digest": digest, "refers_to": page("WARC-Refers-To"), "payload": payload if kind == "response" else None,
    }


CAPTURE = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
LINES = "surts array<string>, pages array<long>, starts array<long>, sizes array<long>"


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path in the shared folder, and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def write(pages: DataFrame, least: int = 0, date: str = "2000-01-01T00:00:00Z", key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """archive (a name), path and bytes of its file, and the index lines of its members (surts,
    pages, starts, sizes)."""
    spark = pages.sparkSession
    rows = pages.select(
        F.col(key).cast("long").alias("page"),
        F.coalesce(F.col(url), F.lit("")).alias("url"),
        F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("html"),
    ).withColumn("sha", F.unhex(F.sha1("html")))
    size = F.octet_length("html")
    repeats = rows.filter(size >= least).groupBy("sha").agg(F.max("page").alias("first"), F.count(F.lit(1)).alias("n"))
    repeats = stored(spark, repeats.filter("n > 1").drop("n"), "repeats")
    few = repeats.count() <= BROADCAST_REPEATS
    joined = rows.join(F.broadcast(repeats), "sha", "left") if few else salted_join(rows, repeats, ["sha"])
    other = (size >= least) & F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
    joined = joined.select("page", "url", "html", "sha", F.when(other, F.col("first")).alias("refers"))
    folder = scratch(spark, "archives")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(folder)
        system.create_dir(root)
        part = TaskContext.get().partitionId()
        data, lines = bytearray(), []

        def archive() -> pa.RecordBatch:
            name = f"{part:06d}-{uuid4().hex}"
            with system.open_output_stream(f"{root}/{name}.warc.gz", compression=None) as out:
                out.write(bytes(data))
            columns = list(zip(*lines, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([f"{folder}/{name}.warc.gz"]), pa.array([len(data)], pa.int64()), pa.array([columns[0]], pa.list_(pa.string()))]
                + [pa.array([c], pa.list_(pa.int64())) for c in columns[1:]],
                names=["archive", "path", "bytes", "surts", "pages", "starts", "sizes"],
            )

        for batch in batches:
            for piece in slices(batch, "html"):
                for page, link, body, sha, refers in zip(*(piece.column(c).to_pylist() for c in ("page", "url", "html", "sha", "refers")), strict=True):
                    digest = base64.b32encode(sha).decode()
                    member = gzip.compress(record(page, link, body, digest, refers, date), 6, mtime=0)
                    if lines and (len(data) + len(member) > ARCHIVE_BYTES or len(lines) >= ARCHIVE_RECORDS):
                        yield archive()
                        data, lines = bytearray(), []
                    lines.append((surt(link), NO_ID if page is None else page, len(data), len(member)))
                    data += member
        if lines:
            yield archive()

    return stored(spark, joined.mapInArrow(run, f"archive string, path string, bytes long, {LINES}"), "archives")


def index(archives: DataFrame) -> DataFrame:
    """block, first_surt, first_page, lines (compressed): sorted blocks of capture lines."""
    spark = archives.sparkSession
    each = archives.select("archive", F.explode(F.arrays_zip("surts", "pages", "starts", "sizes")).alias("x"))
    each = each.select(F.col("x.surts").alias("surt"), F.col("x.pages").alias("page"), "archive", F.col("x.starts").alias("start"), F.col("x.sizes").alias("size"))
    parts = (archives.agg(F.sum(F.size("pages"))).first()[0] or 0) // (BLOCK_LINES * DIRECTORY_SLICE) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held = TaskContext.get().partitionId(), 0, []

        def block(rows: list) -> pa.RecordBatch:
            text = "\n".join("\t".join(map(str, r)) for r in rows)
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | made]), pa.array([rows[0][0]]), pa.array([rows[0][1]]), pa.array([zlib.compress(text.encode())], pa.binary())],
                names=["block", "first_surt", "first_page", "lines"],
            )

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            while len(held) >= BLOCK_LINES:
                yield block(held[:BLOCK_LINES])
                held, made = held[BLOCK_LINES:], made + 1
        if held:
            yield block(held)

    order = ["surt", "page", "archive", "start"]
    dealt = each.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return stored(spark, dealt.mapInArrow(run, "block long, first_surt string, first_page long, lines binary"), "index")


def find(blocks: DataFrame, wanted: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """archive, page, start, size of the captures of each distinct (url, page_id) wanted."""
    spark = blocks.sparkSession
    keys = wanted.select(F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("page")).distinct()
    blocks = blocks.withColumn("slice", F.shiftright("block", 32))
    # one row for some DIRECTORY_SLICE * BLOCK_LINES captures
    top = blocks.groupBy("slice").agg(F.min(F.struct("first_surt", "first_page")).alias("first")).collect()
    top = sorted((tuple(r["first"]), r["slice"]) for r in top)
    firsts, ids = [r[0] for r in top], [r[1] for r in top]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for link, page in zip(batch.column("url").to_pylist(), batch.column("page").to_pylist(), strict=True):
                k = (surt(link), page)
                # from the slice before the first that starts at or after k, to the last that starts at k
                out += [(*k, ids[i]) for i in range(max(0, bisect.bisect_left(firsts, k) - 1), bisect.bisect_right(firsts, k))]
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["surt", "page", "slice"])

    hits = stored(spark, keys.mapInArrow(deal, "surt string, page long, slice long"), "wanted")
    # a slice of which very many keys are wanted is dealt to several tasks
    parts = hits.groupBy("slice").agg(F.ceil(F.count(F.lit(1)) / SEARCH_KEYS).cast("long").alias("parts")).filter("parts > 1")
    many = spark.createDataFrame(parts.collect(), "slice long, parts long")  # no more rows than the top level
    hits = hits.join(F.broadcast(many), "slice", "left").withColumn("part", F.pmod(F.xxhash64("surt", "page"), F.coalesce("parts", F.lit(1).cast("long")))).drop("parts")
    dealt = blocks.join(F.broadcast(many), "slice", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1).cast("long")) - 1)))

    def lines(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("block")
        directory = list(zip(right.column("first_surt").to_pylist(), right.column("first_page").to_pylist(), strict=True))
        asked: dict[int, set] = {}
        for k in zip(left.column("surt").to_pylist(), left.column("page").to_pylist(), strict=True):
            for i in range(max(0, bisect.bisect_left(directory, k) - 1), bisect.bisect_right(directory, k)):
                asked.setdefault(i, set()).add(k)
        out = []
        for i, some in asked.items():
            for x in zlib.decompress(right.column("lines")[i].as_py()).decode().split("\n"):
                r = x.split("\t")
                if (r[0], int(r[1])) in some:
                    out.append((r[2], int(r[1]), int(r[3]), int(r[4])))
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["archive", "page", "start", "size"])

    pairs = hits.groupBy("slice", "part").cogroup(dealt.select("slice", "part", "block", "first_surt", "first_page", "lines").groupBy("slice", "part"))
    return pairs.applyInArrow(lines, "archive string, page long, start long, size long")


def spans(places: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Ranges to read (start, size) with the places in each: places less than GAP apart are one."""
    held: list = []
    for start, size in sorted(places):
        if held and start - held[0][0] + size > ARCHIVE_BYTES or held and start - sum(held[-1]) > GAP:
            yield held[0][0], sum(held[-1]) - held[0][0], held
            held = []
        held.append((start, size))
    if held:
        yield held[0][0], sum(held[-1]) - held[0][0], held


def fetch(archives: DataFrame, places: DataFrame) -> DataFrame:
    """The captures at these places (archive, start, size): of each file only those byte ranges
    are read. Places of one file, at most ARCHIVE_RECORDS, go to one task."""
    files = archives.select("archive", "path")
    n_files = files.count()
    few = n_files <= BROADCAST_ARCHIVES
    # places are small, what they name isn't: some FILES files a task
    ranges = places.repartition(-(-max(1, n_files) // FILES), "archive").groupBy("archive").agg(F.collect_list(F.struct("start", "size")).alias("ranges"))
    ranges = ranges.join(F.broadcast(files) if few else files, "archive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [c.split() for c in CAPTURE.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        for batch in batches:
            for path, wanted in zip(batch.column("path").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                system, at = opened(path)
                with system.open_input_file(at) as file:
                    for start, size, held in spans([(x["start"], x["size"]) for x in wanted]):
                        data = file.read_at(size, start)
                        for a in range(0, len(held), 200):
                            got = [parse(data[s - start : s - start + n]) for s, n in held[a : a + 200]]
                            yield pa.RecordBatch.from_arrays([pa.array([g[n] for g in got], kinds[t]) for n, t in columns], names=[n for n, _ in columns])

    return ranges.mapInArrow(run, CAPTURE)


def export(archives: DataFrame, folder: str) -> int:
    """Copies each archive to a mounted folder, in the tasks; returns how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, at = opened(path)
                pyarrow.fs.copy_files(at, f"{folder}/{at.rsplit('/', 1)[1]}", source_filesystem=system, destination_filesystem=pyarrow.fs.LocalFileSystem())
            yield batch

    return archives.select("path").mapInArrow(run, "path string").count()
