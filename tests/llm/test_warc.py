import base64
import gzip
import hashlib
import random

import pytest

from plumbline.llm import warc as W

R = random.Random(0)
PAGES = [(i, f"http://{R.choice('abc')}.example.{R.choice(['com', 'org'])}/p{R.randrange(30)}?q=ü {i % 3}", R.choice(["x", "", None, "é" * 3000, f"<p>{i}</p>"])) for i in range(150)]
PAGES += [(1000, None, "x"), (1001, "no scheme\n\t%", "y"), (None, "http://n.org/", "only null"), (None, "http://n.org/", "x"), (7, "http://a.com/dup", "z"), (7, "http://a.com/dup", "z"), (1002, "", "w\r\n\r\nw")]


def brute(pages, least):
    sets = {}
    for page, _, html in pages:
        body = (html or "").encode()
        sets.setdefault(body, []).append(page)
    out = []
    for page, _, html in pages:
        body = (html or "").encode()
        best = max((p for p in sets[body] if p is not None), default=None)
        revisit = len(body) >= least and best is not None and page != best
        out.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", best if revisit else None))
    return sorted(out, key=str)


def through(df, least):
    archives = W.write(df, least)
    return archives, W.fetch(archives, W.find(W.index(archives), df))


@pytest.mark.parametrize("least,small", [(0, False), (0, True), (2, True)])
def test_equals_brute_force(spark, monkeypatch, tmp_path, least, small):
    if small:
        for name, value in (("ARCHIVE_BYTES", 4000), ("BLOCK_LINES", 7), ("BROADCAST_REPEATS", 0), ("BROADCAST_ARCHIVES", 0), ("DIRECTORY_SLICE", 4)):
            monkeypatch.setattr(W, name, value)
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 as archive", "'q' as surt").repartition(3)
    archives, got = through(df, least)
    rows = got.collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str) == brute(PAGES, least)
    assert sorted(r.url for r in rows) == sorted(u or "" for _, u, _ in PAGES)
    assert W.export(archives, str(tmp_path)) == archives.count()
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in tmp_path.iterdir())
    assert whole.count(b"WARC-Record-ID") == len(PAGES)


def test_lookup_of_some(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    archives = W.write(df)
    wanted = spark.createDataFrame([PAGES[3][:2], PAGES[9][:2], (5, "http://missing/"), PAGES[3][:2], (7, "http://a.com/dup")], "page_id long, url string")
    got = sorted(r.page_id for r in W.fetch(archives, W.find(W.index(archives), wanted)).collect())
    assert got == sorted([3, 9, 7, 7])


def test_nothing(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert through(df, 0)[1].count() == 0


def test_surt_orders_by_domain():
    assert W.surt("http://WWW.example.com/A?b#c") == "com,example,www)/A?b#c"
    assert W.surt("plain") == "plain" and "\t" not in W.surt("a\tb")
    with pytest.raises(ValueError):
        bad = W.record(1, "u", b"abc", W.digest_of(b"abd"), None, "d")
        W.parse(gzip.compress(bad))
