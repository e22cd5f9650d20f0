"""Archives are files of which only ranges are read; URLs come back as they were."""

import base64
import gzip
import hashlib

import pytest

from plumbline.llm import warc as W

URLS = ["http://x.com/a%20b?q=%41", "http://x.com/a b?q=A", "http://x.com/%", "http://x.com/ü%C3%BC", "http://x.com/\r\nX: y", "", "http://x.com/'\"<>|", "%25", "http://x.com/plain"]


@pytest.mark.parametrize("url", URLS)
def test_url_round_trip(url):
    body = b"payload"
    raw = W.record(3, url, body, W.digest_of(body), None, "d")
    assert W.parse(gzip.compress(raw))["url"] == url
    if url.endswith("%41"):  # a legal URI stands in the header as it is
        assert f"WARC-Target-URI: {url}\r\n".encode() in raw


def test_surts_of_escaped_urls_differ():
    assert len({W.surt(u) for u in URLS}) == len(URLS)


def test_only_ranges_are_read(spark):
    pages = [(i, URLS[i % len(URLS)], f"<p>{i}</p>" * (1 + i % 7)) for i in range(60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    archives = W.write(df)
    wanted = df.filter("page_id in (7, 31)")
    places = W.find(W.index(archives), wanted).collect()
    assert len(places) == 2
    files = {r.archive: r for r in archives.collect()}
    for p in places:  # everything outside the wanted ranges is overwritten, so reading it would fail
        path = files[p.archive].path.removeprefix("file://")
        with open(path, "rb") as f:
            data = bytearray(f.read())
        assert len(data) == files[p.archive].bytes
        keep = [(q.start, q.start + q.size) for q in places if q.archive == p.archive]
        for at in range(len(data)):
            if not any(a <= at < b for a, b in keep):
                data[at] = 0
        with open(path, "wb") as f:
            f.write(data)
    got = {r.page_id: r for r in W.fetch(archives, spark.createDataFrame(places)).collect()}
    assert {i: (r.url, bytes(r.payload).decode()) for i, r in got.items()} == {i: pages[i][1:] for i in (7, 31)}


def test_spans_join_near_places_only():
    assert [(a, n) for a, n, _ in W.spans([(0, 5), (5, 5), (20 + W.GAP, 3)])] == [(0, 10), (20 + W.GAP, 3)]
    assert list(W.spans([])) == []


def test_hot_slice_is_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(W, "SEARCH_KEYS", 5)
    monkeypatch.setattr(W, "BLOCK_LINES", 4)
    df = spark.createDataFrame([(i, f"http://h.com/{i % 9}", "same") for i in range(50)] + [(3, "http://h.com/3", "same")], "page_id long, url string, html string")
    archives = W.write(df)
    more = df.unionByName(spark.createDataFrame([(i, "http://none.org/", "") for i in range(30)], df.schema))
    got = W.fetch(archives, W.find(W.index(archives), more)).collect()
    digest = base64.b32encode(hashlib.sha1(b"same").digest()).decode()
    assert sorted((r.page_id, r.record_type, r.payload_digest) for r in got) == sorted((i, "response" if i == 49 else "revisit", digest) for i in [*range(50), 3])
