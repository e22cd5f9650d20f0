"""The service: statuses, limits, traces, uploads, and one request over a socket."""

import base64
import json
from threading import Thread
from urllib.request import Request, urlopen

import pytest

from plumbline.config import Config
from plumbline.plans.engine import Corpora, Engine
from plumbline.plans.service import Service, serve

CONFIG = Config(k=1, retrieval_mode="dense", retrieval_gate=0.0, abstain_threshold=0.0)
TEXT = "\n".join(f"a line of text number {i}" for i in range(12))


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, CONFIG).index_texts(["Bread needs flour and water.", "Boats need wind to sail."])


def ask(service, question, **more):
    return service.handle("POST", "/answer", more.pop("headers", None), json.dumps({"question": question, **more}).encode(), more.pop("host", "h"))


def test_answers_and_traces(engine):
    s = Service(engine, examples=[{"question": "q?", "category": "c", "answer": "hidden"}])
    assert s.handle("GET", "/health") == (200, {"status": "ok", "ready": True})
    assert s.handle("GET", "/api/examples") == (200, [{"question": "q?", "category": "c"}])
    status, row = ask(s, "what do boats need")
    assert status == 200 and row["answer"].startswith("Boats") and row["abstained"] is False
    status, traces = s.handle("GET", "/traces")
    assert status == 200 and len(traces) == 1 and "what do boats" not in json.dumps(traces) and len(traces[0]["question_hash"]) == 12
    assert [x["stage"] for x in traces[0]["stages"]] == ["retrieve", "gate", "generate", "decompose", "entail", "score"] and all(x["ms"] > 0 for x in traces[0]["stages"])
    assert row["stage_timings"] == traces[0]["stages"] and traces[0]["corpus_id"] is None
    assert s.handle("GET", "/config")[1]["k"] == 1
    assert [ask(s, q)[0] for q in ("", None, "x" * 3000)] == [422, 422, 413]
    assert s.handle("POST", "/answer", {}, b"{", "h")[0] == 400 and s.handle("POST", "/answer", {}, b"[]", "h")[0] == 400
    assert [s.handle(m, p)[0] for m, p in (("GET", "/nowhere"), ("PUT", "/answer"), ("GET", "/corpora"))] == [404] * 3
    assert ask(Service(None), "q")[0] == 503 and ask(s, "q", corpus_id="x")[0] == 404


def test_token_and_limits(engine):
    s = Service(engine, token="t")
    assert s.handle("GET", "/traces")[0] == 401 and s.handle("GET", "/health")[0] == 200
    assert s.handle("GET", "/traces", {"Authorization": "Bearer t"})[0] == 200
    now = [0.0]
    s = Service(None, client=(2, 10.0), everyone=(3, 10.0), trust_proxy=True, clock=lambda: now[0])
    call = lambda who: s.handle("POST", "/answer", {"X-Forwarded-For": f"{who}, proxy"}, b'{"question": "q"}', "h")
    assert [call("a")[0], call("a")[0], call("a")[0]] == [503, 503, 429] and call("a")[1]["retry_after"] == 10
    assert [call("b")[0], call("c")[0]] == [503, 429]
    now[0] = 30.0
    assert call("a")[0] == 503 and set(s._clients) == {"a"}


def test_corpora(spark, tmp_path):
    s = Service(None, Corpora(spark, str(tmp_path), CONFIG))
    put = lambda name, data: s.handle("POST", "/corpora", {}, json.dumps({"filename": name, "content": base64.b64encode(data).decode()}).encode(), "h")
    assert s.handle("GET", "/corpora/limits")[1]["max_pdf_pages"] == 100 and s.handle("GET", "/corpora") == (200, [])
    status, made = put("a.md", TEXT.encode())
    assert status == 201 and [c["corpus_id"] for c in s.handle("GET", "/corpora")[1]] == [made["corpus_id"]]
    assert put("b.exe", b"x")[0] == 422 and s.handle("POST", "/corpora", {}, b'{"filename": "a", "content": "?"}', "h")[0] == 400
    assert ask(s, "a line of text", corpus_id=made["corpus_id"])[0] == 200
    assert s.handle("DELETE", f"/corpora/{made['corpus_id']}") == (204, None)
    assert s.handle("DELETE", f"/corpora/{made['corpus_id']}")[0] == 404


def test_over_a_socket(engine):
    server = serve(Service(engine), port=0)
    Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_address[1]}/answer"
        with urlopen(Request(url, json.dumps({"question": "bread"}).encode(), method="POST"), timeout=60) as got:
            assert got.status == 200 and json.load(got)["answer"].startswith("Bread")
    finally:
        server.shutdown()


def test_corpora_are_paged(spark):
    class Many:
        def list(self):
            return spark.range(2500).selectExpr("cast(id as string) as corpus_id", "timestamp_seconds(id) as created_at").orderBy("id")

    s = Service(None, Many())
    assert len(s.handle("GET", "/corpora")[1]) == 2500
    page = s.handle("GET", "/corpora?offset=2000&limit=300")[1]
    assert [page[0]["corpus_id"], page[-1]["corpus_id"]] == ["2000", "2299"]
    assert s.handle("GET", "/corpora?limit=x")[0] == s.handle("GET", "/corpora?offset=-1")[0] == 422
