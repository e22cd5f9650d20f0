"""A small HTTP service over corpora: answers, traces, uploads, with limits.

`Service.handle` maps a request to a status and a JSON value and needs no socket; `serve` puts it
behind the standard library's server. Each answer is a Spark job, so this is for people who try a
corpus out, not for load.
"""

from __future__ import annotations

import base64
import json
import math
import time
from collections import deque
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Lock
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans.answer import Stages
from plumbline.plans.engine import Corpora, Engine
from plumbline.streaming.limiter import decide

#: Bounds: kept traces, characters of a question, bytes of an upload, pages of a PDF file.
TRACES, QUESTION_CHARS, UPLOAD_BYTES, PDF_PAGES = 100, 2000, 10 << 20, 100


class Refused(Exception):
    def __init__(self, status: int, message: str, retry: int | None = None):
        super().__init__(message)
        self.status, self.retry = status, retry


class Service:
    """engine: the corpus that is asked by default; corpora: uploads; examples: questions with a
    category; token: what a client must send, and what frees it of limits, if set."""

    def __init__(
        self, engine: Engine | None, corpora: Corpora | None = None, examples: list[dict] | None = None, token: str | None = None,
        client: tuple[int, float] = (10, 60.0), everyone: tuple[int, float] = (60, 60.0), trust_proxy: bool = False, clock: Callable[[], float] = time.time,
    ):
        self.engine, self.corpora, self.examples, self.token = engine, corpora, examples or [], token
        self.client, self.everyone, self.trust_proxy, self.clock = client, everyone, trust_proxy, clock
        self.traces: deque[dict] = deque(maxlen=TRACES)
        self._clients: dict[str, deque] = {}
        self._all: deque = deque()
        self._lock = Lock()

    def handle(self, method: str, path: str, headers: dict | None = None, body: bytes = b"", host: str | None = None) -> tuple[int, object]:
        """The status and the JSON value (None for no content) of a request."""
        headers = {k.lower(): v for k, v in (headers or {}).items()}
        place = urlsplit(path)
        parts, asked = [p for p in place.path.split("/") if p], dict(parse_qsl(place.query))
        try:
            return self._route(method, parts, headers, body, host, asked)
        except Refused as e:
            return e.status, {"detail": str(e), **({"retry_after": e.retry} if e.retry is not None else {})}

    def _route(self, method: str, parts: list[str], headers: dict, body: bytes, host: str | None, asked: dict) -> tuple[int, object]:
        if (method, parts) == ("GET", ["health"]):
            return 200, {"status": "ok", "ready": self.engine is not None}
        if (method, parts) == ("GET", ["corpora", "limits"]):
            return 200, {"max_bytes": UPLOAD_BYTES, "max_pdf_pages": PDF_PAGES, "types": [".pdf", ".md", ".txt"]}
        if (method, parts) == ("GET", ["api", "examples"]):
            return 200, [{"question": e["question"], "category": e.get("category")} for e in self.examples]
        known = parts[:1] in (["config"], ["answer"], ["traces"], ["corpora"])
        if not known:
            raise Refused(404, "no such path")
        if self.token is not None and headers.get("authorization") != f"Bearer {self.token}":
            raise Refused(401, "a valid token is needed")
        if (method, parts) == ("GET", ["config"]):
            c = self._ready(None).config
            return 200, {n: getattr(c, n) for n in ("k", "retrieval_mode", "rerank", "retrieval_gate", "abstain_threshold", "support_threshold", "weights")}
        if (method, parts) == ("GET", ["traces"]):
            return 200, list(reversed(self.traces))
        if (method, parts) == ("POST", ["answer"]):
            self._admit(headers, host)
            return 200, self._answer(self._json(body))
        if parts[0] == "corpora" and self.corpora is not None:
            if (method, len(parts)) == ("GET", 1):
                return 200, [r.asDict() | {"created_at": str(r.created_at)} for r in self._page(self.corpora.list(), asked).toLocalIterator()]
            if (method, len(parts)) == ("POST", 1):
                self._admit(headers, host)
                return 201, self._upload(self._json(body))
            if (method, len(parts)) == ("DELETE", 2):
                try:
                    self.corpora.delete(parts[1])
                except KeyError as e:
                    raise Refused(404, "no such corpus") from e
                return 204, None
        raise Refused(404, "no such path")

    @staticmethod
    def _page(rows: DataFrame, asked: dict) -> DataFrame:
        """All rows, or those that ?offset= and ?limit= ask for."""
        try:
            skip, most = int(asked.get("offset", 0)), int(asked["limit"]) if "limit" in asked else None
        except ValueError as e:
            raise Refused(422, "offset and limit are numbers") from e
        if skip < 0 or (most is not None and most < 0):
            raise Refused(422, "offset and limit aren't negative")
        rows = rows.offset(skip) if skip else rows
        return rows if most is None else rows.limit(most)

    def _ready(self, corpus_id: str | None) -> Engine:
        if corpus_id is not None:
            try:
                if self.corpora is not None:
                    return self.corpora.engine(corpus_id)
            except KeyError:
                pass
            raise Refused(404, "no such corpus")
        if self.engine is None:
            raise Refused(503, "nothing is indexed yet")
        return self.engine

    @staticmethod
    def _json(body: bytes) -> dict:
        try:
            found = json.loads(body or b"null")
        except ValueError as e:
            raise Refused(400, "the body is no JSON") from e
        if not isinstance(found, dict):
            raise Refused(400, "the body is no JSON object")
        return found

    def _admit(self, headers: dict, host: str | None) -> None:
        """Asks the client's limit, then everyone's; a valid token needs neither."""
        if self.token is not None:
            return
        first = headers.get("x-forwarded-for", "").split(",")[0].strip() if self.trust_proxy else ""
        with self._lock:
            now = self.clock()
            for key in [k for k, live in self._clients.items() if live and live[-1] <= now - self.client[1]]:
                del self._clients[key]  # clients that are idle for a window
            for live, (most, window) in ((self._clients.setdefault(first or host or "unknown", deque()), self.client), (self._all, self.everyone)):
                passed, retry = decide(live, now, most, window)
                if not passed:
                    raise Refused(429, "too many requests", retry)

    def _answer(self, asked: dict) -> dict:
        question = asked.get("question")
        if not isinstance(question, str) or not question.strip():
            raise Refused(422, "a question is needed")
        if len(question) > QUESTION_CHARS:
            raise Refused(413, f"a question has at most {QUESTION_CHARS} characters")
        engine, began = self._ready(asked.get("corpus_id")), self.clock()
        stages = Stages()
        row = engine.answer([question], stages=stages).first().asDict()
        clean = {k: None if isinstance(v, float) and math.isnan(v) else v for k, v in row.items() if k != "qid"}
        hashed = engine.spark.range(1).select(F.left(F.sha2(F.lit(question).cast("binary"), 256), F.lit(12))).first()[0]
        self.traces.append({"question_hash": hashed, "abstained": row["abstained"], "trust_geometric": None if row["abstained"] else row["t_geom"], "corpus_id": asked.get("corpus_id"), "stages": stages.told(), "total_ms": 1000 * (self.clock() - began)})
        return {"question": question, "stage_timings": stages.told()} | clean

    def _upload(self, sent: dict) -> dict:
        name, content = sent.get("filename"), sent.get("content")
        if not isinstance(name, str) or not isinstance(content, str):
            raise Refused(422, "filename and content (base64) are needed")
        try:
            data = base64.b64decode(content, validate=True)
        except ValueError as e:
            raise Refused(400, "content is no base64") from e
        if len(data) > UPLOAD_BYTES:
            raise Refused(413, f"an upload has at most {UPLOAD_BYTES} bytes")
        rows = self.corpora.spark.createDataFrame([(name, data)], "filename string, content binary")
        made = self.corpora.add(rows, most_bytes=UPLOAD_BYTES, most_pages=PDF_PAGES).first()
        if made.reason is not None:
            raise Refused(422, made.reason)
        return {"corpus_id": made.corpus_id, "filename": made.filename}


def serve(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server of the service, not started; `serve_forever` runs it."""

    class Handler(BaseHTTPRequestHandler):
        def _do(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if size > 2 * UPLOAD_BYTES:
                status, value = 413, {"detail": "the body is too large"}
            else:
                status, value = service.handle(self.command, self.path, dict(self.headers), self.rfile.read(size), self.client_address[0])
            data = b"" if value is None else json.dumps(value, default=str).encode()
            self.send_response(status)
            if status == 429 and isinstance(value, dict):
                self.send_header("Retry-After", str(value.get("retry_after", 1)))
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_DELETE = _do

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
