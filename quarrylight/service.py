"""Runs over HTTP: requests are checked, started through an injected function, and kept as records. Standard library only."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

# Options of a run, with their defaults; those that are a choice, with what may be chosen.
TEXTS = {"startup_name": "unknown", "output_dir": "runs", "corpus_path": "", "reranker_model": ""}
NUMBERS = {"limit": 1, "max_pages": 1, "max_depth": 0, "timeout_seconds": 15}
SWITCHES = {"render_js": False, "enable_search_provider": False, "enable_reranking": False, "narrative": False}
CHOICES = {
    "persistence_mode": ("json", "store", "json-store", "none"),
    "robots_policy": ("conservative", "permissive-on-error", "off"),
    "retrieval_mode": ("bm25", "hybrid"),
}
YES, NO = ("1", "true", "yes", "on"), ("0", "false", "no", "off")


def run_request(payload: Mapping[str, object]) -> dict[str, object]:
    """The options of a run from a request; ValueError names what is wrong with it."""
    text = lambda key: str(payload.get(key) if payload.get(key) is not None else "").strip()
    out: dict[str, object] = {k: text(k) or None for k in ("startup_url", "query")}
    if bool(out["startup_url"]) == bool(out["query"]):
        raise ValueError("provide_exactly_one_of_startup_url_or_query")
    out |= {k: text(k) or default for k, default in TEXTS.items()}
    for key, default in NUMBERS.items():
        try:
            out[key] = int(payload.get(key, default))
        except (TypeError, ValueError):
            raise ValueError(f"{key}_must_be_integer") from None
    for key, default in SWITCHES.items():
        said = str(payload.get(key, default)).strip().lower()
        if said not in YES + NO:
            raise ValueError(f"{key}_must_be_boolean")
        out[key] = said in YES
    for key, allowed in CHOICES.items():
        out[key] = text(key) or allowed[0]
        if out[key] not in allowed:
            raise ValueError(f"{key}_must_be_one_of:{','.join(allowed)}")
    return out


class Runs:
    """Records of runs. start(options) does the work and returns a result to keep; what it raises is kept as an error."""

    def __init__(self, start: Callable[[dict[str, object]], Mapping[str, object]]):
        self.start, self.records = start, {}

    def create(self, payload: Mapping[str, object]) -> dict[str, object]:
        options = run_request(payload)
        name = f"{datetime.now(UTC):%Y%m%dT%H%M%SZ}-{uuid.uuid4().hex[:8]}"
        record = {"run_id": name, "options": options, "status": "completed", "errors": [], "result": {}}
        try:
            record["result"] = dict(self.start(options))
        except Exception as e:  # noqa: BLE001 - a run that fails is a record
            record |= {"status": "failed", "errors": [{"type": type(e).__name__, "message": str(e)}]}
        self.records[name] = record
        return record

    def get(self, run_id: str) -> dict[str, object]:
        return self.records[run_id]


def handler(runs: Runs, matrix: Callable[[tuple[str, ...]], object] | None = None, origins: tuple[str, ...] = ()) -> type[BaseHTTPRequestHandler]:
    """GET /health, POST /api/runs, GET /api/runs/ID, GET /api/check-matrix?only=a,b."""

    class Handler(BaseHTTPRequestHandler):
        def reply(self, code: int, body: object) -> None:
            data = json.dumps(body, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            if self.headers.get("Origin") in origins:
                self.send_header("Access-Control-Allow-Origin", self.headers["Origin"])
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:  # noqa: N802
            url = urlsplit(self.path)
            if url.path == "/health":
                self.reply(200, {"status": "ok"})
            elif url.path == "/api/check-matrix" and matrix:
                only = parse_qs(url.query).get("only", [""])[0]
                self.reply(200, matrix(tuple(dict.fromkeys(x.strip() for x in only.split(",") if x.strip()))))
            elif url.path.startswith("/api/runs/") and (name := url.path.removeprefix("/api/runs/")) in runs.records:
                self.reply(200, runs.get(name))
            else:
                self.reply(404, {"detail": "run_not_found" if url.path.startswith("/api/runs/") else "not_found"})

        def do_POST(self) -> None:  # noqa: N802
            if urlsplit(self.path).path != "/api/runs":
                self.reply(404, {"detail": "not_found"})
                return
            try:
                payload = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                self.reply(201, runs.create(payload if isinstance(payload, dict) else {}))
            except ValueError as e:
                self.reply(400, {"detail": str(e)})

        def log_message(self, *args: object) -> None:
            pass

    return Handler


def serve(runs: Runs, port: int = 8000, host: str = "127.0.0.1", **how) -> ThreadingHTTPServer:  # noqa: ANN003
    """A server that is bound but not running yet: call serve_forever."""
    return ThreadingHTTPServer((host, port), handler(runs, **how))
