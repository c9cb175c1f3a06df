"""HTTP face of a search engine: POST /search, GET /health, GET /stats; standard library only."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .operators.search import SearchEngine

MOST_RESULTS = 50


def parse_request(body: bytes, default_k: int) -> tuple[str, int]:
    """(query, top_k) of a request; ValueError if they are not acceptable."""
    found = json.loads(body)
    query, k = found.get("query"), found.get("top_k", default_k)
    if not isinstance(query, str) or len(query) < 2:
        raise ValueError("query: a string of two characters at least")
    if not isinstance(k, int) or isinstance(k, bool) or not 1 <= k <= MOST_RESULTS:
        raise ValueError(f"top_k: a number from 1 to {MOST_RESULTS}")
    return query, k


def respond(engine: SearchEngine | None, method: str, path: str, body: bytes = b"") -> tuple[int, dict]:
    """(status, content): 503 without an engine, 400 for bad requests, 500 for anything else."""
    if (method, path) == ("GET", "/health"):
        return 200, {"status": "ok" if engine else "unavailable", "engine_loaded": engine is not None}
    if (method, path) not in (("GET", "/stats"), ("POST", "/search")):
        return 404, {"detail": "not found"}
    if engine is None:
        return 503, {"detail": "search engine not loaded"}
    try:
        if path == "/stats":
            return 200, engine.get_stats()
        query, k = parse_request(body, engine.config.top_k)
        return 200, {"query": query, "results": engine.search(query, k)}
    except ValueError as e:
        return 400, {"detail": str(e)}
    except Exception as e:
        return 500, {"detail": str(e)}


def serve(engine: SearchEngine | None, host: str = "0.0.0.0", port: int = 8000) -> ThreadingHTTPServer:
    """A server that is ready to run (``serve_forever``)."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, content = respond(engine, self.command, self.path, body)
            data = json.dumps(content, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _answer

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
