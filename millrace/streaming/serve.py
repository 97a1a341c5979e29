"""A small NDJSON server over ``Dataset``: health, the catalogue, and shuffled streams.

    GET /v1/health
    GET /v1/datasets            GET /v1/datasets/{id}
    GET /v1/streams/{id}?seed=&shuffle=&sample=&epochs=&rank=&world_size=&client=

Spark runs the plans; a response pulls partition by partition, so a slow client
holds its own stream back. ``sample`` counts per epoch. Each ``client`` has a seed of its own, made
of the one asked for; X-Seed is the one that was used. With ``tokens`` all but
health needs one of them as a bearer token. It listens on the loopback address
unless told otherwise, and has no TLS: put it behind a proxy that has.
"""

from __future__ import annotations

import hmac
import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame

from ..functions.prf import client_seed
from ..operators.errors import InputMissing, UsageError
from ..operators.index import Catalogue
from .dataset import Dataset, of_units


def _number(query: dict, name: str, default: int | None) -> int | None:
    if name not in query:
        return default
    try:
        return int(query[name][-1])
    except ValueError as e:
        raise UsageError(f"{name} is no number") from e


def server(catalogue: Catalogue, load: Callable[[str], DataFrame], tokens: list[str] | None = None, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server to run with ``serve_forever``. ``load`` gives the placed units of a path, or its records: id, record, pos and frame_id."""

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def log_message(self, *args) -> None:
            pass

        def answer(self, status: int, body: object) -> None:
            raw = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def allowed(self) -> bool:
            given = self.headers.get("Authorization", "").removeprefix("Bearer ").encode()
            return tokens is None or any([hmac.compare_digest(given, t.encode()) for t in tokens])

        def do_GET(self) -> None:
            url = urlsplit(self.path)
            parts = url.path.strip("/").split("/")
            try:
                if parts == ["v1", "health"]:
                    return self.answer(200, {"status": "ok"})
                if not self.allowed():
                    return self.answer(401, {"error": "a bearer token is needed"})
                if parts == ["v1", "datasets"]:
                    return self.answer(200, [{"id": n, "fingerprint": f} for n, (_, f) in catalogue.entries.items()])
                if parts[:2] == ["v1", "datasets"] and len(parts) == 3:
                    return self.answer(200, {"id": parts[2], "path": catalogue.path(parts[2]), "fingerprint": catalogue.entries[parts[2]][1]})
                if parts[:2] == ["v1", "streams"] and len(parts) == 3:
                    return self.stream(parts[2], parse_qs(url.query))
                return self.answer(404, {"error": "no such address"})
            except InputMissing as e:
                return self.answer(404, {"error": f"no dataset {e}"})
            except UsageError as e:
                return self.answer(400, {"error": str(e)})

        def stream(self, name: str, query: dict) -> None:
            mode = query.get("shuffle", ["chunk-shuffled"])[-1]
            n = {k: _number(query, k, d) for k, d in (("seed", 0), ("epochs", 1), ("sample", None), ("rank", None), ("world_size", None))}
            if "client" in query:
                n["seed"] = client_seed(n["seed"], query["client"][-1])
            found = load(catalogue.path(name))
            lines = (of_units if "first_pos" in found.columns else Dataset)(found, mode, n["seed"], n["epochs"], n["sample"], "epoch", n["rank"], n["world_size"])
            self.send_response(200)
            for key, value in (("Content-Type", "application/x-ndjson"), ("Transfer-Encoding", "chunked"), ("X-Seed", n["seed"]), ("X-Shuffle", mode), ("X-Fingerprint", catalogue.entries[name][1])):
                self.send_header(key, str(value))
            self.end_headers()
            try:
                for line in lines:
                    self.chunk(line)
            except BrokenPipeError:
                self.close_connection = True
                return
            except Exception as e:  # the status line is out: say it in the stream
                self.chunk(json.dumps({"_error": str(e)[:500]}).encode() + b"\n")
            self.chunk(b"")

        def chunk(self, raw: bytes) -> None:
            self.wfile.write(b"%x\r\n%s\r\n" % (len(raw), raw))

    return ThreadingHTTPServer((host, port), Handler)
