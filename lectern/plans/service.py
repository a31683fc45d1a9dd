"""The façade over HTTP, for this machine: extract, export and estimate, JSON in and out.

`answer` is a function of path, query and body; the server below only carries it. Requests share one Spark session. GET serves
the files of one folder, `pages`, and nothing outside it.
"""

from __future__ import annotations

import argparse
import json
import mimetypes
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession

from ..operators import render as K
from ..sources import cards as S
from . import api
from .session import ship

#: File endings of the formats, and the port.
ENDINGS = {"md": "md", "compact": "txt", "json": "json"}
PORT = 8765
PAGES = Path(__file__).parent / "pages"

Reply = tuple[int, dict]


def _extract(spark: SparkSession, query: dict[str, list[str]], body: bytes) -> Reply:
    """One upload's card; a file without one is an answer, not an error of the request."""
    name = query.get("name", ["upload.png"])[0]
    cards, failures = S.extract_bytes(spark, [(name, body)])
    found = K.as_dict(cards).first()
    if found:
        return 200, {"ok": True, "card": json.loads(found["json"])}
    return 200, {"ok": False, "filename": name, "error": failures.first()["reason"]}


def _asked(spark: SparkSession, body: bytes) -> tuple[DataFrame, api.Options]:
    p = json.loads(body)
    o = api.Options(
        format=p.get("format", "md"), full=bool(p.get("full", False)), max_chars=p.get("max_chars", 600), full_top=int(p.get("full_top", 10) or 0), fields=p.get("fields", ["tags"]),
        caps=p.get("field_caps") or {}, tokenizer=p.get("tokenizer", "heuristic"), sort=p.get("sort", "best") if p.get("sort", "best") in ("best", "name") else "file", pinned=tuple(x for x in p.get("pinned") or () if x), removed=tuple(x for x in p.get("removed") or () if x),
    )
    if o.format not in ENDINGS:
        raise ValueError(f"unknown format {o.format!r}")
    rows = [(json.dumps(c | {"ord": i}),) for i, c in enumerate(p.get("cards", []))]
    return S.from_json(spark.createDataFrame(rows, "json string")), o


def _export(spark: SparkSession, query: dict, body: bytes) -> Reply:
    cards, o = _asked(spark, body)
    return 200, {"filename": f"cards_export.{ENDINGS[o.format]}", "content": api.export(cards, o)}


def _estimate(spark: SparkSession, query: dict, body: bytes) -> Reply:
    found = api.estimate(*_asked(spark, body))
    return 200, found | {"cards": [r.asDict() for r in found["cards"].collect()]}


ROUTES: dict[str, Callable[[SparkSession, dict, bytes], Reply]] = {"/api/extract": _extract, "/api/export": _export, "/api/estimate": _estimate}


def answer(spark: SparkSession, path: str, body: bytes) -> Reply:
    parts = urlsplit(path)
    route = ROUTES.get(parts.path)
    if route is None:
        return 404, {"error": "not found"}
    try:
        return route(spark, parse_qs(parts.query), body)
    except Exception as e:  # a bad request must not end the server
        return 400, {"error": str(e)}


def page(folder: Path, path: str) -> tuple[bytes, str] | None:
    """Content and type of a file below `folder`, or None: for what is not there, is no file, or lies outside."""
    asked = (folder / (unquote(urlsplit(path).path).lstrip("/") or "index.html")).resolve()
    if not asked.is_relative_to(folder.resolve()) or not asked.is_file():
        return None
    return asked.read_bytes(), mimetypes.guess_type(asked.name)[0] or "application/octet-stream"


def server(spark: SparkSession, host: str = "127.0.0.1", port: int = PORT, pages: Path = PAGES) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def reply(self, status: int, raw: bytes, kind: str) -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:  # noqa: N802
            found = page(Path(pages), self.path)
            self.reply(404, b"not found", "text/plain") if found is None else self.reply(200, *found)

        def do_POST(self) -> None:  # noqa: N802
            status, payload = answer(spark, self.path, self.rfile.read(int(self.headers.get("Content-Length") or 0)))
            self.reply(status, json.dumps(payload).encode(), "application/json; charset=utf-8")

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser("lectern.plans.service")
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=PORT)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("lectern-service").getOrCreate()
    ship(spark)
    with server(spark, a.host, a.port) as s:
        print(f"Serving on http://{a.host}:{s.server_address[1]}/")
        s.serve_forever()


if __name__ == "__main__":
    main()
