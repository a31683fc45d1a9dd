"""The façade over HTTP."""

import json
import threading
import urllib.error
import urllib.request

import pytest

from lectern.plans import service
from lectern.sources import cards as S
from lectern.sources import png

from .test_cards import image, text_chunk, wrapped


@pytest.fixture(scope="module")
def post(spark):
    s = service.server(spark, port=0)
    threading.Thread(target=s.serve_forever, daemon=True).start()

    def call(path, body):
        request = urllib.request.Request(f"http://127.0.0.1:{s.server_address[1]}{path}", data=body if isinstance(body, bytes) else json.dumps(body).encode())
        try:
            with urllib.request.urlopen(request, timeout=120) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    yield call
    s.shutdown()


def test_extract(post):
    status, got = post("/api/extract?name=a%20b.png", image(text_chunk("chara", wrapped(name="Ann", tags=["x"], alternate_greetings=["Hi"]))))
    assert status == 200 and got["ok"] and got["card"]["name"] == "Ann" and got["card"]["source_file"] == "a b.png"
    assert got["card"]["tags"] == ["x"] and got["card"]["alternate_greetings"] == ["Hi"]
    assert post("/api/extract?name=x.png", b"nope") == (200, {"ok": False, "filename": "x.png", "error": png.NOT_A_PNG})
    assert post("/api/extract", image())[1] == {"ok": False, "filename": "upload.png", "error": S.NO_CARD}


def test_export_and_estimate(post):
    cards = [{"name": f"N{i}", "description": "d" * 900, "source_file": f"{i}.png", "unknown": 1} for i in range(4)]
    status, got = post("/api/export", {"cards": cards, "format": "compact", "full_top": 1, "pinned": ["2.png"]})
    assert status == 200 and got["filename"] == "cards_export.txt" and got["content"].count("d" * 900) == 1
    assert got["content"].index("Name: N2") < got["content"].index("Name: N0")
    status, got = post("/api/estimate", {"cards": cards, "format": "json", "full": True})
    assert status == 200 and [c["index"] for c in got["cards"]] == [1, 2, 3, 4] and got["total_tokens"] > sum(c["tokens"] for c in got["cards"])
    assert post("/api/export", {"format": "pdf"}) == (400, {"error": "unknown format 'pdf'"})
    assert post("/api/estimate", b"{")[0] == 400 and post("/api/other", b"")[0] == 404


def test_pages(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "index.html").write_text("<p>")
    (tmp_path / "secret").write_text("no")
    assert service.page(tmp_path / "in", "/") == (b"<p>", "text/html") and service.page(tmp_path / "in", "/index.html?x=1")[0] == b"<p>"
    for path in ("/../secret", "/%2e%2e/secret", "/missing", "//" + str(tmp_path / "secret"), "/."):
        assert service.page(tmp_path / "in", path) is None
    assert b"/api/export" in service.page(service.PAGES, "/")[0]
