import http.server
import json
import threading

import numpy as np

from ledgerlens.extract.engines import HttpModel, ask, page_texts, recognize
from ledgerlens.sources import images


def reader():
    """A factory that is shipped whole, as workers cannot import this module."""

    def make():
        class Reader:
            def read(self, picture):
                if picture == b"bad":
                    raise ValueError("no picture")
                return [("right", 0.5, (90, 9, 120, 20)), ("left", 0.7, (1, 10, 30, 20)), ("below", 0.9, (1, 40, 30, 50))] if picture else []

        return Reader()

    return make


def echo():
    def make():
        class Echo:
            def ask(self, system, user):
                if user == "boom":
                    raise RuntimeError("x")
                return f"{system}:{len(user)}"

        return Echo()

    return make


def test_recognition_keeps_keys_and_reading_order(spark):
    df = spark.createDataFrame([("a", b"p"), ("b", b"bad"), ("c", b""), ("d", None)], "key string, picture binary")
    lines = recognize(df, reader())
    assert {r.key for r in lines.where("error is not null").collect()} == {"b", "d"}
    assert [(r.key, r.ocr_text, round(r.ocr_confidence, 2)) for r in page_texts(lines).collect()] == [("a", "left\nright\nbelow", 0.7)]
    assert recognize(df.limit(0), reader()).count() == 0


def test_models_answer_by_key(spark):
    df = spark.createDataFrame([("a", "hi"), ("b", "boom"), ("c", None), ("d", "x" * 50_000)], "key string, prompt string")
    got = {r.key: (r.answer, r.error) for r in ask(df, echo(), "s", most_at_once=2).collect()}
    assert got == {"a": ("s:2", None), "b": (None, "RuntimeError: x"), "c": (None, None), "d": ("s:20000", None)}


def test_cut_prompts_are_marked(spark):
    df = spark.createDataFrame([("a", "hi"), ("c", None), ("d", "x" * 50_000)], "key string, prompt string")
    assert {r.key: r.n_unsent for r in ask(df, echo(), "s").collect()} == {"a": 0, "c": 0, "d": 30_000}


def test_http_model_tries_again():
    codes = iter([500, 429, 200, 404])

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            self.rfile.read(int(self.headers["Content-Length"]))
            code = next(codes)
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": "{}"}}]}).encode() if code == 200 else b"")

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    m = HttpModel(f"http://127.0.0.1:{server.server_port}", "m", first_wait=0.01)
    assert m.ask("s", "u") == "{}"
    try:
        m.ask("s", "u")
        raise AssertionError("a 404 is final")
    except Exception as e:
        assert "404" in str(e)
    server.shutdown()


def test_picture_primitives():
    page = np.full((1000, 400), 250, np.uint8)
    page[500:640, 50:350] = 20
    assert 20 <= images.otsu(page) < 250
    top, end = images.ink_band(page)
    assert abs(top - 500) <= 15 and abs(end - 639) <= 15
    assert images.to_gray(np.dstack([page] * 3)).shape == page.shape and images.upscale(page, 2000).shape == (2000, 800)
    assert set(np.unique(images.binarize(page))) == {0, 255} and images.unsharp(page).shape == page.shape
    a = np.random.default_rng(0).integers(0, 255, (20, 30)).astype(np.uint8)
    want = np.pad(a.astype(float), 2, mode="edge")[3:8, 4:9].mean()
    assert abs(images.box_mean(a, 5)[3, 4] - want) < 1e-9
