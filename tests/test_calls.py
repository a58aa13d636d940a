"""Requests in flight, retries, kinds of errors, and engines made of them."""

import http.server
import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from foliospark.operators import calls


def test_bounded_in_flight_and_in_order():
    now, most, lock = [0], [0], threading.Lock()

    def transport(body, attempt):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.002 * (int(body) % 5))
        with lock:
            now[0] -= 1
        return 200, body * 2

    got = list(calls.in_order([str(i) for i in range(200)], transport, 7, 0, 0.0))
    assert [g[0] for g in got] == [str(i) * 2 for i in range(200)] and most[0] <= 7 and most[0] > 1


def test_retries_and_kinds():
    def transport(body, attempt):
        if body == "late":
            raise TimeoutError("late")
        if body == "gone":
            raise ConnectionRefusedError("gone")
        status = {"400": 400, "408": 408, "429": 429 if attempt < 1 else 200, "500": 500}.get(body, 200)
        return status, "text"

    got = {b: calls.asked(transport, b, 2, 0.0) for b in ("fine", "400", "408", "429", "500", "late", "gone")}
    assert {b: (g[1], g[3]) for b, g in got.items()} == {"fine": (None, 1), "400": ("rejected", 1), "408": ("timeout", 3), "429": (None, 2), "500": ("failed", 3), "late": ("timeout", 3), "gone": ("unreachable", 3)}
    assert got["fine"][0] == "text" and got["500"][2] == "500: text" and got["gone"][0] is None


def counting(path):
    def transport(body, attempt):
        with open(path, "a") as f:
            f.write(body + "\n")
        return 200, json.dumps({"choices": [{"message": {"content": body}}]})

    return transport


def test_equal_requests_are_asked_once(spark, tmp_path):
    df = spark.createDataFrame([(i, f"b{i % 5}" if i % 7 else None) for i in range(300)], "id int, b string").withColumn("reply", F.lit("old")).repartition(4)
    out = calls.called(df, F.col("b"), counting(str(tmp_path / "log")))
    assert out.count() == 300 and out.filter("b is null").filter("reply is null and attempts is null").count() == 43
    assert out.filter("b is not null and error is null and attempts = 1").count() == 257
    assert sorted((tmp_path / "log").read_text().split()) == [f"b{i}" for i in range(5)]
    assert calls.called(df.limit(0), F.col("b"), counting(str(tmp_path / "log"))).count() == 0


def test_strict_engines_end_the_job(spark):
    kind = "source string, preceding array<string>, following array<string>, terms array<struct<source:string,target:string>>"
    rows = spark.createDataFrame([("eins", [], [], []), (" ", [], [], [])], kind)
    good = calls.service_translator(lambda body, attempt: (200, json.dumps({"translations": [{"text": json.loads(body)["text"][0].upper()}]})), "de", "en")
    assert [(r["source"], r["translation"]) for r in good(rows).orderBy("source").collect()] == [(" ", None), ("eins", "EINS")]
    for transport in (lambda body, attempt: (200, "{}"), lambda body, attempt: (403, "forbidden")):
        with pytest.raises(Exception, match="malformed|rejected: 403: forbidden"):
            calls.chat_translator(transport, "m", "de", "en", retries=0)(rows).collect()


def test_corrections(spark):
    def transport(body, attempt):
        return 200, json.dumps({"choices": [{"message": {"content": "```json\n" + json.dumps({"alternatives": ["x", " ", "x", "y"], "confidence": 2}) + "\n```" if "good" in body else "no"}}]})

    rows = spark.createDataFrame([("good",), ("bad",)], "text string")
    out = {r["text"]: (r["proposed"], r["error"]) for r in calls.chat_corrector(transport, "m", "de", strict=False)(rows).collect()}
    assert out == {"good": (["x", "y"], None), "bad": (None, "malformed")}


def test_over_http(spark):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"])).decode()
            self.send_response(418 if body == "teapot" else 200)
            self.end_headers()
            self.wfile.write((self.headers["X-Key"] + body).encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    df = spark.createDataFrame([("a",), ("teapot",)], "b string")
    out = {r["b"]: tuple(r[1:]) for r in calls.called(df, F.col("b"), calls.http(f"http://127.0.0.1:{server.server_port}/", {"X-Key": "k"}, 20)).collect()}
    assert out == {"a": ("ka", None, None, 1), "teapot": (None, "rejected", "418: kteapot", 1)}
    server.shutdown()
    gone = calls.called(df.limit(1), F.col("b"), calls.http("http://127.0.0.1:1/", {}, 5), retries=1, pause=0.0)
    assert gone.first()["error"] == "unreachable" and gone.first()["attempts"] == 2
