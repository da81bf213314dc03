"""Budgets, replies, decisions, registers, the HTTP client and the stream."""

import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.operators import budget, integrity, rerank
from spindrift.sources import models
from spindrift.streaming import ingest
from spindrift.verdicts import VERDICTS, Refused


def _one(spark, schema, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_completion(spark):
    rows = [("a", "stop"), ("a", "length"), ("a", None), ("a \n", None), ("a", "load"), ("  ", "stop"), (None, None)]
    got = _one(spark, "t string, r string", rows, T.completion_verdict("t", "r"), T.trailing_white("t", "r"))
    assert [g[0] for g in got] == ["ok", "truncated", "completion_unverified", "completion_unverified", "completion_unverified", "empty_generation", "empty_generation"]
    assert [g[1] for g in got] == [False, False, False, True, False, False, False]


def test_thinking(spark):
    rows = [("", "hm"), ("", None), ("a", "hm"), (" ", "")]
    got = _one(spark, "t string, h string", rows, T.thinking_chars("h"), T.empty_remedy("t", "h"))
    assert got == [(2, "raise max_tokens or think less"), (None, "check max_tokens or try another model"), (2, None), (None, "check max_tokens or try another model")]


def test_budget_edges(spark):
    rows = spark.createDataFrame([("x" * 3100, 1000), ("x" * 2717, 1000), ("x" * 10, None), (None, 8)], "t string, l bigint")
    got = budget.context_checks(rows, "t", F.col("l")).collect()
    assert [(r.estimate, r.usable, r.verdict) for r in got] == [(969, 850, "context_exceeded"), (850, 850, "ok"), (4, None, "context_unknown"), (1, 6, "ok")]
    assert {r.verdict for r in budget.context_checks(rows, "t", F.col("l"), allow_truncation=True).collect()} == {"ok"}
    assert budget.context_checks(rows.limit(1), "t", 1000, headroom=0.05).first().usable == 950


def test_prefixes():
    assert T.prefixes_for("nomic-embed-text:v1.5")[0] == "search_document: " and T.prefixes_for("other") == ("", "")


def test_replies(spark):
    rows = [(0, 3, "0=0\n1=0\n 2 = 2 \nprose 1=9", None), (1, 5, '{"0": 1, "4": 2, "5": 7}', None), (2, 2, "[0]: 1\n[0]: 2.5\n1=-1", None), (3, 5, "", None), (4, 5, None, "timed out")]
    replies = spark.createDataFrame(rows, "batch bigint, size bigint, reply string, error string")
    scores = rerank.parsed(replies)
    assert sorted(map(tuple, scores.collect())) == [(0, 0.0), (1, 0.0), (2, 2.0), (5, 1.0), (9, 2.0), (10, 2.5), (11, -1.0)]
    assert sorted(map(tuple, rerank.failures(replies, scores).collect())) == [(3, "unparseable ((empty))"), (4, "timed out")]


def test_order_is_not_the_input_order(spark):
    pool = spark.createDataFrame([(0, 0.9), (1, 0.8), (2, 0.7), (3, 0.6)], "pos bigint, cosine double")
    scores = spark.createDataFrame([(2, 2.0), (0, 0.0), (3, 0.0)], "pos bigint, score double")
    assert [r.pos for r in rerank.ordered(pool, scores, 4).orderBy("place").collect()] == [2, 0, 3, 1]
    none = rerank.ordered(pool, scores.where("false"), 3).orderBy("place").collect()
    assert [(r.pos, r.score) for r in none] == [(0, None), (1, None), (2, None)]


@pytest.mark.parametrize(("scores", "want"), [
    ([2, 2, 2], {"weak_discrimination": True, "pool_may_be_short": False, "none_answers": False}), ([1, 1, 0], {"weak_discrimination": True, "pool_may_be_short": True}),
    ([0, 0, 0], {"none_answers": True, "pool_may_be_short": False}), ([9, 1, 0], {"own_scale": True, "pool_may_be_short": False}), ([], {"judged": 0, "none_answers": False, "weak_discrimination": False}),
])
def test_flags(spark, scores, want):
    df = spark.createDataFrame([(i, float(s)) for i, s in enumerate(scores)], "pos bigint, score double")
    got = rerank.flags(df, df, 20).first().asDict()
    assert {k: got[k] for k in want} == want


def test_labels(spark):
    rows = [(2.0, 2.0), (1.0, 2.0), (0.0, 2.0), (1.5, 2.0), (-1.0, 2.0), (7.0, 9.0), (None, 2.0)]
    assert [g[0] for g in _one(spark, "s double, h double", rows, rerank.label("s", "h"))] == ["ANSWERS", "partial", "topic only", "1.5", "-1.0", "7.0", "not judged"]


def test_prompts_are_of_five_whatever_the_partitions(spark):
    pool = spark.range(12).selectExpr("id AS pos", "concat('f', id) AS file", "concat(' text \n', id) AS text").repartition(7)
    got = rerank.prompts(pool, "why?").orderBy("batch").collect()
    assert [r.size for r in got] == [5, 5, 2] and "[0] (f5)\ntext 5" in got[1].prompt
    answers = models.completed(rerank.prompts(pool, "text 7").select("batch", "size", "prompt"), models.OverlapScorer("text 7"))
    scores = {r.pos: r.score for r in rerank.parsed(answers.withColumnRenamed("text", "reply")).collect()}
    assert scores[7] == 2.0 and scores[3] == 1.0 and len(scores) == 12


def test_closure_with_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "d")], "src string, dst string")
    got = integrity.reachable(edges, spark.createDataFrame([("a",), ("d",), ("z",)], "start string")).collect()
    assert sorted(map(tuple, got)) == [("a", "a"), ("a", "b"), ("a", "c"), ("d", "d"), ("z", "z")]


def test_a_scan_of_nothing_has_not_passed(spark):
    rows = spark.createDataFrame([("a", bytearray(b"x\r\xc2\xa0\xc2\xa0")), ("b", bytearray(b"\xff"))], "f string, c binary")
    got = {r.f: r for r in integrity.encoding_scan(rows, "f", "c").collect()}
    assert (got["a"].cr_at, got["a"].nbsp_at, got["a"].nbsp_count, got["a"].problems) == (1, 2, 2, 2) and not got["b"].valid
    assert integrity.scan_verdict(integrity.encoding_scan(rows.where("false"), "f", "c")).first().verdict == "nothing inspected"


def test_addresses():
    assert models.base_url("localhost:11434") == "http://localhost:11434" and models.base_url(" https://h/x/ ") == "https://h"
    for bad in ("", None, "file:///etc", "http://", "gopher://x"):
        with pytest.raises(Refused):
            models.base_url(bad)


def test_config():
    c = models.Config.from_env("P_", {"P_HOST": "h:1", "P_ALLOW_PULL": " Yes ", "P_ALLOW_DELETE": "0", "P_MODELS": "a, b,"})
    assert c.url == "http://h:1" and c.allow_pull and not c.allow_delete and c.allowlist == ("a", "b")


class _Handler(BaseHTTPRequestHandler):
    def do_POST(self):
        self.rfile.read(int(self.headers.get("Content-Length") or 0))
        kind = self.path.strip("/")
        if kind == "slow":
            self.server.gate.wait(2)
        body = {"ok": b'{"embeddings": [[1, 0]]}', "error": b'{"error": "no"}', "text": b"<html>", "empty": b"", "slow": b"{}", "404": b"x", "500": b"x"}[kind]
        self.send_response(int(kind) if kind.isdigit() else 200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_every_failure_of_a_call_is_a_verdict():
    server = HTTPServer(("127.0.0.1", 0), _Handler)
    server.gate = threading.Event()
    threading.Thread(target=server.serve_forever, daemon=True).start()
    config = models.Config(f"http://127.0.0.1:{server.server_port}")
    assert models.request(config, "POST", "/ok", {})["embeddings"] == [[1, 0]]
    for path, verdict in (("/error", "ollama_error"), ("/text", "bad_response"), ("/empty", "empty_response"), ("/404", "model_not_found"), ("/500", "ollama_error"), ("/slow", "timeout")):
        with pytest.raises(Refused) as e:
            models.request(config, "POST", path, {}, timeout=0.5)
        assert e.value.verdict == verdict and verdict in VERDICTS
    server.gate.set()
    server.shutdown()
    server.server_close()
    assert models.probe(config)["verdict"] == "ollama_unreachable"


def test_stream(spark, tmp_path):
    source, seen = tmp_path / "in", []
    schema = "file string, text string, seen bigint"
    put = lambda rows, n: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))

    def run():
        stream = spark.readStream.schema(schema).parquet(str(source))
        q = ingest.ingest(stream, str(tmp_path / "table"), str(tmp_path / "cp"), lambda changed, n: seen.append(sorted(r.file for r in changed.collect())))
        q.awaitTermination()

    put([("a", "1", 1), ("b", "1", 1), ("a", "2", 2)], 0)
    run()
    put([("a", "2", 3), ("b", "9", 3), ("c", "1", 3)], 1)
    run()
    got = {r.file: r.digest for r in ingest.current(spark, str(tmp_path / "table")).collect()}
    assert seen == [["a", "b"], ["b", "c"]] and set(got) == {"a", "b", "c"} and len(set(got.values())) == 3


class _Models(BaseHTTPRequestHandler):
    def _say(self, status, body):
        import json

        data = json.dumps(body).encode()
        self.send_response(status)
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *args):
        pass

    def do_GET(self):
        names = [f"m{i}" for i in range(10)]
        listed = [{"name": n, "size": 2_000_000 * i, "details": {"family": "f", "parameter_size": "7B", "quantization_level": "Q4"}, "modified_at": "now"} for i, n in enumerate(names)]
        self._say(200, {"models": listed if self.path == "/api/tags" else [{"name": "m3", "size_vram": 5, "expires_at": "later"}]})

    def do_POST(self):
        import json

        name = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["model"]
        self.server.asked.append(name)
        if name in ("m4", "m7"):
            return self._say(404 if name == "m4" else 500, {"error": "no"})
        self._say(200, {"model_info": {"x.context_length": 2048}, "parameters": "num_ctx 1024", "capabilities": ["completion"] if name != "m5" else None})


def test_a_model_server_is_a_source(spark):
    from http.server import ThreadingHTTPServer

    from spindrift.sources import server

    stub = ThreadingHTTPServer(("127.0.0.1", 0), _Models)
    stub.asked = []
    threading.Thread(target=stub.serve_forever, daemon=True).start()
    url = f"127.0.0.1:{stub.server_port}"
    found = server.models(spark, url, each=3)
    assert found.rdd.getNumPartitions() == 4
    rows = {r.name: r for r in found.collect()}
    assert sorted(rows) == [f"m{i}" for i in range(10)] and sorted(stub.asked) == sorted(rows)
    assert rows["m3"].running and rows["m3"].size_vram == 5 and not rows["m2"].running and rows["m2"].size == 4_000_000
    assert rows["m4"].error.startswith("model_not_found") and rows["m7"].error.startswith("ollama_error") and rows["m1"].error is None and rows["m4"].family == "f"
    assert rows["m5"].capabilities is None and rows["m1"].capabilities == ["completion"]
    limits = {r.name: (r.limit, r.disagree) for r in budget.limits(found).collect()}
    assert limits["m1"] == (1024, True) and limits["m4"] == (None, False)
    stub.asked.clear()
    listed = budget.inventory(found.select("name", "size"), found.select("name", "error")).collect()
    assert len(listed) == 10 and {r.name: r.details_error for r in listed}["m4"].startswith("model_not_found")
    stub.asked.clear()
    assert server.models(spark, url, details="false").count() == 10 and not stub.asked
    stub.shutdown()
    stub.server_close()
    gone = server.models(spark, url, timeout=2).collect()
    assert len(gone) == 1 and gone[0].name is None and gone[0].error.startswith("ollama_unreachable")
