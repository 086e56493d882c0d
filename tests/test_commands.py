"""Commands end to end over local folders and a local server, and the error model."""

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from folioscan.plans import commands
from folioscan.session import Scratch, cut
from folioscan.sources import literature
from tests.conftest import rows

ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2401.00001v1</id><title>Flat schemes</title><summary>On flatness.</summary><published>2024-01-02</published><author><name>A. B</name></author></entry></feed>'
OPENALEX = {"results": [{"id": "x", "display_name": "Proper sheaf maps", "publication_year": 2020, "doi": "https://doi.org/10.1000/abc"}]}


@pytest.fixture(scope="module")
def services():
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append(self.path)
            name = self.path[1:].split("?")[0]
            answer = {"arxiv": ATOM, "openalex": json.dumps(OPENALEX), "crossref": "no json", "wikipedia": json.dumps({"query": {"search": []}})}.get(name)
            if name == "semanticscholar" and sum(p.startswith("/semanticscholar") for p in seen) > 1:
                answer = json.dumps({"data": [{"title": "Flat schemes", "externalIds": {"ArXiv": "2401.00001v1"}}]})
            busy = name == "semanticscholar" and answer is None
            self.send_response(200 if answer else 503 if busy else 403)
            self.end_headers()
            self.wfile.write((answer or "").encode())

        def log_message(self, *_):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield {name: f"http://127.0.0.1:{s.server_port}/{name}" for name in literature.ENDPOINTS}, seen
    s.shutdown()


def test_gather(spark, services):
    """Busy services are asked again, refusals not; a failing source is a row, the others go on."""
    bases, seen = services
    asked = spark.createDataFrame([("1", "flat sheaf & more")], "qid string, query string")
    got = literature.gather(asked, bases=bases, wait=0.01, workers=2)
    assert {(r.source_key, r.title) for r in got.items.collect()} == {("arxiv", "Flat schemes"), ("openalex", "Proper sheaf maps"), ("semanticscholar", "Flat schemes")}
    assert {(r.source_key, r.code) for r in got.failures.collect()} == {("crossref", "PARSE_ERROR"), ("mathoverflow", "HTTP_403"), ("mathse", "HTTP_403")}
    state = {r.source_key: (r.status, r["count"], r.degrade_reason) for r in got.diagnostics.collect()}
    assert state["wikipedia"] == ("ok", 0, "no_matches") and state["crossref"] == ("error", 0, "parse_error")
    assert sum(p.startswith("/semanticscholar") for p in seen) == 2 and sum(p.startswith("/mathse") for p in seen) == 1
    assert any("search=flat+sheaf+%26+more&per-page=8" in p for p in seen)
    assert any(p.startswith("/arxiv?search_query=%28all%3Aflat+sheaf+%26+more%29+AND+%28cat%3Amath.AG") for p in seen)
    with pytest.raises(ValueError, match="unknown sources"):
        literature.request_urls(asked, ["nowhere"])


def test_web_hint_in_requests(spark):
    asked = spark.createDataFrame([("1", "rings")], "qid string, query string")
    one = lambda **k: literature.request_urls(asked, ["openalex"], **k).first().url
    assert "search=rings+algebraic+geometry&" in one() and "search=rings&" in one(hint=False)


def test_papers_command(spark, services):
    found = commands.papers(spark, "flat schemes", now_year=2025, bases=services[0], wait=0.01)
    assert found["papers"][0]["title"] == "Flat schemes" and found["papers"][0]["source"] == "arXiv + Semantic Scholar"
    assert {(w["code"], w["degrade_reason"]) for w in found["warnings"]} >= {("PARSE_ERROR", "parse_error"), ("HTTP_403", "error"), ("NO_MATCHES", "no_matches")}
    lost = commands.papers(spark, "flat", ["mathse"], bases=services[0], wait=0.01)
    assert lost["error"]["code"] == "PAPERS_RETRIEVAL_ERROR"


def test_build_search_ask(spark, services, tmp_path):
    """From tags and HTTP payloads to an answer; commands print JSON, write it, and give exit codes."""
    (tmp_path / "tags").write_text("AAA1,flat-maps-lemma-one\nAAA2,flat-maps-theorem-two\nAAA3,stacks-definition-three\n")
    (tmp_path / "Makefile").write_text("LIJST = flat-maps stacks\n\n")
    words = F.when(F.col("url").contains("AAA1"), "flat schemes and sheaf").when(F.col("url").contains("AAA2"), "proper morphism").otherwise("stacks")
    body = F.when(F.col("url").endswith("structure"), F.lit("{}")).otherwise(F.concat(F.lit("<p>"), words, F.lit('</p><a href="/tag/AAA3">x</a>')))
    fetcher = lambda urls: urls.select("url", F.lit(True).alias("ok"), body.alias("content"), F.lit("").alias("error"), F.lit("").alias("code"), F.lit(1).alias("duration_ms"))
    out, folder = str(tmp_path / "out"), str(tmp_path / "raw")
    made = commands.build(spark, str(tmp_path / "tags"), folder, out, str(tmp_path / "none"), str(tmp_path / "Makefile"), base="http://x", now=50, dim=32, fetcher=fetcher)
    assert made["sizes"]["corpus"] == 3 and made["chapters"] == 2 and made["chapters_fallback"] and made["fetch"]["fetched"] == 3
    again = commands.build(spark, str(tmp_path / "tags"), folder, out, str(tmp_path / "Makefile"), base="http://x", now=51, dim=32, incremental=True, fetcher=fetcher)
    assert again["fetch"]["fetched"] == 0 and again["sizes"] == made["sizes"] and not again["chapters_fallback"]

    shown = []
    assert commands.main(["search", "--out", out, "--query", "flat schemes", "--top-k", "2"], spark, shown.append) == 0
    assert shown[0].startswith("1. tag=AAA1 hybrid=") and "text : flat schemes and sheaf" in shown[0]
    (tmp_path / "c.json").write_text(json.dumps({"search": {"top_k": 1, "lexical_mode": "or"}}))
    args = ["search", "--out", out, "--query", "flat schemes", "--config", str(tmp_path / "c.json"), "--json", "--output", str(tmp_path / "o" / "r.json")]
    assert commands.main(args, spark, shown.append) == 0
    assert json.loads((tmp_path / "o" / "r.json").read_text()) == json.loads(shown[1]) and json.loads(shown[1])["count"] == 1
    assert commands.main(["search", "--out", str(tmp_path / "nowhere"), "--query", "q"], spark, shown.append) == 1
    assert json.loads(shown[2])["error"]["code"] == "SEARCH_ERROR"

    (tmp_path / "eval.jsonl").write_text(json.dumps({"query": "flat schemes", "relevant_tags": ["AAA1"], "category": "proof"}) + "\n")
    (tmp_path / "base.json").write_text(json.dumps({"mrr@10": 2.0}))
    judged = commands.evaluate(spark, out, str(tmp_path / "eval.jsonl"), str(tmp_path / "base.json"))
    assert judged["exit_code"] == 3 and judged["regressions"][0]["metric"] == "mrr@10"

    whole = commands.ask(spark, out, "flat schemes sheaf", "b", now_year=2025, bases=services[0], wait=0.01)
    assert whole["route"] == "ag_retrieval" and whole["stacks"][0]["tag"] == "AAA1" and whole["papers"][0]["title"] == "Flat schemes"
    assert whole["references"][0].startswith("[S1]") and {w["code"] for w in whole["warnings"]} == {"PARSE_ERROR", "HTTP_403"}
    alone = commands.ask(spark, str(tmp_path / "nowhere"), "flat schemes sheaf", now_year=2025, bases=services[0], wait=0.01)
    assert alone["route"] == "papers_only_degraded" and "STACKS_RETRIEVAL_ERROR" in {w["code"] for w in alone["warnings"]}
    assert commands.ask(spark, out, "weather")["route"] == "low_relevance_stop"


def test_error_model(spark):
    def broken():
        raise TimeoutError("request timed out")

    failed = commands.run_stage("papers", broken)
    assert failed == {"error": {"code": "PAPERS_RETRIEVAL_ERROR", "message": "request timed out", "source": "papers"}}
    assert commands.run_stage("x", lambda: [])["error"]["code"] == "PIPELINE_NON_OBJECT_PAYLOAD"
    assert commands.run_stage("x", lambda: json.loads("{"))["error"]["code"] == "PIPELINE_JSON_DECODE_ERROR"
    assert commands.run_stage("x", lambda: {"error": {"code": "C", "source": "y"}}) == {"error": {"code": "C", "source": "y"}}
    assert commands.run_stage("x", lambda: {"count": 1}) == {"count": 1}
    warn = lambda e: commands.normalized_warning(spark, e, "papers")
    assert warn("odd") == {"source": "papers", "code": "PIPELINE_UNKNOWN_ERROR", "message": "odd"}
    assert warn({"code": "HTTP_503", "source": "some_script.PY"}) == {"degrade_reason": "timeout", "code": "HTTP_503", "message": "Execution failed.", "source": "papers"}
    assert warn({"degrade_reason": "own", "source": "arxiv"})["degrade_reason"] == "own"
    fell = lambda p, e=None: commands.degradation(spark, "stacks", p, e)
    assert fell({}, {"code": "TLS_ERROR", "message": "m"})["degrade_reason"] == "tls_restricted"
    assert fell({"count": 0})["code"] == "NO_MATCHES" and fell({})["code"] == "NO_MATCHES"
    assert fell({"count": 2}) is None and fell({"all_references": ["a"]}) is None
    assert commands.error_payload("C", "m", "d") == {"error": {"code": "C", "message": "m", "details": "d"}}


def test_paths():
    assert commands.resolve("/a", "b/../c") == "/a/c" and commands.resolve("/a", "/x") == "/x" and commands.resolve("/a", "s3://b") == "s3://b"


def test_scratch_goes_with_its_block(spark):
    with Scratch(spark):
        df = cut(spark.range(3))
        assert rows(df) == [(0,), (1,), (2,)]
        path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    import os

    assert not os.path.exists(path)
