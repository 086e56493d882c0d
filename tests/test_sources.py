import http.server
import json
import threading
import urllib.error

import pytest
from pyspark.sql import functions as F

from folioscan.operators.corpus import refresh_plan
from folioscan.session import scratch_path
from folioscan.sources import http as H
from folioscan.sources import literature as P
from folioscan.sources import readers as R
from folioscan.sources import sinks as K
from tests.conftest import rows


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_jsonl(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", '{"source_tag": "A", "target_tag": "B"}\n\n')
    assert rows(R.read_jsonl(spark, path, R.EDGES)) == [("A", "B", None)]
    assert R.read_jsonl(spark, str(tmp_path / "none"), R.EDGES).count() == 0
    broken = write(tmp_path / "b.jsonl", '{"source_tag": \n')
    with pytest.raises(Exception):
        R.read_jsonl(spark, broken, R.EDGES).collect()


def test_tags_file(spark, tmp_path):
    path = write(tmp_path / "tags", "# c\n\n0001,a,b\nx\n0001,z\n 0002 , y \n0003,\n")
    assert rows(R.read_tags(spark, path)) == [("0001", "z"), ("0002", "y")]


@pytest.mark.parametrize("doc", ['["A", "B", "A"]', '{"changed_tags": ["B", "A"], "tags": ["C"]}', '{"changed_tags": 1, "tags": ["A", "B"]}'])
def test_changed(spark, tmp_path, doc):
    assert rows(R.read_changed(spark, write(tmp_path / "c.json", doc))) == [("A",), ("B",)]


def test_changed_missing(spark, tmp_path):
    assert R.read_changed(spark, str(tmp_path / "no")).count() == 0


def test_config(tmp_path):
    path = write(tmp_path / "c.json", '{"fetch": {"workers": 3, "age": 1}, "x": 2}')
    config = R.load_config(path)
    assert R.options(config, "fetch", {"age": 5, "workers": None}) == {"workers": 3, "age": 5}
    assert R.section(config, "other") == config
    with pytest.raises(ValueError):
        R.load_config(write(tmp_path / "l.json", "[]"))
    assert R.load_list(None, [{"a": 1}]) == [{"a": 1}]
    assert R.load_list(write(tmp_path / "r.json", '﻿[{"a": 2}, 3]'), []) == [{"a": 2}]
    with pytest.raises(ValueError):
        R.load_list(write(tmp_path / "e.json", "[]"), [{"a": 1}])
    assert R.first_of([lambda: [], lambda: ["x"]]) == (["x"], True)


def test_payloads_and_refresh(spark, tmp_path):
    end = lambda ok: {"ok": ok, "url": "", "content": "c", "error": "", "duration_ms": 1}
    for tag, label, ok, at in (("A", "a", True, 1000), ("B", "old", True, 1000), ("C", "c", False, 1000), ("D", "d", True, 0), ("E", "e", True, 90_000)):
        write(tmp_path / f"p/{tag}.json", json.dumps({"tag": tag, "full_label": label, "fetched_at_utc": at, "structure": end(True), "statement": end(True), "full": end(ok), "content_hash": "h"}))
    write(tmp_path / "p/F.json", "[1]")
    write(tmp_path / "p/G.json", "{broken")
    cache = R.cache_state(R.read_payloads(spark, str(tmp_path / "p")))
    tags = spark.createDataFrame([(t, t.lower()) for t in "ABCDEFGH"], "tag string, full_label string")
    plan = lambda **o: dict(rows(refresh_plan(tags, cache, 100_000, **o).select("tag", "reason")))
    assert plan(max_age_hours=10) == {"A": "cache_expired", "B": "full_label_changed", "C": "previous_failure", "D": "missing_timestamp", "E": "cache_valid", "F": "invalid_cache", "G": "invalid_cache", "H": "missing_or_forced"}
    assert plan(max_age_hours=-1)["A"] == "cache_valid"
    assert set(plan(force=True).values()) == {"missing_or_forced"}


@pytest.fixture
def server():
    class Handler(http.server.BaseHTTPRequestHandler):
        seen: dict = {}

        def do_GET(self):
            n = self.seen[self.path] = self.seen.get(self.path, 0) + 1
            code = 404 if "missing" in self.path else 503 if "flaky" in self.path and n < 2 else 200
            self.send_response(code)
            self.end_headers()
            self.wfile.write(f"body of {self.path}".encode())

        def log_message(self, *_):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_http_source(spark, server):
    H.register(spark)
    urls = [f"{server}/a", f"{server}/flaky", f"{server}/missing"]
    got = {r.url.rsplit("/", 1)[1]: r for r in spark.read.format("folioscan_http").option("urls", "\n".join(urls)).option("wait", "0.01").load().collect()}
    assert got["a"].ok and got["a"].content == "body of /a"
    assert got["flaky"].ok
    assert not got["missing"].ok and got["missing"].code == "HTTP_404"


def test_payload_assembly(spark, server):
    tags = spark.createDataFrame([("A", "l")], "tag string, full_label string")
    asked = H.payload_urls(tags, server)
    made = H.assemble_payloads(asked, H.fetch_frame(asked, workers=2, wait=0.01), 7).first()
    assert made.statement.content == "body of /data/tag/A/content/statement"
    assert made.content_hash == H.payload_hash(made.statement.content, made.full.content)


def test_status_aware_retry():
    calls = []

    def opener(request, timeout):
        calls.append(1)
        raise urllib.error.HTTPError(request.full_url, 400, "bad", {}, None)

    assert H.fetch("http://x", opener=opener, status_aware=True)["code"] == "HTTP_400"
    assert len(calls) == 1


ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2101.00001v2</id><title> A &amp; B </title><summary>s  t</summary><published>2021-01-02</published>
<author><name>X Y</name></author><author><name>Z</name></author><link rel="alternate" href="http://arxiv.org/abs/2101.00001v2"/></entry></feed>"""
PAYLOADS = {
    "arxiv": ATOM,
    "openalex": json.dumps({"results": [{"id": "W1", "display_name": "T", "publication_year": 2020, "doi": "https://doi.org/10.1234/AB", "abstract_inverted_index": {"b": [1], "a": [0]}, "authorships": [{"author": {"display_name": "N"}}], "primary_location": None}]}),
    "semanticscholar": json.dumps({"data": [{"title": "S", "year": 2019, "abstract": None, "url": "", "authors": [{"name": "M"}], "externalIds": {"DOI": "10.1/Q", "ArXiv": "2001.00002"}}]}),
    "crossref": json.dumps({"message": {"items": [{"DOI": "10.5/C", "title": ["C"], "author": [{"given": "G", "family": "F"}, {"family": "H"}], "issued": {"date-parts": [[2018, 3]]}, "abstract": "<jats:p>x&amp;y</jats:p>"}]}}),
    "wikipedia": json.dumps({"query": {"search": [{"title": "A b/c", "snippet": "<b>s</b>"}]}}),
    "mathse": json.dumps({"items": [{"title": "Q", "link": "l", "tags": list("abcdefgh"), "score": 3, "answer_count": None, "is_answered": True, "creation_date": 1577836800}]}),
    "mathoverflow": "not json",
}


def test_literature_parsers(spark):
    df = spark.createDataFrame([(k, 1, v) for k, v in PAYLOADS.items()], "source_key string, qid int, payload string")
    got = {r.source_key: r for r in P.parse_payloads(df).collect()}
    a = got["arxiv"]
    assert (a.title, a.authors, a.year, a.summary, a.arxiv_id, a["rank"]) == ("A & B", "X Y, Z", "2021", "s t", "2101.00001v2", 1)
    assert (got["openalex"].doi, got["openalex"].url, got["openalex"].summary, got["openalex"].year) == ("10.1234/ab", "https://doi.org/10.1234/ab", "a b", "2020")
    assert (got["semanticscholar"].url, got["semanticscholar"].arxiv_id, got["semanticscholar"].summary) == ("https://doi.org/10.1/q", "2001.00002", "")
    assert (got["crossref"].authors, got["crossref"].year, got["crossref"].summary) == ("G F, H", "2018", "x y")
    assert got["wikipedia"].url == "https://en.wikipedia.org/wiki/A_b/c"
    assert got["mathse"].summary == "tags: a, b, c, d, e, f; score: 3; answers: None; accepted/answered: True"
    assert got["mathse"].year == "2020" and "mathoverflow" not in got
    with pytest.raises(ValueError):
        P.parse_payloads(df, ["nowhere"])
    assert spark.range(1).select(P.arxiv_query(F.lit("q"), ["m"])).first()[0] == "(all:q) AND (cat:m)"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "n int, t string")
    assert K.write_jsonl(df, str(tmp_path / "out"), "n") == 2
    root = scratch_path(spark, "versions")
    assert K.write_version(df, root) == 1
    assert K.write_version(K.read_version(spark, root).filter("n = 1"), root, {"note": "x"}) == 2
    assert rows(K.read_version(spark, root)) == [(1, "a")]
    assert K.read_json(spark, f"{root}/CURRENT")["note"] == "x"
    board = spark.createDataFrame([(0, 0, 0.5, "c")], "cand_idx int, route_idx int, objective double, candidate string")
    assert "| 1 | 0.5000 | c |" in K.leaderboard_markdown(board)
    fetched = spark.createDataFrame([(True,), (False,)], "ok boolean")
    plan = spark.createDataFrame([("cache_valid",), ("cache_expired",)], "reason string")
    assert K.fetch_summary(plan, fetched, 5) == {"skip_reasons": {"cache_valid": 1}, "refresh_reasons": {"cache_expired": 1}, "fetched": 1, "failed": 1, "generated_at_utc": 5, "exit_code": 1}
