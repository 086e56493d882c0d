import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from folioscan.operators.lexical import LexicalIndex
from folioscan.plans import assistant, pipeline, tuning
from folioscan.functions.scoring import Routes
from folioscan.plans.hybrid import HybridParameters, SearchIndex, hybrid_search, search_stages
from folioscan.operators import graph as G
from folioscan.session import scratch_path
from folioscan.sources.sinks import read_json, read_version
from folioscan.streaming.upserts import read_table_stream, read_upserted, sessions, upsert_batches, windowed_counts
from tests.conftest import rows

TAGS = [("AAA1", "flat-maps-lemma-one"), ("AAA2", "flat-maps-theorem-two"), ("AAA3", "stacks-definition-three"), ("AAA4", "stacks-remark-gone")]


def end(content, ok=True):
    return {"ok": ok, "url": "u", "content": content, "error": "", "duration_ms": 1}


def payload(tag, label, statement, proof="", refs=()):
    links = "".join(f'<a href="/tag/{r}">x</a>' for r in refs)
    html = f'<article class="env-lemma"><p><span data-tag="{tag}">Lemma 1.{tag[-1]}</span> {statement}</p></article>'
    return {"tag": tag, "full_label": label, "fetched_at_utc": 10, "structure": end(json.dumps({"name": f"On {statement.split()[0]}", "type": "lemma"})), "statement": end(html), "full": end(html + f"<p>{proof}</p>{links}"), "content_hash": "h"}


@pytest.fixture
def folder(tmp_path):
    def put(*docs):
        for d in docs:
            (tmp_path / f"{d['tag']}.json").write_text(json.dumps(d))
        return str(tmp_path)

    return put


def test_build_full_and_incremental(spark, folder):
    tags = spark.createDataFrame(TAGS, "tag string, full_label string")
    keys, out = ["flat", "flat-maps", "stacks"], scratch_path(spark, "build")
    where = folder(payload("AAA1", TAGS[0][1], "flat maps are $x \\to y$", "clear", ["AAA2", "AAA9"]), payload("AAA2", TAGS[1][1], "proper maps"), payload("AAA3", TAGS[2][1], "stacks of sheaves", refs=["AAA1"]))
    sizes = pipeline.build(spark, tags, keys, where, out, dim=64)
    assert sizes == {"corpus": 3, "edges": 3, "vectors": 3, "lexical": 3}
    row = read_version(spark, f"{out}/corpus").filter("id = 'AAA1'").first()
    assert (row.chapter_key, row.env_type, row.reference, row.title, row.structure_type) == ("flat-maps", "lemma", "Lemma 1.1", "On flat", "lemma")
    assert row.outgoing_refs == ["AAA2", "AAA9"] and row.source_tex == "flat-maps.tex"
    assert row.normalized_text.startswith("Lemma 1.1 flat maps are x to y") and "clear" in row.proof_text
    before = {r.id: r.embedding for r in read_version(spark, f"{out}/vectors").collect()}

    # one changed, one gone, one new
    where = folder(payload("AAA2", TAGS[1][1], "smooth maps"), payload("AAA4", TAGS[3][1], "remarks"))
    fewer = tags.filter("tag <> 'AAA3'")
    changed = spark.createDataFrame([("AAA2",), ("AAA3",), ("AAA4",)], "tag string")
    sizes = pipeline.build(spark, fewer, keys, where, out, changed, dim=64)
    assert sizes["corpus"] == sizes["vectors"] == sizes["lexical"] == 3
    full = scratch_path(spark, "build")
    pipeline.build(spark, fewer, keys, where, full, dim=64)
    for name in ("corpus", "edges", "vectors"):
        a, b = read_version(spark, f"{out}/{name}"), read_version(spark, f"{full}/{name}")
        assert rows(a.select(*sorted(a.columns))) == rows(b.select(*sorted(b.columns))), name
    at = read_json(spark, f"{out}/lexical/CURRENT")["version"]
    assert rows(LexicalIndex.read(spark, f"{out}/lexical/v{at}").postings) == rows(LexicalIndex.read(spark, f"{full}/lexical/v1").postings)
    after = {r.id: r.embedding for r in read_version(spark, f"{out}/vectors").collect()}
    assert after["AAA1"] == before["AAA1"] and after["AAA2"] != before["AAA2"]
    # no changes: nothing differs
    assert pipeline.build(spark, fewer, keys, where, out, changed.limit(0), dim=64)["corpus"] == 3


def test_fetch_stage(spark):
    tags = spark.createDataFrame([("A", "a"), ("B", "b")], "tag string, full_label string")
    ok = spark.createDataFrame([("A", "a", True, True, 100)], "tag string, full_label string, s boolean, f boolean, fetched_at_utc bigint")
    cache = ok.select("tag", "full_label", F.struct(F.col("s").alias("ok")).alias("statement"), F.struct(F.col("f").alias("ok")).alias("full"), "fetched_at_utc", F.lit(True).alias("is_object"))
    fetcher = lambda urls: urls.select("url", F.lit(True).alias("ok"), F.concat(F.lit("c "), "url").alias("content"), F.lit("").alias("error"), F.lit("").alias("code"), F.lit(1).alias("duration_ms"))
    got, plan = pipeline.fetch_stage(tags, cache, "http://x", 200, 1.0, fetcher=fetcher)
    assert rows(plan.select("tag", "reason")) == [("A", "cache_valid"), ("B", "missing_or_forced")]
    assert rows(pipeline.changed_tags(got)) == [("B",)]


@pytest.fixture(scope="module")
def search(spark):
    docs = [(f"T{n:03d}", f"T{n:03d}", "flat-maps", ["lemma", "theorem", "definition"][n % 3], f"{n}.1", f"title {w}", f"chapter-{w}", f"{w} maps of {w} schemes", "proof" if n % 2 else "") for n, w in enumerate(["flat", "proper", "smooth", "etale", "ample", "finite"])]
    corpus = spark.createDataFrame(docs, "id string, tag string, chapter_key string, env_type string, reference string, title string, full_label string, statement_text string, proof_text string").withColumns({"normalized_text": F.col("statement_text"), "content_hash": F.lit("")})
    index = pipeline.build_index(pipeline.lexical_input(corpus))
    vectors = tuning.embed(corpus, "id", F.col("statement_text"), "hash", dim=64)
    edges = spark.createDataFrame([("T000", "T001"), ("T002", "T001")], "src string, dst string")
    return SearchIndex(corpus, index, vectors, G.GraphIndex.build(corpus, edges))


def test_evaluation_gate_and_sweep(spark, search):
    evals = spark.createDataFrame([("e1", "flat lemma", ["T000"], "definition"), ("e2", "prove proper maps", ["T001"], "proof"), ("e3", "T004", ["T004"], "")], "id string, query string, relevant_tags array<string>, category string")
    p = HybridParameters(lexical_mode="or")
    per_query, aggregate = tuning.evaluate(evals, search, p, dim=64)
    assert {r.category for r in aggregate.collect()} == {"(all)", "definition", "proof", "uncategorized"}
    assert next(r for r in per_query.collect() if r.qid == "e3")["mrr@1"] == 1.0
    assert tuning.gate(aggregate, {"mrr@10": 0.0, "recall@10": 0.0})[0] == 0
    assert tuning.gate(aggregate, {"mrr@10": 2.0})[0] == 3
    routes = [{"name": "plain"}, {"name": "loud", "proof_route_bonus": 2.0, "nonproof_proof_penalty": 0.5}]
    board, failed = tuning.sweep(evals, search, [{"name": "h", "provider": "hash", "dim": 32, "text_fields": "statement_text, title"}, {"name": "bad", "provider": "none", "text_fields": "title"}], routes, p)
    assert board.count() == 2 and failed[0]["candidate"] == "bad"
    with pytest.raises(Exception, match="unknown_column"):  # a fault of the plan is no failed candidate
        tuning.sweep(evals, search, [{"name": "h", "provider": "hash", "text_fields": "unknown_column"}], routes, p)


def test_routes_in_one_plan_are_as_one_by_one(spark, search):
    asked = spark.createDataFrame([(1, "prove proper maps"), (2, "flat lemma 3.1")], "qid int, query string")
    ready = tuning.with_embeddings(asked, dim=64)
    kinds = [Routes(), Routes(proof_bonus=2.0, nonproof_penalty=0.5)]
    p = HybridParameters(lexical_mode="or")
    got = search_stages(ready, search, p, kinds).final.selectExpr("qid.route", "qid.qid", "id", "score", "rank")
    alone = [(n, *r) for n, k in enumerate(kinds) for r in hybrid_search(ready, search, replace(p, routes=k)).select("qid", "id", "score", "rank").collect()]
    assert rows(got) == sorted(alone, key=repr)


def test_assistant(spark, search):
    corpus = search.corpus
    asked = spark.createDataFrame([("1", "flat morphism of schemes"), ("2", "weather"), ("3", "proper sheaf cohomology")], "qid string, query string")
    found = hybrid_search(tuning.with_embeddings(asked, dim=64), search, HybridParameters(lexical_mode="or"))
    local = assistant.local_evidence(found.filter("qid <> '3'"), corpus, 2, "b")
    items = spark.createDataFrame([("1", "arxiv", 1, "Flat schemes", "A", "2024", "s", "u", "", "2401.00001"), ("1", "openalex", 1, "flat schemes", "", "", "longer", "", "", "2401.00001")], "qid string, source_key string, rank int, title string, authors string, year string, summary string, url string, doi string, arxiv_id string")
    literature = assistant.papers(items, asked, 2025)
    assert [(r.citation_id, r.source, r.summary) for r in literature.collect()] == [("P1", "arXiv + OpenAlex", "longer")]
    fails = spark.createDataFrame([("3", "papers", "HTTP_503", "x"), ("3", "papers", "HTTP_503", "x")], "qid string, source string, code string, message string")
    got = {r.qid: r for r in assistant.envelope(asked, local, literature, fails).collect()}
    assert (got["1"].route, got["1"].n_local, got["1"].n_papers) == ("ag_retrieval", 2, 1)
    assert [x[:4] for x in got["1"].references] == ["[S1]", "[S2]", "[P1]"]
    assert got["1"].source_confidence == pytest.approx(0.45 + 0.05 + 0.25 + 0.03 + 0.05 + 0.06)
    assert got["2"].route == "low_relevance_stop" and got["2"].source_confidence == 0.0 and got["2"].references == []
    assert got["3"].route == "retrieval_unavailable"
    assert {(w.source, w.degrade_reason) for w in got["3"].warnings} == {("papers", "timeout"), ("stacks", "no_matches")}


def test_stream_upserts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("folioscan.streaming.upserts.MERGE_PARTS", 2)
    schema = "k string, n int, v string"
    src, table, check = str(tmp_path / "in"), scratch_path(spark, "stream"), str(tmp_path / "check")
    batches = [[("a", 1, "x"), ("b", 1, "y"), ("a", 2, "z")], [("a", 1, "late"), ("c", 3, "w"), (None, 1, "n")], [("d", 1, "u")], [("b", 2, "t")]]
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(src)
        upsert_batches(read_table_stream(spark, src, schema), "k", "n", table, check).awaitTermination()
    assert rows(read_upserted(spark, table, "k", "n").select("k", "n", "v")) == [("a", 2, "z"), ("b", 2, "t"), ("c", 3, "w"), ("d", 1, "u")]
    state = read_json(spark, f"{table}/CURRENT")
    assert state["batch"] == 3 and state["parts"] == ["merged-3", "batch-3"]
    assert spark.read.parquet(f"{table}/batch-3").count() == 1  # a batch writes its own rows only


def test_stream_windows(spark, tiny):
    schema = spark.read.parquet(f"{tiny}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{tiny}/events.parque*")
    q = windowed_counts(stream).writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = windowed_counts(spark.read.parquet(f"{tiny}/events.parquet"))
    assert rows(spark.table("hourly").select("start", "event_type", "n")) == rows(batch.select("start", "event_type", "n"))
    one = sessions(spark.read.parquet(f"{tiny}/events.parquet"))
    assert one.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{tiny}/events.parquet").count()


def test_scan_plans(spark, small):
    """Filters and columns reach the scan."""
    df = G.reference_edges(spark.read.parquet(f"{small}/corpus.parquet").filter("tag = 'A'"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(tag,A)" in plan and "full_html" not in plan
