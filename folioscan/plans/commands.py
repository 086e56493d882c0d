"""The engine's commands: build, search, evaluate, papers, classify, ask; each gives one JSON document.

``python -m folioscan COMMAND --help``. A command that fails gives an error
envelope and exit code 1; stages of ``ask`` that fail become warnings.
"""

from __future__ import annotations

import argparse
import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions import scoring as S
from folioscan.functions.text import snippet
from folioscan.operators import graph as G
from folioscan.operators.lexical import LexicalIndex
from folioscan.plans import assistant, pipeline, tuning
from folioscan.plans.hybrid import HybridParameters, SearchIndex, hybrid_search
from folioscan.session import local_session
from folioscan.sources import http, literature, readers
from folioscan.sources.sinks import fetch_summary, read_json, read_version

# --- errors


def error_payload(code: str, message: str, details: str | None = None) -> dict:
    """The error envelope."""
    return {"error": {"code": code, "message": message} | ({"details": details} if details else {})}


# The codes under which failures of the stages are known.
STAGE_CODES = {
    "relevance": "RELEVANCE_CLASSIFY_ERROR",
    "stacks": "STACKS_RETRIEVAL_ERROR",
    "papers": "PAPERS_RETRIEVAL_ERROR",
    "citations": "CITATION_FORMAT_ERROR",
}


def run_stage(name: str, stage: Callable[[], dict]) -> dict:
    """The stage's payload, or an error envelope that names the stage; a payload that is no object is an error too."""
    try:
        payload = stage()
    except json.JSONDecodeError as e:
        failed = error_payload("PIPELINE_JSON_DECODE_ERROR", f"{name} produced invalid JSON.", str(e))
    except Exception as e:  # noqa: BLE001 - a stage must not end the others
        code = http.error_code(e)
        failed = error_payload(STAGE_CODES.get(name, "PIPELINE_STAGE_ERROR") if code == "REQUEST_ERROR" else code, str(e)[:2000] or f"{name} failed")
    else:
        if not isinstance(payload, dict):
            failed = error_payload("PIPELINE_NON_OBJECT_PAYLOAD", f"{name} returned non-object payload.")
        elif isinstance(payload.get("error"), dict):
            failed = {"error": dict(payload["error"])}
        else:
            return payload
    failed["error"].setdefault("source", name)
    return failed


def degrade_reason(spark: SparkSession, code: str, message: str) -> str:
    row = spark.createDataFrame([(code, message)], "code string, message string")
    return row.select(S.degrade_reason(F.col("code"), F.col("message"))).first()[0]


def normalized_warning(spark: SparkSession, error: object, stage: str) -> dict:
    """A warning with source, code, message and reason; an empty source or a file's name gives way to the stage's."""
    if not isinstance(error, dict):
        return {"source": stage, "code": "PIPELINE_UNKNOWN_ERROR", "message": str(error)}
    source = str(error.get("source") or "")
    whole = {"code": "PIPELINE_UNKNOWN_ERROR", "message": "Execution failed."} | error
    whole["source"] = stage if not source or source.lower().endswith(".py") else source
    return {"degrade_reason": degrade_reason(spark, str(whole["code"]), str(whole["message"]))} | whole


def degradation(spark: SparkSession, source: str, payload: dict, error: dict | None) -> dict | None:
    """How a side of an answer fell short: its error, or that it found nothing; None if neither."""
    if error is not None:
        code, message = error.get("code", "PIPELINE_UNKNOWN_ERROR"), str(error.get("message", "Execution failed."))
        return {"source": source, "code": code, "message": message, "degrade_reason": degrade_reason(spark, code, message)}
    count = payload.get("count")
    if count is None:
        listed = payload.get("all_references")
        count = len(listed) if isinstance(listed, list) else 0
    if payload and int(count):
        return None
    none_found = f"{source} retrieval returned no results."
    return {"source": source, "code": "NO_MATCHES", "message": none_found, "degrade_reason": "no_matches"}


# --- what the commands share


def resolve(root: str, path: str) -> str:
    """A path as it stands if it is absolute or a URL, else under ``root``."""
    return path if "://" in path or os.path.isabs(path) else os.path.normpath(os.path.join(root, path))


def documents(df: DataFrame, most: int) -> list[dict]:
    """The first ``most`` rows as objects, through the engine's own JSON."""
    return [json.loads(r[0]) for r in df.limit(most).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]


def emit(payload: dict, output: str | None = None, show: Callable[[str], None] = print) -> int:
    """Print the document, write it to ``output`` where that is given, and return the exit code."""
    text = json.dumps(payload, ensure_ascii=False, indent=2, default=str)
    show(text)
    if output:
        os.makedirs(os.path.dirname(os.path.abspath(output)), exist_ok=True)
        with open(output, "w", encoding="utf-8") as f:
            f.write(text + "\n")
    return 1 if "error" in payload else int(payload.get("exit_code", 0))


def opened(spark: SparkSession, out: str) -> tuple[SearchIndex, dict]:
    """The index that :func:`build` made under ``out``, and the options its vectors were made with."""
    corpus = read_version(spark, f"{out}/corpus")
    lexical = LexicalIndex.read(spark, f"{out}/lexical/v{read_json(spark, f'{out}/lexical/CURRENT')['version']}")
    vectors = read_version(spark, f"{out}/vectors").select("id", "embedding")
    graph = G.GraphIndex.read(spark, f"{out}/graph/v{read_json(spark, f'{out}/graph/CURRENT')['version']}")
    return SearchIndex(corpus, lexical, vectors, graph), read_json(spark, f"{out}/vectors/CURRENT", {})


def chapter_source(spark: SparkSession, local: str | None, cache: str | None, url: str | None) -> tuple[list[str], bool]:
    """Chapter keys from a local makefile, else a cached one, else an address; and whether the first was not it."""

    def remote() -> list[str]:
        got = http.fetch(url) if url else {"ok": False, "content": ""}
        keys = readers.chapter_keys(got["content"]) if got["ok"] else []
        if keys and cache:
            with open(cache, "w", encoding="utf-8") as f:
                f.write(got["content"])
        return keys

    places = [lambda p=p: readers.read_chapters(spark, p) if p else [] for p in (local, cache)]
    return readers.first_of([*places, remote])


# --- commands


def build(spark: SparkSession, tags: str, payloads: str, out: str, chapters: str | None = None, chapters_cache: str | None = None, chapters_url: str | None = None, base: str | None = None, now: int | None = None, limit: int = 0, incremental: bool = False, max_age_hours: float = 168.0, force: bool = False, workers: int = 8, provider: str = "hash", model: str = "hash-embedding-v1", dim: int = 1536, fetcher=None) -> dict:
    """Fetch what is stale (with ``base``), then metadata, corpus, vectors, lexical index and graph; a stage that fails stops the later ones."""
    now = int(time.time()) if now is None else now
    listed = readers.read_tags(spark, tags)
    listed = readers.head(listed, "tag", limit)
    keys, fallback = chapter_source(spark, chapters, chapters_cache, chapters_url)
    summary, changed = {}, None
    if base:
        cached = readers.read_payloads(spark, payloads)
        fetched, plan = pipeline.fetch_stage(listed, cached, base, now, max_age_hours, force, workers, fetcher)
        summary = fetch_summary(plan, fetched.select((F.col("statement.ok") & F.col("full.ok")).alias("ok")), now)
        if summary["exit_code"] == 2:
            return {"fetch": summary, "exit_code": 2}
        pipeline.store_payloads(fetched, payloads)
        changed = pipeline.changed_tags(fetched)
    sizes = pipeline.build(spark, listed, keys, payloads, out, changed if incremental else None, provider, model, dim)
    return {"fetch": summary, "chapters": len(keys), "chapters_fallback": fallback, "sizes": sizes, "exit_code": summary.get("exit_code", 0)}


def _asked(spark: SparkSession, query: str) -> DataFrame:
    return spark.createDataFrame([("q", query)], "qid string, query string")


def _ranking(spark: SparkSession, out: str, query: str, p: HybridParameters) -> tuple[DataFrame, SearchIndex]:
    index, meta = opened(spark, out)
    options = {k: meta[k] for k in ("provider", "model", "dim") if k in meta}
    return hybrid_search(tuning.with_embeddings(_asked(spark, query), **options), index, p), index


def search(spark: SparkSession, out: str, query: str, top_k: int = 8, **parameters) -> dict:
    """The best documents, with a snippet of 240 signs."""
    ranking, index = _ranking(spark, out, query, HybridParameters(**parameters))
    rows = ranking.filter(F.col("rank") <= top_k).join(index.corpus, "id").orderBy("rank")
    shown = rows.select("rank", F.col("id").alias("tag"), F.round("score", 4).alias("hybrid"), F.round("vs", 4).alias("vec"), F.round("bs", 4).alias("bm25"), F.col("env_type").alias("env"), F.col("chapter_key").alias("chapter"), F.col("reference").alias("ref"), "title", snippet(F.col("statement_text"), 240).alias("text"))
    found = documents(shown, top_k)
    return {"query": query, "count": len(found), "results": found}


def listing(payload: dict) -> str:
    """The hits of :func:`search` for people."""
    out = []
    for r in payload["results"]:
        scores = f"hybrid={r['hybrid']:.4f} vec={r['vec']:.4f} bm25={r['bm25']:.4f}"
        out.append(f"{r['rank']}. tag={r['tag']} {scores} env={r['env']} chapter={r['chapter']} ref={r['ref']}")
        out += [f"   {name}: {r[field]}" for name, field in (("title", "title"), ("text ", "text")) if r[field]]
        out.append("")
    return "\n".join(out) if out else "No result after filtering."


def evaluate(spark: SparkSession, out: str, questions: str, baseline: str | None = None, tolerance: float = 0.0, **parameters) -> dict:
    """Recall and MRR over a file of questions; with a baseline, exit code 3 where a watched metric fell."""
    index, meta = opened(spark, out)
    options = {k: meta[k] for k in ("provider", "model", "dim") if k in meta}
    per_query, aggregate = tuning.evaluate(readers.read_eval(spark, questions), index, HybridParameters(**parameters), **options)
    made = {"metrics": documents(aggregate.orderBy("category"), 10_000), "exit_code": 0}
    if baseline:
        code, fallen = tuning.gate(aggregate, read_json(spark, baseline, {}), tolerance)
        made |= {"exit_code": code, "regressions": [r.asDict() for r in fallen]}
    return made


def classify(spark: SparkSession, query: str) -> dict:
    row = _asked(spark, query).select(S.relevance(F.col("query")).alias("r")).select("r.*").first()
    return {"query": query} | row.asDict()


def papers(spark: SparkSession, query: str, sources: list[str] | None = None, top_k: int = 6, now_year: int | None = None, **options) -> dict:
    """Literature of all sources, merged and scored, with what each source gave; failures and empty sources are warnings."""
    asked = _asked(spark, query)
    got = literature.gather(asked, sources, **options)
    year = time.gmtime().tm_year if now_year is None else now_year
    found = documents(assistant.papers(got.items, asked, year, top_k).orderBy("citation_id"), top_k)
    diagnostics = documents(got.diagnostics.orderBy("source_key"), 100)
    lost = [{"source": r.source_key, "code": r.code, "message": r.message} for r in got.failures.limit(100).collect()]
    failed = {w["source"] for w in lost}
    empty = [{"source": d["source_key"], "code": "NO_MATCHES", "message": "no matches"} for d in diagnostics if not d["count"] and d["source_key"] not in failed]
    if failed and not found and len(failed) == len(diagnostics):
        return error_payload("PAPERS_RETRIEVAL_ERROR", "no source answered", json.dumps(lost)) | {"source_diagnostics": diagnostics}
    return {"query": query, "count": len(found), "papers": found, "source_diagnostics": diagnostics, "warnings": [normalized_warning(spark, w, "papers") for w in lost + empty]}


def ask(spark: SparkSession, out: str, query: str, base_url: str = "", k: int = 8, top_k: int = 6, now_year: int | None = None, sources: list[str] | None = None, **options) -> dict:
    """An answer's evidence from documents and literature. A side that fails is a warning; a query off the subject stops early."""
    relevance = run_stage("relevance", lambda: classify(spark, query))
    if "error" in relevance:
        return {"query": query, "route": "pipeline_failed", "warnings": [normalized_warning(spark, relevance["error"], "relevance")]}
    if relevance["label"] == "low":
        return {"query": query, "route": "low_relevance_stop", "relevance": relevance, "references": [], "warnings": []}
    asked = _asked(spark, query)
    sides: dict[str, DataFrame] = {}

    def local() -> dict:
        ranking, index = _ranking(spark, out, query, HybridParameters())
        sides["stacks"] = spark.createDataFrame(assistant.local_evidence(ranking, index.corpus, k, base_url).collect(), LOCAL)
        return {"count": sides["stacks"].count()}

    def outside() -> dict:
        got = literature.gather(asked, sources, **options)
        year = time.gmtime().tm_year if now_year is None else now_year
        sides["papers"] = spark.createDataFrame(assistant.papers(got.items, asked, year, top_k).collect(), PAPERS)
        return {"count": sides["papers"].count(), "failures": [(r.code, r.message) for r in got.failures.collect()]}

    lost = []
    for name, stage, schema in (("stacks", local, LOCAL), ("papers", outside, PAPERS)):
        payload = run_stage(name, stage)
        error = payload.get("error")
        fell = degradation(spark, name, payload, error)
        lost += [(name, *f) for f in payload.get("failures", [])]
        if fell and fell["code"] != "NO_MATCHES":
            lost.append((name, fell["code"], fell["message"]))
        sides.setdefault(name, spark.createDataFrame([], schema))
    failures = spark.createDataFrame([("q", *x) for x in lost], "qid string, source string, code string, message string")
    whole = documents(assistant.envelope(asked, sides["stacks"], sides["papers"], failures), 1)[0]
    return whole | {"stacks": documents(sides["stacks"], k), "papers": documents(sides["papers"], top_k)}


LOCAL = "qid string, citation_id string, tag string, url string, title string, reference string, env_type string, chapter_key string, snippet string, scores struct<hybrid: double, vector: double, bm25: double>"
PAPERS = "qid string, citation_id string, title string, authors string, year string, summary string, url string, source string, provenance array<string>, score double, doi string, arxiv_id string"


# --- command line


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="folioscan")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *needed: str, **optional) -> argparse.ArgumentParser:
        made = commands.add_parser(name)
        for n in needed:
            made.add_argument(f"--{n}", required=True)
        for n, kind in ({"config": str, "output": str, "log_level": str} | optional).items():
            flag = f"--{n.replace('_', '-')}"
            made.add_argument(flag, action="store_true", default=None) if kind is bool else made.add_argument(flag, type=kind)
        return made

    weights = {"vector_k": int, "bm25_k": int, "vector_weight": float, "bm25_weight": float, "chapter": str, "env": str, "seed_k": int, "hops": int, "expand_k": int, "graph_weight": float, "out_weight": float, "in_weight": float, "hop_decay": float, "centrality_weight": float, "lexical_mode": str}
    command("build", "tags", "payloads", "out", chapters=str, chapters_cache=str, chapters_url=str, base=str, now=int, limit=int, incremental=bool, max_age_hours=float, force=bool, workers=int, provider=str, model=str, dim=int)
    command("search", "out", "query", top_k=int, json=bool, **weights)
    command("evaluate", "out", "questions", baseline=str, tolerance=float, **weights)
    command("classify", "query")
    command("papers", "query", sources=str, top_k=int, per_source=int, workers=int, timeout=float, tries=int, cabundle=str)
    command("ask", "out", "query", base_url=str, k=int, top_k=int, sources=str, per_source=int, workers=int, timeout=float, tries=int, cabundle=str)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None, show: Callable[[str], None] = print) -> int:
    """Run a command; values of a configuration file's section stand in for options that are not given."""
    given = vars(parser().parse_args(argv))
    name, output, config, plain = given.pop("command"), given.pop("output"), given.pop("config"), not given.pop("json", None)
    pipeline.setup_logging(given.pop("log_level") or "WARNING")
    try:
        values = readers.options(readers.load_config(config), name, given) if config else {k: v for k, v in given.items() if v is not None}
        if isinstance(values.get("sources"), str):
            values["sources"] = [x for x in values["sources"].split(",") if x.strip()]
        spark = spark or SparkSession.getActiveSession() or local_session()
        payload = globals()[name](spark, **{k: v for k, v in values.items() if k in given})
    except Exception as e:  # noqa: BLE001 - a command ends with an envelope, not a trace
        payload = error_payload(f"{name.upper()}_ERROR", str(e)[:2000])
    if name == "search" and plain and not output and "error" not in payload:
        show(listing(payload))
        return 0
    return emit(payload, output, show)
