"""Answers from local documents and literature: relevance, evidence, citations, routes and confidence, for a batch of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.functions import literature as L
from folioscan.functions import scoring as S
from folioscan.functions.text import snippet, text
from folioscan.operators.merging import merge_by_key, ranked_items, score_records


def local_evidence(ranking: DataFrame, corpus: DataFrame, k: int = 8, base_url: str = "") -> DataFrame:
    """The ``k`` best documents of each query with citation ids ``S1...`` and snippets."""
    rows = ranking.filter(F.col("rank") <= k).join(corpus.select("id", "tag", "title", "reference", "env_type", "chapter_key", "statement_text", "proof_text"), "id")
    body = F.when(text(F.col("statement_text")) != "", F.col("statement_text")).otherwise(F.col("proof_text"))
    return rows.select("qid", F.concat(F.lit("S"), F.col("rank").cast("string")).alias("citation_id"), "tag", F.concat(F.lit(f"{base_url}/tag/"), "tag").alias("url"), "title", "reference", "env_type", "chapter_key", snippet(body, 260).alias("snippet"), F.struct(F.round("score", 6).alias("hybrid"), F.round("vs", 6).alias("vector"), F.round("bs", 6).alias("bm25")).alias("scores"))


def papers(items: DataFrame, queries: DataFrame, now_year: int, k: int = 6) -> DataFrame:
    """Merged literature of each query with citation ids ``P1...``."""
    return score_records(merge_by_key(ranked_items(items), ("qid", "key")), queries, now_year, k)


def citations(local: DataFrame, literature: DataFrame) -> DataFrame:
    """``qid, references``: lines of local documents, then of papers, in the order of their ids."""
    number = F.regexp_extract("citation_id", r"(\d+)", 1).cast("int")
    s = local.select("qid", F.lit(0).alias("side"), number.alias("n"), L.local_citation(F.col("citation_id"), F.col("tag"), F.col("title"), F.col("reference"), F.col("url")).alias("line"))
    p = literature.select("qid", F.lit(1).alias("side"), number.alias("n"), L.paper_citation(F.col("citation_id"), F.col("authors"), F.col("title"), F.col("year"), F.col("source"), F.col("url")).alias("line"))
    return s.unionByName(p).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("side", "n", "line"))), lambda x: x["line"]).alias("references"))


def envelope(queries: DataFrame, local: DataFrame, literature: DataFrame, failures: DataFrame | None = None, ok_share: float = 1.0) -> DataFrame:
    """One row for each query: relevance, route, counts, citations, warnings, confidence and quality.

    ``failures(qid, source, code, message)`` of stages become warnings, each
    (source, code, reason) once; a side without result is one as well.
    """
    spark = queries.sparkSession
    asked = queries.select("qid", "query", S.relevance(F.col("query")).alias("relevance"))
    n_local = local.groupBy("qid").agg(F.count(F.lit(1)).alias("n_local"))
    n_papers = literature.groupBy("qid").agg(F.count(F.lit(1)).alias("n_papers"))
    rows = asked.join(n_local, "qid", "left").join(n_papers, "qid", "left").join(citations(local, literature), "qid", "left").na.fill(0, ["n_local", "n_papers"])
    rows = rows.withColumn("route", S.route(F.col("relevance.label"), F.col("n_local"), F.col("n_papers")))
    if failures is None:
        failures = spark.createDataFrame([], "qid string, source string, code string, message string")
    lost = failures.select("qid", "source", "code", "message", S.degrade_reason(F.col("code"), F.col("message")).alias("degrade_reason"))
    empty = rows.select("qid", F.explode(F.array_compact(F.array(F.when(F.col("n_local") == 0, "stacks"), F.when(F.col("n_papers") == 0, "papers")))).alias("source")).join(lost.select("qid", "source").distinct(), ["qid", "source"], "left_anti")
    empty = empty.select("qid", "source", F.lit("NO_MATCHES").alias("code"), F.concat("source", F.lit(" retrieval returned no results.")).alias("message"), F.lit("no_matches").alias("degrade_reason"))
    warnings = lost.unionByName(empty).groupBy("qid", "source", "code", "degrade_reason").agg(F.min("message").alias("message")).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("source", "code", "message", "degrade_reason"))).alias("warnings"))
    rows = rows.join(warnings, "qid", "left")
    stop = F.col("route").isin("low_relevance_stop", "pipeline_failed")
    none = F.array().cast("array<string>")
    rows = rows.withColumn("references", F.when(stop, none).otherwise(F.coalesce("references", none)))
    conf = S.source_confidence(F.col("route"), F.col("n_local"), F.col("n_papers"), F.lit(False), F.lit(ok_share), F.size("references"), F.transform("warnings", lambda w: w["degrade_reason"]))
    return rows.withColumn("source_confidence", conf).withColumn("evidence_quality", S.quality_band(F.col("source_confidence")))
