"""Merging literature records by key, scoring them, and ranking the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscan.functions import literature as L
from folioscan.functions.text import strip, text

FIELDS = ["title", "authors", "year", "summary", "url", "doi", "arxiv_id"]


def ranked_items(items: DataFrame) -> DataFrame:
    """Items ``(source_key, rank, ...)`` cleaned, with label, rank signal, canonical key and arrival order."""
    clean = items.select("source_key", "rank", *[strip(text(F.col(c))).alias(c) for c in FIELDS], *[c for c in ("qid",) if c in items.columns])
    clean = clean.withColumns({"doi": F.lower("doi"), "arxiv_id": F.lower("arxiv_id")})
    clean = clean.withColumns({"doi": F.when(F.col("doi") == "", L.doi_in(F.col("url"))).otherwise(F.col("doi")), "arxiv_id": F.when(F.col("arxiv_id") == "", L.arxiv_in(F.col("url"))).otherwise(F.col("arxiv_id"))})
    labels = F.create_map(*[F.lit(x) for pair in L.LABELS.items() for x in pair])
    place = F.array_position(F.array(*[F.lit(s) for s in L.SOURCES]), F.col("source_key"))
    return clean.withColumns({"source": F.coalesce(F.try_element_at(labels, F.col("source_key")), F.col("source_key")), "rank_signal": L.source_rank_score(F.col("source_key"), F.col("rank")), "key": L.canonical_key(F.col("doi"), F.col("arxiv_id"), F.col("url"), F.col("title")), "ord": F.struct(place.alias("s"), F.col("rank").alias("r"))})


def merge_by_key(items: DataFrame, group: tuple[str, ...] = ("key",)) -> DataFrame:
    """One record per key: the first non-empty value of each field in arrival order, the longest summary, all sources in order, the best rank signal.

    All but the list of sources are aggregates of fixed size; that list is first
    made distinct, so its length is bounded by the number of sources.
    """
    rows = items.filter(F.col("key") != "")
    first = {c: F.coalesce(F.min_by(c, F.when(F.col(c) != "", F.col("ord"))), F.lit("")) for c in FIELDS if c != "summary"}
    merged = rows.groupBy(*group).agg(*[v.alias(c) for c, v in first.items()], F.min_by("summary", F.struct(-F.length("summary"), "ord")).alias("summary"), F.max("rank_signal").alias("rank_signal"))
    sources = rows.groupBy(*group, "source").agg(F.min("ord").alias("ord")).groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("ord", "source"))).alias("p"))
    return merged.join(sources, list(group)).withColumn("provenance", F.transform("p", lambda x: x["source"])).drop("p")


def score_records(records: DataFrame, queries: DataFrame, now_year: int, top: int = 6) -> DataFrame:
    """The ``top`` records of each ``(qid, query)``: ``qid, citation_id, score`` and the record."""
    asked = queries.select("qid", L.query_tokens(F.col("query")).alias("tokens"), L.prefers_fresh(F.col("query")).alias("fresh"))
    rows = records.filter("title <> '' OR summary <> ''").join(asked, "qid")
    score = L.item_score(F.col("rank_signal"), L.overlap(F.col("title"), F.col("summary"), F.col("tokens")), L.recency(F.col("year"), now_year), F.size("provenance"), (F.col("doi") != "") | (F.col("arxiv_id") != ""), F.col("fresh"))
    scored = rows.withColumn("score", F.round(score, 6))
    n = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "key"))
    return scored.withColumn("n", n).filter(F.col("n") <= top).select("qid", F.concat(F.lit("P"), F.col("n").cast("string")).alias("citation_id"), "title", "authors", "year", "summary", "url", F.array_join("provenance", " + ").alias("source"), "provenance", "score", "doi", "arxiv_id")


def source_diagnostics(items: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """``source_key, status, count, degrade_reason`` of every asked source; ``failures(source_key, code, message)``."""
    from folioscan.functions.scoring import source_degrade_reason

    spark = items.sparkSession
    asked = spark.createDataFrame([(s,) for s in L.SOURCES], "source_key string")
    counts = items.groupBy("source_key").agg(F.count(F.lit(1)).alias("count"))
    out = asked.join(counts, "source_key", "left").na.fill(0, ["count"])
    if failures is None:
        return out.select("source_key", F.lit("ok").alias("status"), "count", F.when(F.col("count") == 0, "no_matches").alias("degrade_reason"))
    out = out.join(failures, "source_key", "left")
    bad = F.col("code").isNotNull()
    return out.select("source_key", F.when(bad, "error").otherwise("ok").alias("status"), F.when(bad, 0).otherwise(F.col("count")).alias("count"), F.when(bad, source_degrade_reason(F.col("code"), F.col("message"))).when(F.col("count") == 0, "no_matches").alias("degrade_reason"))
