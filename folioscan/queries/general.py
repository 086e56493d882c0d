"""Queries of the general training-data problems: incremental runs (p3) and orphan references (p4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions.fold import clean_tag
from folioscan.operators.incremental import epoch_seconds, replay_runs
from folioscan.operators.orphans import orphan_references, orphan_report
from folioscan.session import table

CONTENT = ["statement_text", "proof_text", "full_html", "statement_html", "full_label"]
FETCHED = ["statement_text", "proof_text", "statement_html", "full_html"]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each successful run and the tags that are new or changed in it."""
    corpus = table(spark, sf_dir, "corpus")
    found = replay_runs(corpus, table(spark, sf_dir, "build_runs"), clean_tag(F.col("tag")), epoch_seconds(F.col("fetched_at_utc")), "loaded_at", CONTENT, FETCHED)
    return found.select("run_id", F.col("key").alias("tag"))


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = table(spark, sf_dir, "corpus").select(clean_tag(F.col("tag")).alias("tag"), "outgoing_refs", F.col("loaded_at").alias("at"))
    edges = table(spark, sf_dir, "ref_edges").select(F.lit("ref_edges").alias("ref_table"), clean_tag(F.col("source_tag")).alias("source_tag"), clean_tag(F.col("target_tag")).alias("target_tag"), F.col("loaded_at").alias("at"))
    listed = corpus.select(F.col("tag").alias("source_tag"), F.explode("outgoing_refs").alias("t"), "at").select(F.lit("corpus").alias("ref_table"), "source_tag", clean_tag(F.col("t")).alias("target_tag"), "at")
    removed = table(spark, sf_dir, "deleted_tags").select(clean_tag(F.col("tag")).alias("tag"), F.col("deleted_at").alias("at"))
    return orphan_references(edges.unionByName(listed), corpus.select("tag", "at"), removed)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References whose target is not live at the end of a month, with the first such month."""
    return _orphans(spark, sf_dir).filter("kind = 'direct'").select("ref_table", "source_tag", "target_tag", "first_month")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct and inherited orphan references per table and month."""
    return orphan_report(_orphans(spark, sf_dir))


QUERIES = {"p3_found": p3_found, "p4_found": p4_found, "p4_report": p4_report}

_CLEAN = r"nullif(upper(regexp_replace({0}, '(?i)^(?:[\s\p{{Z}}\p{{C}}]+|/tag/|#)+|[\s\p{{Z}}\p{{C}}]+$', '', 'g')), '')"

_P3 = f"""
WITH runs AS (SELECT run_id, min(started_at) AS s FROM build_runs GROUP BY run_id HAVING bool_or(coalesce(lower(trim(status)) = 'success', false))),
rows_ AS (SELECT {_CLEAN.format('tag')} AS tag, loaded_at, coalesce(CASE WHEN abs(fetched_at_utc) >= 100000000000 THEN fetched_at_utc // 1000 ELSE fetched_at_utc END, 0) AS f,
  md5(concat_ws(chr(31), coalesce(statement_text, ''), coalesce(proof_text, ''), coalesce(full_html, ''), coalesce(statement_html, ''), coalesce(full_label, ''))) AS h
  FROM corpus WHERE coalesce(statement_text, '') <> '' OR coalesce(proof_text, '') <> '' OR coalesce(statement_html, '') <> '' OR coalesce(full_html, '') <> ''),
now_ AS (SELECT run_id, s, tag, arg_max(h, (f, loaded_at)) AS h FROM runs JOIN rows_ ON loaded_at <= s GROUP BY ALL),
was AS (SELECT *, lag(h) OVER (PARTITION BY tag ORDER BY s, run_id) AS p FROM now_)
SELECT run_id::BIGINT AS run_id, tag FROM was WHERE p IS NULL OR p <> h
"""

_P4 = f"""
WITH refs0 AS (SELECT 'ref_edges' AS ref_table, {_CLEAN.format('source_tag')} AS source_tag, {_CLEAN.format('target_tag')} AS target_tag, loaded_at FROM ref_edges
  UNION ALL SELECT 'corpus', {_CLEAN.format('tag')}, {_CLEAN.format('t')}, loaded_at FROM (SELECT tag, loaded_at, unnest(outgoing_refs) AS t FROM corpus)),
refs AS (SELECT ref_table, source_tag, target_tag, min(loaded_at) AS ts FROM refs0 WHERE source_tag IS NOT NULL AND target_tag IS NOT NULL GROUP BY ALL),
ev AS (SELECT {_CLEAN.format('tag')} AS tag, loaded_at AS ts, 1 AS k FROM corpus UNION ALL SELECT {_CLEAN.format('tag')}, deleted_at AS ts, 0 FROM deleted_tags),
months AS (SELECT i AS m, make_timestamp(2024 + i // 12, i % 12 + 1, 1, 0, 0, 0) AS e FROM range(1, 13) r(i)),
live AS (SELECT m, tag, arg_max(k, (ts, k)) AS k FROM months JOIN ev ON ts < e GROUP BY ALL)
SELECT ref_table, source_tag, target_tag, printf('2024-%02d', min(months.m)) AS first_month
FROM refs JOIN months ON ts < e LEFT JOIN live ON live.m = months.m AND live.tag = target_tag
WHERE coalesce(live.k, 0) = 0 GROUP BY ref_table, source_tag, target_tag
"""

_P4_REPORT = f"""
WITH RECURSIVE refs0 AS (SELECT 'ref_edges' AS ref_table, {_CLEAN.format('source_tag')} AS source_tag, {_CLEAN.format('target_tag')} AS target_tag, loaded_at FROM ref_edges
  UNION ALL SELECT 'corpus', {_CLEAN.format('tag')}, {_CLEAN.format('t')}, loaded_at FROM (SELECT tag, loaded_at, unnest(outgoing_refs) AS t FROM corpus)),
refs AS (SELECT ref_table, source_tag, target_tag, min(loaded_at) AS ts FROM refs0 WHERE source_tag IS NOT NULL AND target_tag IS NOT NULL GROUP BY ALL),
ev AS (SELECT {_CLEAN.format('tag')} AS tag, loaded_at AS ts, 1 AS k FROM corpus UNION ALL SELECT {_CLEAN.format('tag')}, deleted_at AS ts, 0 FROM deleted_tags),
months AS (SELECT i AS m, make_timestamp(2024 + i // 12, i % 12 + 1, 1, 0, 0, 0) AS e FROM range(1, 13) r(i)),
live AS (SELECT m, tag FROM months JOIN ev ON ts < e GROUP BY ALL HAVING arg_max(k, (ts, k)) = 1),
refmonths AS (SELECT ref_table, source_tag, target_tag, months.m FROM refs JOIN months ON ts < e),
direct AS (SELECT r.* FROM refmonths r ANTI JOIN live ON live.m = r.m AND live.tag = r.target_tag),
edges AS (SELECT source_tag, target_tag, min(ts) AS ts FROM refs GROUP BY ALL),
edgemonths AS (SELECT source_tag, target_tag, m FROM edges JOIN months ON ts < e),
taint(tag, m) AS (SELECT DISTINCT source_tag, m FROM direct UNION SELECT s.source_tag, s.m FROM taint JOIN edgemonths s ON s.target_tag = taint.tag AND s.m = taint.m),
through AS (SELECT r.* FROM refmonths r SEMI JOIN taint ON taint.tag = r.target_tag AND taint.m = r.m),
inherited AS (SELECT t.* FROM through t ANTI JOIN direct d ON d.ref_table = t.ref_table AND d.source_tag = t.source_tag AND d.target_tag = t.target_tag AND d.m = t.m),
both_ AS (SELECT *, 'direct' AS kind FROM direct UNION ALL SELECT *, 'inherited' FROM inherited)
SELECT ref_table, printf('2024-%02d', m) AS month, kind, count(*) AS n_refs, count(DISTINCT target_tag) AS n_targets FROM both_ GROUP BY ref_table, m, kind
"""

SQL = {"p3_found": _P3, "p4_found": _P4, "p4_report": _P4_REPORT}
