"""Corpus building: chapters, joins of metadata and payloads, full and incremental merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions import text as X


def longest_prefix(labels: DataFrame, keys: DataFrame, label: str = "full_label", key: str = "chapter_key") -> DataFrame:
    """Add to each label its longest key ``k`` such that the label starts with ``k-``.

    Without one, what precedes the first hyphen; without a hyphen ``unknown``.
    The label's own hyphen prefixes are exploded and joined by equality, so the
    cost is linear in both sides, and no prefix meets all keys.
    """
    parts = F.split(F.col("__label"), "-")
    distinct = labels.select(F.col(label).alias("__label")).filter(F.col("__label").isNotNull()).distinct()
    prefixes = distinct.select("__label", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "-"))).alias("__p")).filter(F.startswith("__label", F.concat("__p", F.lit("-"))))
    found = prefixes.join(keys.select(F.col(key).alias("__p")).distinct(), "__p").groupBy("__label").agg(F.max_by("__p", F.length("__p")).alias("__found"))
    joined = labels.join(found, F.col(label) == F.col("__label"), "left").drop("__label")
    first = F.when(F.contains(label, F.lit("-")), F.substring_index(label, "-", 1)).otherwise(F.lit("unknown"))
    return joined.withColumn(key, F.coalesce("__found", first)).drop("__found")


def tag_metadata(tags: DataFrame, keys: DataFrame) -> DataFrame:
    """``id, tag, full_label, chapter_key, source_tex, env_hint`` of ``tags(tag, full_label)``."""
    placed = longest_prefix(tags, keys)
    return placed.select(F.col("tag").alias("id"), "tag", "full_label", "chapter_key", F.concat("chapter_key", F.lit(".tex")).alias("source_tex"), X.env_hint(F.col("full_label"), F.col("chapter_key")).alias("env_hint"))


def corpus_rows(metadata: DataFrame, payloads: DataFrame) -> DataFrame:
    """Corpus rows of the tags that have metadata and a payload ``(tag, structure, statement, full, content_hash)``."""
    got = payloads.select("tag", X.structure_fields(F.col("structure.content")).alias("st"), X.text(F.col("statement.content")).alias("statement_html"), X.text(F.col("full.content")).alias("full_html"), X.text(F.col("content_hash")).alias("api_content_hash"))
    texts = metadata.join(got, "tag").withColumn("s", X.html_to_text("statement_html")).withColumn("f", X.html_to_text("full_html"))
    texts = texts.withColumn("statement_text", X.strip(F.col("s"))).withColumn("proof_text", X.split_proof(F.col("s"), F.col("f")))
    field = lambda name: F.nullif(X.strip(X.text(F.col(f"st.{name}"))), F.lit(""))
    return texts.select(
        F.col("tag").alias("id"),
        "tag",
        X.text(F.col("full_label")).alias("full_label"),
        X.text(F.col("chapter_key")).alias("chapter_key"),
        X.text(F.col("source_tex")).alias("source_tex"),
        X.env_type(F.col("statement_html"), F.col("env_hint")).alias("env_type"),
        F.coalesce(field("reference"), X.html_to_text(X.reference_number(F.col("statement_html")))).alias("reference"),
        F.coalesce(field("name"), X.html_to_text(X.heading(F.col("statement_html")))).alias("title"),
        X.text(F.col("st.type")).alias("structure_type"),
        X.text(F.col("st.name")).alias("structure_name"),
        "statement_text",
        "proof_text",
        X.normalize_math(X.strip(F.concat_ws("\n", "statement_text", "proof_text"))).alias("normalized_text"),
        X.tag_refs(F.col("full_html")).alias("outgoing_refs"),
        "statement_html",
        "full_html",
        X.content_hash(*[F.col(c) for c in ("statement_text", "proof_text", "full_html", "statement_html", "full_label")]).alias("content_hash"),
        "api_content_hash",
    )


def merge_corpus(existing: DataFrame, targets: DataFrame, rebuilt: DataFrame, key: str = "tag") -> DataFrame:
    """Replace the target keys by their rebuilt rows; targets that were not rebuilt vanish."""
    return existing.join(targets.select(key).distinct(), key, "left_anti").unionByName(rebuilt.join(targets.select(key).distinct(), key, "left_semi"))


def refresh_reason(cached: Column, label: Column, now: int, max_age_hours: float, force: bool = False) -> Column:
    """Why a cached payload must be fetched again, or ``cache_valid``.

    ``cached``: null if missing, else a struct ``full_label, statement_ok,
    full_ok, fetched_at_utc``, null inside where the payload is broken. A
    negative age never expires.
    """
    at = F.coalesce(cached["fetched_at_utc"], F.lit(0))
    age = (F.lit(now) - at) / 3600.0
    # The names of the reasons.
    return (
        F.when(F.lit(force) | cached.isNull(), "missing_or_forced")
        .when(~F.coalesce(cached["is_object"], F.lit(False)), "invalid_cache")
        .when(~cached["full_label"].eqNullSafe(label), "full_label_changed")
        .when(~(F.coalesce(cached["statement_ok"], F.lit(False)) & F.coalesce(cached["full_ok"], F.lit(False))), "previous_failure")
        .when(at <= 0, "missing_timestamp")
        .when(F.lit(max_age_hours < 0), "cache_valid")
        .when(age >= max_age_hours, "cache_expired")
        .otherwise("cache_valid")
    )


def refresh_plan(tags: DataFrame, cache: DataFrame, now: int, max_age_hours: float = 168.0, force: bool = False) -> DataFrame:
    """``tag, full_label, reason`` for ``tags(tag, full_label)`` against ``cache(tag, full_label, statement_ok, full_ok, fetched_at_utc)``."""
    held = cache.select("tag", F.struct((F.col("is_object") if "is_object" in cache.columns else F.lit(True)).alias("is_object"), "full_label", "statement_ok", "full_ok", "fetched_at_utc").alias("c"))
    return tags.join(held, "tag", "left").select("tag", "full_label", refresh_reason(F.col("c"), F.col("full_label"), now, max_age_hours, force).alias("reason"))
