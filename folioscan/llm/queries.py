"""Queries of the training-data problems in this subpackage, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm.contamination import leaked_items
from folioscan.llm.distinctive import term_relevance
from folioscan.llm.language import UNKNOWN, detect_languages, mislabelled
from folioscan.llm.matching import match_classes, match_entities, match_members
from folioscan.llm.mixing import mix_sources
from folioscan.llm.survivor import survivor_records, survivors
from folioscan.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that occur 5 times or more in a record and in 2 to 8 records."""
    scored = term_relevance(table(spark, sf_dir, "docs_fts"))
    return scored.filter("tf >= 5 AND df BETWEEN 2 AND 8").select("id", "term")


def p1_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term of every current record with its score."""
    return term_relevance(table(spark, sf_dir, "docs_fts"), min_letters=1).select("id", "term", "tf", "df", F.round("score", 6).alias("score"))


def _survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors(table(spark, sf_dir, "dup_groups"), table(spark, sf_dir, "retrieve_papers"), table(spark, sf_dir, "source_trust"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each group and field the item whose value survives."""
    return _survivors(spark, sf_dir).select("group_id", "field_name", "item_id")


def p2_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a flat prior: accuracies and discounted votes alone decide."""
    tables = (table(spark, sf_dir, name) for name in ("dup_groups", "retrieve_papers", "source_trust"))
    best = survivors(*tables, trust_weight=0.0, words_weight=0.0)
    return best.select("group_id", "field_name", "item_id", F.round("posterior", 6).alias("posterior"))


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving record of each group."""
    return survivor_records(_survivors(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of items of different sources that are the same paper."""
    return _matches(spark, sf_dir).select("item_id_a", "item_id_b")


def p5_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs with their confidence."""
    return _matches(spark, sf_dir).select("item_id_a", "item_id_b", F.round("confidence", 6).alias("confidence"))


def p5_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item with its class of items alike and the number of classes of other sources that are the same paper."""
    return match_members(*match_classes(table(spark, sf_dir, "retrieve_papers"), table(spark, sf_dir, "dup_groups")))


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_entities(table(spark, sf_dir, "retrieve_papers"), table(spark, sf_dir, "dup_groups"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the test passages they hold."""
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def p6_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with how much of each passage a document holds: its longest run and its words in order."""
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), measure=True)


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selected documents of every mix."""
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share each source reached in every mix."""
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of documents that are mixed, unlabelled or labelled wrongly."""
    found = mislabelled(detect_languages(table(spark, sf_dir, "documents")))
    return found.filter(F.col("lang_code") != UNKNOWN).select("doc_id", "lang_code")


def p8_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of every document with its language and confidence."""
    found = detect_languages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.posexplode("stretches").alias("stretch_no", "s")).select("doc_id", "stretch_no", "s.*")


QUERIES = {"p1_found": p1_found, "p1_scores": p1_scores, "p2_found": p2_found, "p2_votes": p2_votes, "p2_records": p2_records, "p5_found": p5_found, "p5_matches": p5_matches, "p5_members": p5_members, "p6_found": p6_found, "p6_overlaps": p6_overlaps, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_stretches": p8_stretches}

_P1 = r"""
WITH cur AS (SELECT id, arg_max({'t': title, 'c': content}, indexed_at) AS r FROM docs_fts WHERE id IS NOT NULL GROUP BY id),
docs AS (SELECT id, regexp_extract_all(regexp_replace(strip_accents(lower(concat_ws(chr(10), r.t, r.c))), '\p{M}+', '', 'g'), '\p{L}{LETTERS,}') AS w FROM cur),
tf AS (SELECT id, len(w) AS dl, term, count(*) AS tf FROM (SELECT id, w, unnest(w) AS term FROM docs) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
n AS (SELECT count(*)::DOUBLE AS n, sum(len(w)) / count(*)::DOUBLE AS a FROM docs)
"""
_SCORE = "round(ln(1 + (n - df + .5) / (df + .5)) * tf * 2.2 / (tf + 1.2 * (.25 + .75 * dl / a)), 6)"

SQL = {
    "p1_found": _P1.replace("LETTERS", "4") + "SELECT id, term FROM tf JOIN df USING (term) WHERE tf >= 5 AND df BETWEEN 2 AND 8",
    "p1_scores": _P1.replace("LETTERS", "1") + f"SELECT id, term, tf, df, {_SCORE} AS score FROM tf JOIN df USING (term), n",
}
