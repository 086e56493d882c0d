"""How distinctive each term is for its record (BM25 term weights over all current records)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.functions.fold import fold_accents
from folioscan.operators.skew import hot_keys, lookup_join
from folioscan.session import cut


def current_records(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row per ``key``: the one with the greatest ``order`` (null lowest), ties by the columns themselves.

    An aggregate with map-side combine, not a window, so a key with any number
    of versions never meets in one task as rows. Rows with a null key are no
    records.
    """
    rank = F.struct(F.col(order).isNotNull(), F.col(order), *[F.col(c).isNotNull() for c in columns], *columns)
    picked = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), rank).alias("__r"))
    return picked.select(key, *[F.col(f"__r.{c}").alias(c) for c in columns])


def term_relevance(df: DataFrame, key: str = "id", text: tuple[str, ...] = ("title", "content"), order: str = "indexed_at", min_letters: int = 4, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Score every term of every current record: probabilistic relevance weight with saturating frequency.

    ``score = ln(1 + (N - df + .5) / (df + .5)) * tf (k1 + 1) / (tf + k1 (1 - b + b dl / avgdl))``
    with ``N``, ``df`` and ``avgdl`` over all current records. Terms are maximal
    runs of at least ``min_letters`` letters after lower-casing and dropping
    accents.

    Returns ``key, term, tf, df, dl, score``. Cases: a null or empty text has no
    terms and the record still counts in ``N``; repeated rows count once; an
    empty table gives no rows; other columns are ignored, whatever their names.
    """
    spark = df.sparkSession
    records = current_records(df, key, order, list(text))
    terms = F.regexp_extract_all(fold_accents(F.concat_ws("\n", *text)), F.lit(rf"\p{{L}}{{{min_letters},}}"), F.lit(0))
    # The empty term marks the record itself, so that N and the lengths come from the same table.
    exploded = records.select(F.col(key).alias("id"), terms.alias("t")).select("id", F.size("t").alias("dl"), F.explode(F.concat(F.array(F.lit("")), "t")).alias("term"))
    postings = cut(exploded.groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf")), "postings")
    n, total = postings.filter("term = ''").agg(F.count(F.lit(1)), F.sum("dl")).first()
    if not n:
        return spark.createDataFrame([], f"{key} string, term string, tf bigint, df bigint, dl int, score double")
    real = postings.filter("term <> ''")
    stats = cut(real.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "terms")
    size = stats.agg(F.sum("df")).first()[0] or 0
    joined = lookup_join(real, stats, "term", hot_keys(stats, "term", "df", size))
    idf = F.log1p((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit((total or 0) / n or 1.0))
    return joined.select(F.col("id").alias(key), "term", "tf", "df", "dl", (idf * F.col("tf") * (k1 + 1) / norm).alias("score"))
