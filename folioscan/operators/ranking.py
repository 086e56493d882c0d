"""Top-k, seeds, fusion and keep-last, always with a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscan.functions.scoring import minmax


def top_k(df: DataFrame, k: int, group: list[str], score: str, tie: str = "id", out: str = "rank") -> DataFrame:
    """The ``k`` best of each group by score, then by ``tie``; the engine cuts to ``k`` before the shuffle."""
    w = W.partitionBy(*group).orderBy(F.desc(score), tie)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


def keep_last(df: DataFrame, key: str, order: Column) -> DataFrame:
    """One row per non-empty key: the last in the order."""
    rows = df.filter((F.col(key).isNotNull()) & (F.col(key).cast("string") != ""))
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), order).alias("r")).select(key, "r.*").select(*df.columns)


def fuse(vector: DataFrame, lexical: DataFrame, vector_weight: float = 0.55, lexical_weight: float = 0.45) -> DataFrame:
    """Union of two candidate lists ``(qid, id, score)`` with min-max scores; a missing one counts 0."""
    v = vector.select("qid", "id", minmax(F.col("score"), "qid").alias("vs"))
    b = lexical.select("qid", "id", minmax(F.col("score"), "qid").alias("bs"))
    both = v.join(b, ["qid", "id"], "full_outer").na.fill(0.0, ["vs", "bs"])
    return both.withColumn("score", vector_weight * F.col("vs") + lexical_weight * F.col("bs"))


def passes(chapter: str = "", env: str = "", chapter_column: str = "chapter_key", env_column: str = "env_type") -> Column | None:
    """Equality filters; an empty one is no predicate at all, so that the rest can be pushed down."""
    tests = [F.col(c) == v for c, v in ((chapter_column, chapter), (env_column, env)) if v]
    return (tests[0] & tests[1] if len(tests) == 2 else tests[0]) if tests else None
