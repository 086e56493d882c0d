"""Joins and running sums that stay balanced when one key holds a third of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A key is hot from this share of the rows on; at most 1 / HOT_SHARE keys can be.
HOT_SHARE = 1 / 1000


def hot_keys(counts: DataFrame, key: str, count: str, total: int, share: float = HOT_SHARE) -> DataFrame:
    """Keys that hold at least ``share`` of ``total`` rows: by counting, at most ``1 / share`` rows."""
    return counts.filter(F.col(count) >= F.lit(max(1.0, total * share))).select(key)


def lookup_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """``left`` join ``right`` (unique on ``key``) with the hot keys broadcast and the rest shuffled.

    ``hot`` has at most ``1 / HOT_SHARE`` rows (see :func:`hot_keys`), so what is
    broadcast has a fixed bound: those keys and one ``right`` row for each.
    ``left`` should be cheap to read twice (a table or a cut). Rows with a null
    key match nothing; they are kept for ``how="left"``.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    mark = "__hot"
    few = F.broadcast(hot.select(key).distinct().withColumn(mark, F.lit(True)))
    hot_left = left.join(few, key, "left_semi")
    cold_left = left.join(few.drop(mark), key, "left_anti")
    hot_right = F.broadcast(right.join(few.drop(mark), key, "left_semi"))
    return hot_left.join(hot_right, key, how).unionByName(cold_left.join(right, key, how))


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, spread_by: str, parts: int = 64) -> DataFrame:
    """Inner join of ``left`` and ``right``, both with any number of rows of a key, that no hot key holds up.

    Rows of ``left`` with a hot key are dealt to ``parts`` tasks by the hash of
    ``spread_by``; rows of ``right`` with such a key go to each of them. Only the
    hot keys themselves, at most ``1 / HOT_SHARE``, are broadcast.
    """
    marked = F.broadcast(hot.select(key).distinct().withColumn("__hot", F.lit(True)))
    is_hot = F.col("__hot").isNotNull()
    dealt = F.when(is_hot, F.pmod(F.xxhash64(spread_by), F.lit(parts))).otherwise(F.lit(0)).cast("int")
    everywhere = F.when(is_hot, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    one = left.join(marked, key, "left").withColumn("__part", dealt).drop("__hot")
    many = right.join(marked, key, "left").withColumn("__part", F.explode(everywhere)).drop("__hot")
    return one.join(many, [key, "__part"]).drop("__part")


def running_sum(df: DataFrame, group: list[str], bucket: str, order: list, value: str, out: str) -> DataFrame:
    """Inclusive running sum of ``value`` per ``group`` along (``bucket``, ``order``).

    ``bucket`` is a non-negative integer column that rises with the order. Sums
    per bucket are taken first (map-side combined); their running offsets form a
    table of #groups x #buckets rows, and only one bucket at a time is a window
    partition, so that no task holds a whole group.
    """
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("__s"))
    over = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*group, bucket, F.coalesce(F.sum("__s").over(over), F.lit(0)).alias("__o"))
    inner = W.partitionBy(*group, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.join(offsets, [*group, bucket]).withColumn(out, F.col("__o") + F.sum(value).over(inner)).drop("__o")
